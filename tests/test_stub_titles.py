"""Titles of the stub against its SQL: a letter for a letter."""

import duckdb

from learngraph.operators import generation

TITLED = r"array_to_string(list_transform(regexp_extract_all(?, '\p{L}+|[^\p{L}]+'), lambda x: upper(x[1:1]) || lower(x[2:])), '')"


def test_stub_titles_equal_sql():
    for text in ("schöö ßein dem", "aßb", "ǆ ŉ ﬁ ᾳ İx", "ὈΔΥΣΣΕΎΣ", "don't ⅷⅷ 3rd"):
        assert generation._titled(text) == duckdb.execute(f"SELECT {TITLED}", [text]).fetchone()[0]
