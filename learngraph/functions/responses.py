"""Parsing of model answers that should hold JSON: strict, then tidied, then what can be recovered."""

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from learngraph.functions.text import BAD_ESCAPE, COMMENT, FENCE_CLOSES, FENCE_OPENS, TRAILING_COMMA

_FENCE = re.compile(f"{FENCE_OPENS}|{FENCE_CLOSES}")
_BAD_ESCAPE = re.compile(BAD_ESCAPE)


def bare(text: str | None) -> str:
    return _FENCE.sub("", (text or "").strip())


def parse(text: str | None):
    """The JSON value of an answer; backslashes that begin no escape are doubled if it doesn't parse as it is. ValueError if it is empty or no JSON."""
    body = bare(text)
    if not body:
        raise ValueError("empty answer")
    try:
        return json.loads(body)
    except ValueError:
        return json.loads(_BAD_ESCAPE.sub(r"\\\\", body))


def tidy(text: str) -> str:
    """Without commas before a closing bracket and // comments."""
    return re.sub(COMMENT, "", re.sub(TRAILING_COMMA, r"\1", text))


def recover(text: str | None) -> list:
    """The whole objects in a broken array, found by counting braces outside of strings."""
    out, depth, start, quoted, escaped, body = [], 0, 0, False, False, bare(text)
    for i, c in enumerate(body):
        if quoted:
            escaped = c == "\\" and not escaped
            if c == '"' and not escaped:
                quoted = False
            continue
        if c == '"' and depth:
            quoted, escaped = True, False
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    out.append(json.loads(body[start : i + 1]))
                except ValueError:
                    continue
    return out


def rows(text: str | None) -> list[str]:
    """The array's elements as JSON texts: strict, else tidied, else recovered; none of an answer that holds no array."""
    for attempt in (lambda: parse(text), lambda: json.loads(tidy(bare(text)))):
        try:
            found = attempt()
        except ValueError:
            continue
        return [json.dumps(x, ensure_ascii=False) for x in found] if isinstance(found, list) else []
    return [json.dumps(x, ensure_ascii=False) for x in recover(text)]


@F.pandas_udf(ArrayType(StringType()))
def _rows(texts: pd.Series) -> pd.Series:
    return texts.map(rows)


def response_rows(text: Column) -> Column:
    """The elements of an answer's array, each a JSON text: for ``from_json`` with a schema of the contract."""
    return _rows(text)


@F.pandas_udf(StringType())
def _object(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            found = parse(t)
        except ValueError:
            return None
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None

    return texts.map(one)


def response_object(text: Column) -> Column:
    """An answer's object as a JSON text; null where it holds none."""
    return _object(text)
