"""Tables written on the way go at the end; objects of the state name their vectors."""

import os

from learngraph import shared
from learngraph.streaming import prerequisites as P


def test_tables_on_the_way_go(spark, tmp_path):
    before = set(os.listdir(shared.shared_folder(spark)))
    with shared.passing(spark):
        assert shared.written(spark.range(3), "way").count() == 3
        assert len(set(os.listdir(shared.shared_folder(spark))) - before) == 1
    assert set(os.listdir(shared.shared_folder(spark))) == before
    shared.written(spark.range(3), "stays")
    assert len(set(os.listdir(shared.shared_folder(spark))) - before) == 1
    tables = P.open_store(spark, str(tmp_path / "s")).tables
    assert [t for t, x in tables.items() if "vector array" in x.columns] == ["vectors"]
