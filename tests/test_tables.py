"""Tables of the catalog that get new columns."""

import os

import pytest

from parlance.sources import tables


def files_of(path):
    return {f: os.stat(path / f).st_mtime_ns for f in os.listdir(path) if f.startswith("part-")}


def test_new_columns_leave_old_files_alone(spark, tmp_path):
    name, path = "evolving", tmp_path / "t"
    spark.sql(f"drop table if exists {name}")
    old = spark.createDataFrame([(1, "a")], "id long, kind string")
    assert tables.evolve_table(old, name, str(path)) == []
    before = files_of(path)
    new = spark.createDataFrame([(2.5, 2, [1])], "price double, id long, tags array<int>")
    assert tables.evolve_table(new, name) == ["price", "tags"]
    after = files_of(path)
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)
    rows = sorted(map(tuple, tables.read_table(spark, name, ["id", "kind", "price", "tags"]).collect()))
    assert rows == [(1, "a", None, None), (2, None, 2.5, [1])]
    assert tables.evolve_table(old, name) == []
    with pytest.raises(ValueError, match="kind"):
        tables.evolve_table(spark.createDataFrame([(1, 2)], "id long, kind long"), name)
    with pytest.raises(Exception):
        tables.read_table(spark, name, ["absent"]).collect()
    spark.sql(f"drop table {name}")
