"""Keyed incremental load: batches with late, repeated and deleted versions."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from parlance.sources import incremental
from parlance.sources.incremental import KeyedTable

SCHEMA = "id long, kind string, at timestamp, removed boolean, amount double"
START = datetime.datetime(2024, 1, 1)


def files_of(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path) for f in names if f.startswith("part-")
    }


@pytest.fixture
def table(tmp_path):
    return KeyedTable(
        str(tmp_path / "lake"), "accounts", ("id", "kind"), "at", "removed", parts=8,
        lookback=datetime.timedelta(days=2),
    )


def living(spark, table):
    return sorted(tuple(r) for r in incremental.current(spark, table).collect())


def expected(rows):
    best = {}
    for r in rows:
        if r[0] is None or r[1] is None or r[2] is None:
            continue
        state = (r[2], bool(r[3]), r[4])
        best[r[:2]] = max(best.get(r[:2], state), state)
    return sorted((*k, s[0], s[1], s[2]) for k, s in best.items() if not s[1])


def test_batches_equal_the_union(spark, table, tmp_path):
    rng = random.Random(5)
    rows = []
    for n in range(2000):
        day = n / 100
        key = 7 if rng.random() < 0.33 else rng.randrange(300)
        rows.append((key, rng.choice("ab"), START + datetime.timedelta(days=day), rng.random() < 0.1, float(n)))
    rows += [(None, "a", START, False, 1.0), (1, None, START, False, 1.0), (2, "a", None, False, 1.0)]
    late = [r for r in rows if r[2] and rng.random() < 0.1]
    arrives = lambda r: r[2] + datetime.timedelta(days=1.5 if r in late else 0) if r[2] else START
    seen = []
    for upto in (5, 12, 25):
        limit = START + datetime.timedelta(days=upto)
        batch = [r for r in rows if arrives(r) < limit]  # the source keeps its earlier rows
        seen.append(len(batch))
        source = str(tmp_path / f"source{upto}")
        spark.createDataFrame(batch, SCHEMA).repartition(3).write.parquet(source)
        report = incremental.load(spark.read.parquet(source), table).first()
        assert living(spark, table) == expected(batch)
        assert report["watermark"] == max(r[2] for r in batch if r[2])
    assert report["read"] < seen[-1] - seen[0]  # rows below the watermark are not read again
    before = files_of(table.path)
    again = incremental.load(spark.read.parquet(source), table).first()
    assert (again["inserted"], again["changed"], again["deleted"], again["parts"]) == (0, 0, 0, 0)
    assert again["stale"] > 0 and files_of(table.path) == before


def test_untouched_partitions_keep_their_files(spark, table):
    day = lambda n: START + datetime.timedelta(days=n)
    first = [(n, "a", day(0), False, 1.0) for n in range(200)]
    incremental.load(spark.createDataFrame(first, SCHEMA), table)
    before = files_of(table.path)
    change = [(5, "a", day(1), False, 2.0), (500, "a", day(1), False, 2.0), (6, "a", day(1), True, None)]
    report = incremental.load(spark.createDataFrame(change, SCHEMA), table).first()
    assert (report["inserted"], report["changed"], report["deleted"]) == (1, 1, 1)
    after = files_of(table.path)
    parts = lambda files: {f.split("_part=")[1].split("/")[0] for f in files}
    touched = {
        str(r[0]) for r in spark.createDataFrame(change, SCHEMA).select(table.partition()).collect()
    }
    assert parts(f for f in after if before.get(f) != after[f]) == touched
    assert all(after.get(f) == t for f, t in before.items() if parts([f]).isdisjoint(touched))
    assert report["parts"] == len(touched) < 8
    # an older version of the deleted key, inside the lookback, does not bring it back
    old = [(6, "a", day(0.5), False, 9.0)]
    report = incremental.load(spark.createDataFrame(old, SCHEMA), table).first()
    assert report["stale"] == 1 and (6,) not in {r[:1] for r in living(spark, table)}
    back = [(6, "a", day(2), False, 3.0)]
    assert incremental.load(spark.createDataFrame(back, SCHEMA), table).first()["inserted"] == 1


def test_order_of_equal_versions_does_not_matter(spark, tmp_path):
    one, two = (1, "a", START, False, 1.0), (1, "a", START, False, 2.0)
    for k, order in enumerate([(one, two), (two, one)]):
        table = KeyedTable(str(tmp_path / f"l{k}"), "e", ("id", "kind"), "at", "removed", lookback=datetime.timedelta(0))
        for row in order:
            incremental.load(spark.createDataFrame([row], SCHEMA), table)
        assert living(spark, table) == [two]


def test_watermark_reaches_the_scan(spark, table, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(1, "a", START, False, 1.0)], SCHEMA).write.parquet(source)
    incremental.load(spark.read.parquet(source), table)
    mark = incremental.watermark(spark, table)
    plan = incremental.changed_rows(spark.read.parquet(source), table, mark)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at,2023-12-30" in plan.split("PushedFilters")[1]
    with pytest.raises(ValueError):
        incremental.load(spark.read.parquet(source).withColumn("more", F.lit(1)), table)


def test_empty_source(spark, table):
    report = incremental.load(spark.createDataFrame([], SCHEMA), table).first()
    assert report["read"] == 0 and incremental.watermark(spark, table) is None
    assert incremental.current(spark, table).count() == 0


def test_rows_are_written_once(spark, table, monkeypatch):
    """Nothing is written beside the table for its first rows, later only the batch; a partition is
    rewritten by several tasks."""
    aside = []
    real = incremental.written_once
    monkeypatch.setattr(
        incremental, "written_once", lambda df, name: aside.append(real(df, name)) or aside[-1]
    )
    first = [(n % 400, "a", START + datetime.timedelta(days=n // 400), n % 9 == 0, 1.0) for n in range(800)]
    monkeypatch.setattr(incremental, "FIRST", 1, raising=False)
    report = incremental.load(spark.createDataFrame(first, SCHEMA).repartition(40), table).first()
    assert not aside and living(spark, table) == expected(first)
    assert (report["read"], report["inserted"], report["parts"]) == (800, len(expected(first)), 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        later = [(n, "a", START + datetime.timedelta(days=5), False, 2.0) for n in range(300, 350)]
        incremental.load(spark.createDataFrame(later, SCHEMA), table)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert living(spark, table) == expected(first + later)
    assert {df.count() for df in aside} == {50}
    files = [f.split("_part=")[1].split("/")[0] for f in files_of(table.path)]
    assert len(set(files)) == 8 and len(files) > 16


def test_equal_versions_of_many_keys(spark, table):
    """Rows that agree in the version: the larger state stays, whichever comes first."""
    rows = lambda amount, gone: [(n, "a", START, n % 3 == gone, amount) for n in range(60)]
    for batch in (rows(2.0, 0), rows(1.0, 1), rows(2.0, 0)):
        report = incremental.merge(spark.createDataFrame(batch, SCHEMA), table).first()
    assert living(spark, table) == expected(rows(2.0, 0) + rows(1.0, 1))
    assert (report["inserted"], report["changed"], report["deleted"], report["stale"]) == (0, 0, 0, 60)
