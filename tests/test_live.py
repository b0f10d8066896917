"""Streams whose results are right after every trigger; renewed memory of ids; refunds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.streaming import events, live, memory, refunds

START = datetime(2024, 1, 1)
MESSAGES = "conversation_id string, timestamp timestamp"
ERRORS = "error_hash string, timestamp timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture
def source(spark, tmp_path):
    """Adds a file of rows; and the stream of all files."""

    class Source:
        def __init__(self, schema, name="in"):
            self.schema, self.folder = schema, str(tmp_path / name)
            spark.createDataFrame([], schema).write.parquet(self.folder)

        def add(self, rows):
            spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

        def stream(self):
            return spark.readStream.schema(self.schema).parquet(self.folder)

    return Source


def repeated(rows):
    counts = {}
    for h, t in rows:
        hour = t.replace(minute=0, second=0, microsecond=0)
        for k in range(6):
            key = (hour - timedelta(hours=k), h)
            counts[key] = counts.get(key, 0) + 1
    return {k: n for k, n in counts.items() if n > 3}


def test_windows_after_every_trigger(spark, source, tmp_path):
    rng = random.Random(2)
    files = source(ERRORS)
    table = live.window_table(str(tmp_path / "out"), "errors", ("window_start", "error_hash"))
    seen = []
    for turn in range(3):
        rows = [(rng.choice("abc"), at(600 * turn + rng.randrange(600))) for _ in range(60)]
        rows += [("hot", at(600 * turn + rng.randrange(600))) for _ in range(30)]
        files.add(rows)
        seen += rows
        stream = events.repeated_errors(files.stream(), late="12 hours")
        live.keep_windows(stream, table, str(tmp_path / "check")).awaitTermination()
        got = {(r["window_start"], r["error_hash"]): r["repeticoes"] for r in live.current(spark, table).collect()}
        assert got == repeated(seen)  # open windows as they stand
    latest = spark.read.parquet(table.watermark_path).agg(F.max("watermark")).first()[0]
    wrong = live.current(spark, table).withColumn("repeticoes", F.lit(99).cast("long"))
    live.apply_batch(wrong, latest, table)  # a replayed batch id
    assert {(r["window_start"], r["error_hash"]): r["repeticoes"] for r in live.current(spark, table).collect()} == got
    assert live.current(spark, table).agg(F.max("window_start")).first()[0] < at(3000)


def plain_sessions(rows, gap=120):
    found, by = {}, {}
    for c, t in rows:
        if c is not None and t is not None:
            by.setdefault(c, []).append(t)
    for c, times in by.items():
        start = last = None
        for t in sorted(times):
            if last is None or t >= last + timedelta(minutes=gap):
                start = t
                found[c, start] = [t, 0]
            last = t
            found[c, start] = [t, found[c, start][1] + 1]
    return {(c, s, e + timedelta(minutes=gap), n) for (c, s), (e, n) in found.items()}


def test_sessions_after_every_trigger(spark, source, tmp_path):
    """Late messages join sessions; a silence of exactly the gap does not; half of all in one conversation."""
    rng = random.Random(8)
    rows = [("c", at(0)), ("c", at(120)), ("c", at(241)), ("c", at(239.999)), (None, at(5)), ("n", None)]
    rows += [(rng.choice(["hot", "hot", *"defg"]), at(30 * rng.randrange(200))) for _ in range(400)]
    rng.shuffle(rows)
    files = source(MESSAGES)
    table = live.session_table(str(tmp_path / "out"), parts=4)
    for k in range(4):
        files.add(rows[k * 101 : (k + 1) * 101])
        live.keep_sessions(files.stream(), table, str(tmp_path / "check")).awaitTermination()
        got = {tuple(r) for r in live.sessions_now(spark, table).collect()}
        assert got == plain_sessions(rows[: (k + 1) * 101])
    plain = events.sessions(spark.createDataFrame(rows[:404], MESSAGES).where("conversation_id is not null and timestamp is not null"))
    assert {tuple(r) for r in plain.collect()} == got
    # a batch that is replayed after its partitions were written, but before the log
    batch = spark.createDataFrame(rows[303:404], MESSAGES)
    last = live.incremental.watermark(spark, table)
    once = live.session_table(str(tmp_path / "out2"), parts=4)
    for n, part in enumerate((rows[:303], rows[303:404])):
        live.merge_sessions(spark.createDataFrame(part, MESSAGES), n, once, "timestamp", timedelta(minutes=120))
    log = spark.read.parquet(once.watermark_path).where("watermark < 1").collect()
    spark.createDataFrame(log, spark.read.parquet(once.watermark_path).schema).write.parquet(str(tmp_path / "log"))
    import shutil

    shutil.rmtree(once.watermark_path)
    shutil.move(str(tmp_path / "log"), once.watermark_path)
    live.merge_sessions(batch, 1, once, "timestamp", timedelta(minutes=120))
    assert {tuple(r) for r in live.sessions_now(spark, once).collect()} == got and last == 3


def test_memory_is_renewed(spark, source, tmp_path):
    """A repeat at hour 20 keeps the id known at hour 40; exactly 24 hours is still a repeat."""
    files = source("id string, received_at timestamp")
    hours = {"a": [0, 20, 40, 65], "b": [0, 24, 48.001], "c": [0, 24.001], "d": [1]}
    rows = [(k, at(60 * h)) for k, times in hours.items() for h in times]
    kept = []
    for low, high in ((0, 21), (21, 45), (45, 100)):
        files.add([r for r in rows if at(60 * low) <= r[1] < at(60 * high)])
        out = memory.dedup_renewed(files.stream(), time="received_at")
        events.write_available(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    kept = {(r["id"], r["received_at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kept == {("a", at(0)), ("a", at(65 * 60)), ("b", at(0)), ("b", at(48.001 * 60)), ("c", at(0)),
                    ("c", at(24.001 * 60)), ("d", at(60))}
    rule = memory.first_arrivals(spark.createDataFrame(rows, "id string, received_at timestamp"))
    assert {tuple(r) for r in rule.collect()} == kept


def test_memory_in_any_state_store(spark, source, tmp_path):
    """The session's store need not know column families; null ids are one id, rows without a time none."""
    files = source("id string, received_at timestamp")
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        for rows in ([("a", at(0)), ("a", at(1)), (None, at(2)), ("b", None)], [("a", at(1441)), (None, at(1443)), (None, at(9000))]):
            files.add(rows)
            out = memory.dedup_renewed(files.stream(), time="received_at")
            events.write_available(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    finally:
        spark.conf.set(name, own)
    kept = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(kept, key=str) == sorted([("a", at(0)), (None, at(2)), (None, at(1443)), (None, at(9000))], key=str)


def test_memory_is_shared_by_many_ids(spark, source, tmp_path, monkeypatch):
    """Ids are remembered in groups, so the Python calls do not grow with the ids; the rule is that of single ids."""
    monkeypatch.setattr(memory, "GROUPS", 8)
    draw = random.Random(41)
    files = source("id string, received_at timestamp")
    ids = [f"k{i}" for i in range(400)] + [None]
    rows = [(draw.choice(ids), at(draw.randrange(0, 9000) + draw.choice((0, 0.001)))) for _ in range(3000)]
    rows = list({(k, t): (k, t) for k, t in rows}.values())
    for low, high in ((0, 2000), (2000, 2100), (2100, 7000), (7000, 9001)):
        files.add([r for r in rows if at(low) <= r[1] < at(high)])
        out = memory.dedup_renewed(files.stream(), time="received_at")
        run = events.write_available(out, str(tmp_path / "out"), str(tmp_path / "check"))
        run.awaitTermination()
        assert all(p["stateOperators"][0]["numRowsTotal"] <= 8 for p in run.recentProgress)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    rule = memory.first_arrivals(spark.createDataFrame(rows, "id string, received_at timestamp"))
    assert got == sorted(map(tuple, rule.collect()), key=str) and len(got) > 800


def test_refunds_on_both_sides_of_the_limit(spark, source, tmp_path):
    bought, back = source("order_id long, purchased_at timestamp", "p"), source("order_id long, refunded_at timestamp", "r")
    bought.add([(1, at(0)), (2, at(10)), (3, at(20)), (4, at(30))])
    back.add([(1, at(24 * 60)), (2, at(10 + 24 * 60 + 0.001)), (4, at(29))])

    def run():
        rows = refunds.with_refund(bought.stream(), back.stream(), late="2 hours", late_refunds="2 hours")
        events.write_available(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    run()
    back.add([(3, at(20 + 23 * 60)), (3, at(21 + 23 * 60))])  # late, within the watermark, and twice
    run()
    bought.add([(9, at(9000))])
    back.add([(8, at(9000))])
    run()
    got = {r["order_id"]: r["refunded"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 4
    rates = refunds.refund_rates(rows, "24 hours", "24 hours").collect()
    assert [(r["purchases"], r["refunded"], r["refund_rate"]) for r in rates] == [(4, 2, 0.5)]
    assert refunds.refund_alerts(refunds.refund_rates(rows), 50.0).count() == 0
