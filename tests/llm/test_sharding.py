"""Shards: exact quotas, gapless slots, groups kept together as far as the quotas allow."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import sharding


def laws(out, shards, total):
    """Counts at most one apart, slots 0, 1, ... in each shard; returns shard -> rows."""
    slots = {}
    for r in out.collect():
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert sum(counts) == total and set(slots) <= set(range(shards))
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return slots


def test_whole_table(spark, docs):
    out = sharding.shard_documents(docs, 40)
    laws(out, 40, docs.count())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out.collect():
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    again = sharding.shard_documents(docs.repartition(5), 40)
    assert sorted(map(tuple, again.drop("grown_shard").collect())) == sorted(map(tuple, out.drop("grown_shard").collect()))


def test_groups_stay_together(make):
    """Copies of 2 to 30 among other rows: all fit, so no link is cut."""
    rows, i = [], 0
    for size in [2] * 60 + [3] * 40 + [11] * 6 + [30] * 3 + [1] * 400:
        text = f"text {i}"
        for _ in range(size):
            rows.append((i, text, "en", "a", 1))
            i += 1
    out = sharding.shard_documents(make(rows), 8)
    laws(out, 8, len(rows))
    cut = sharding.cut_links(out.withColumn("group", F.col("text_crc32"))).first()
    assert cut["links"] == 60 + 80 + 60 + 87 and cut["cut"] == 0


def test_hot_group_fills_shards(make):
    """A third of all rows in one group, and no row without links that could fill gaps: ten of the
    thirty shards can hold it, and get nearly all of it; nearly all pairs stay together."""
    rows = [(i, "hot", "en", "a", 1) for i in range(1000)]
    rows += [(1000 + i, f"pair {i // 2}", "en", "a", 1) for i in range(2000)]
    out = sharding.shard_documents(make(rows), 30)
    laws(out, 30, 3000)
    parts = sorted((r["count"] for r in out.where("size = 19").groupBy("shard").count().collect()), reverse=True)
    assert sum(parts[:10]) >= 950
    cut = sharding.cut_links(out.where("size <> 19").withColumn("group", F.col("text_crc32"))).first()
    assert cut["cut"] <= 0.15 * cut["links"]


def test_links_of_any_kind(spark):
    """Links as pairs: chains are groups."""
    rows = spark.range(300).select(F.col("id").alias("pos"))
    links = rows.where("pos % 5 < 4").select(F.col("pos").alias("a"), (F.col("pos") + 1).alias("b"))
    grouped = sharding.linked_groups(rows, links)
    found = sharding.propagate(grouped, 6).join(grouped, "pos")
    assert sorted(r["count"] for r in found.groupBy("shard").count().collect()) == [50] * 6
    cut = sharding.cut_links(found).first()
    assert cut["links"] == 240 and cut["cut"] <= 8


def test_granted_by_brute_force():
    """No shard beyond its room; refused bundles are the later ones; moves out make room."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        shards = int(rng.integers(2, 6))
        room = rng.integers(0, 10, shards)
        n = int(rng.integers(1, 30))
        to = rng.integers(0, shards, n)
        moves = np.stack([np.arange(n), to, (to + rng.integers(1, shards, n)) % shards], 1)
        sizes = rng.integers(1, 5, n)
        yes, refusing = sharding.granted(room, moves, sizes)
        net = np.zeros(shards, int)
        for (bundle, target, source), size in zip(moves, sizes):
            if yes[bundle]:
                net[target] += size
                net[source] -= size
        assert (net <= room).all()
        assert all(refusing[moves[k, 1]] for k in range(n) if not yes[k])
    yes, refusing = sharding.granted(np.array([0, 0]), np.array([[0, 0, 1], [1, 1, 0]]), np.array([3, 3]))
    assert yes.all() and not refusing.any()


def test_positions_of_equal_rows(spark, monkeypatch):
    """Rows of one order are many: they are spread over tasks and still numbered without gaps."""
    monkeypatch.setattr(sharding, "RUN", 16)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id")).cast("long").alias("order"), F.col("id").alias("row")
    )
    found = sharding.placed(rows, 3000)
    assert sorted(r["pos"] for r in found.collect()) == list(range(3000))


def test_odd_rows(odd, none, make):
    out = sharding.shard_documents(odd, 4)
    laws(out, 4, odd.count())
    assert out.where("size = 16").count() == odd.where("text is null or text = ''").count()
    assert sharding.shard_documents(none, 40).count() == 0
    one = sharding.shard_documents(make([(1, "a", "en", "a", 1)]), 40).collect()
    assert len(one) == 1 and one[0]["slot"] == 0
