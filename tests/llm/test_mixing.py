"""Mixing: targets against the stated rule, sums against the best reachable."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import common, mixing


def weight():
    return F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("source_rank") % 3 + 1)



def mix(docs):
    return mixing.mix(docs, common.word_count(F.col("text")), weight())


def shared(sizes: dict, budget: float) -> dict:
    """Excess over twice a source's size is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), budget
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_whole_table(docs):
    rows = mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    want = shared(sizes, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for source, total in sizes.items():  # few documents a source: compare with the nearest sum
        sums = {0}
        for r in rows:
            sums |= {x + r["size"] for x in sums} if r.source == source else set()
        best = min(abs(x + k * total - want[source]) for x in sums for k in (0, 1))
        assert abs(taken[source] - want[source]) <= best + 1
    texts = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == texts
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, mix(docs.repartition(7)).collect()))


def test_counts_are_as_near_as_any_choice():
    draw = np.random.default_rng(3)
    for _ in range(200):
        lengths = np.array(sorted(draw.choice(np.arange(1, 40), 3, replace=False)))
        counts = draw.integers(1, 5, 3)
        budget = int(draw.integers(0, lengths @ counts + 10))
        got = mixing.fit_counts(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        best = min(
            abs(budget - sum(a * b for a, b in zip(pick, lengths)))
            for pick in itertools.product(*(range(c + 1) for c in counts))
        )
        assert abs(budget - int(got @ lengths)) == best


def test_large_budget_is_met():
    lengths, counts = np.arange(1, 3000), np.full(2999, 400)
    for budget in (1, 77_777, 123_456_789, 1_000_000_007):
        assert int(mixing.fit_counts(lengths, counts, budget) @ lengths) == budget


def test_hot_length_is_ranked_in_slices(make):
    rows = [(i, "a b c", "en", "s", 5) for i in range(9000)] + [
        (10_000 + i, "a " * (i + 4), "en", "t", 0) for i in range(50)
    ]
    got = mix(make(rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"))
    assert all(abs(r.t - r.g) <= 3 for r in got.collect())


def test_odd_rows(odd, none):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {"a", "b", "c", None}
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mix(none).collect() == []
