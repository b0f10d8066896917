"""Spelling variants against comparing every word with every other."""

import collections
import re
import zlib

import numpy as np
import pytest

from parlance.llm import spelling
from parlance.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def counts_of(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def wanted(counts):
    form, near = {}, {}
    names = sorted(counts)
    by_size = collections.defaultdict(list)
    for w in names:
        by_size[len(w)].append(w)
    for w in names:
        found = [x for s in (-1, 0, 1) for x in by_size[len(w) + s] if one_edit(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w in names:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], near[w], counts.get(form[w])))
    return rows


def test_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = wanted(counts_of([tuple(r) for r in rows]))
    out = QUERIES["op12_spelling_variants"](spark, SMALL)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [2048, 3])
def test_made_words_by_brute_force(spark, monkeypatch, block):
    """Dense words of few letters, accents among them, in one block and in many; ties and chains."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = np.random.default_rng(3)
    counts = {}
    while len(counts) < 400:
        word = "".join(rng.choice(list("abeéÀ×"), rng.integers(5, 9)))
        counts[word] = int(rng.choice([5, 5, 30, 30, 160, 900, 5000]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = {tuple(r) for r in spelling.variants(words).collect()}
    want = wanted(counts)
    assert got == want and any(r[1] and r[2] != r[1] for r in want)


def test_near_pairs():
    left, right = ["abcdef", "aaaaaa", "x" * 300], ["abcdefg", "bbcdef", "fedcba", "aaaaaa", "x" * 299, "abdcef"]
    i, j = spelling.near_pairs(left, right)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (2, 4)]


def test_odd_rows(spark, odd, none, make):
    got = {tuple(r) for r in spelling.spelling_variants(odd).collect()}
    assert got == wanted(counts_of([tuple(r) for r in odd.select("doc_id", "text").collect()]))
    assert spelling.spelling_variants(none).count() == 0
    giant = "z" * 50_000
    rows = [(k, f"ÉCOLES {giant} écoles", "fr", "a", 1) for k in range(6)] + [(None, None, None, None, None)]
    got = {r["word"]: r["n"] for r in spelling.spelling_variants(make(rows)).collect()}
    assert got == counts_of([(r[0], r[1]) for r in rows]) and giant in got
