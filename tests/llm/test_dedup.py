"""Near-duplicate texts, repeated passages and near-duplicate vectors against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from parlance.llm import embedding_dedup, minhash_dedup, substring_dedup
from parlance.llm.common import components


def words(text):
    return tuple((text or "").encode().split())


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similarity(a, b):
    x, y = (Counter(w[i : i + 5] for i in range(len(w) - 4)) for w in (a, b))
    common = sum((x & y).values())
    union = sum((x | y).values())
    return common / union if union else 0.0


def near_classes(rows):
    """doc_id -> smallest id linked, by comparing all pairs."""
    ids = [r[0] for r in rows]
    pairs = [
        (a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i]
        if words(a[1]) and (words(a[1]) == words(b[1]) or similarity(words(a[1]), words(b[1])) >= 0.8)
    ]
    return classes(pairs, ids)


def edited(draw, base, most):
    w = list(base)
    for _ in range(int(draw.integers(0, most + 1))):
        w[int(draw.integers(len(w)))] = f"e{draw.integers(1000)}"
    return " ".join(w)


def test_near_duplicates_by_brute_force(make):
    draw = np.random.default_rng(4)
    rows = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(int(draw.integers(40, 90)))]
        rows += [edited(draw, base, 8) for _ in range(25)]
    rows += [" ".join(["again"] * n) for n in (5, 6, 7, 8, 30, 31)] + ["a b c", "a  b c", "a b", "x", "x "]
    rows = [(int(i), t, "en", "s", 0) for i, t in zip(draw.permutation(len(rows)), rows)]
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(make(rows)).collect()}
    want = near_classes(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values())


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(8)
    values = draw.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = draw.integers(1, 20, (2, 60))
    owner = np.repeat(np.arange(2), 60)
    hits = []
    for k in range(60):
        keys = minhash_dedup.mixed(values + np.uint64(k * 7919))
        s = minhash_dedup.signatures(owner, np.tile(keys, 2), np.concatenate([a, b]), 2)
        assert (s != 0).all()
        hits.append((s[0] == s[1]).mean())
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(np.mean(hits) - want) < 4 * math.sqrt(want * (1 - want) / 60 / minhash_dedup.REGISTERS)


def test_block_links_connect_what_pairs_connect():
    draw = np.random.default_rng(9)
    base = [f"w{k}" for k in range(40)]
    texts = sorted({edited(draw, base, 6) for _ in range(60)})
    frame = pd.DataFrame({"node": range(len(texts)), "root": range(len(texts)), "text": texts})
    frame["root"] = frame["node"].where(frame["node"] % 3 > 0, 0)  # some are one class already
    found = minhash_dedup.block_links(frame, 0.8)
    given = [(n, 0) for n in range(0, len(texts), 3)]
    true = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if similarity(words(texts[i]), words(texts[j])) >= 0.8
    ]
    ours = classes(given + [tuple(x) for x in found.to_numpy()], range(len(texts)))
    assert ours == classes(given + true, range(len(texts)))
    got = minhash_dedup.similarities(pa.array(texts[:20]), pa.array(texts[20:40]))
    assert np.allclose(got, [similarity(words(x), words(y)) for x, y in zip(texts[:20], texts[20:40])])


def removed_by_rule(rows, window=50):
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for p in range(len(w) - window + 1):
            first.setdefault(w[p : p + window], i)
    result = {}
    for i, text in rows:
        w = words(text)
        gone = {
            p + k for p in range(len(w) - window + 1) if first[w[p : p + window]] < i for k in range(window)
        }
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        result[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return result


@pytest.mark.parametrize("window", [50, 7])
def test_substrings_by_brute_force(make, window):
    draw = np.random.default_rng(window)
    passages = [[f"p{n}w{k}" for k in range(int(draw.integers(5, 90)))] for n in range(8)]
    texts = []
    for n in range(150):
        text = []
        for _ in range(int(draw.integers(0, 4))):
            text += [f"own{n}x{draw.integers(40)}" for _ in range(int(draw.integers(0, 30)))]
            text += passages[int(draw.integers(8))]
        texts.append(" \t".join(text))
    texts += ["same " * 60, "same " * 55, "same " * 49]  # one word over and over
    rows = [(int(i), t) for i, t in zip(draw.permutation(len(texts)), texts)]
    found = substring_dedup.remove_repeats(make([(*r, "en", "s", 0) for r in rows]), window=window)
    got = {
        r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
        for r in found.collect()
    }
    assert got == removed_by_rule(rows, window)


def test_a_passage_in_every_document(make):
    """Its runs of words are hot, so they are minimisers only where a window has no other."""
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(20))} {passage} b{i}") for i in range(600)]
    found = substring_dedup.remove_repeats(make([(*r, "en", "s", 0) for r in rows]))
    got = {
        r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
        for r in found.collect()
    }
    assert got == removed_by_rule(rows)


def test_equal_hashes_are_told_apart(monkeypatch):
    strings = ["a b c d", "a b c d", "b b c d", "a b x d"]
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: np.zeros(len(x), np.uint64))
    records = np.array([(i, 100 + i, 0, 1, 7) for i in range(4)], np.int64)
    found = substring_dedup.repeated(records, pa.array(strings, pa.large_string()), 4)
    assert found.to_numpy().tolist() == [[1, 101, 0, 4]]


def test_sliding_min():
    draw = np.random.default_rng(2)
    values = draw.integers(0, 99, 50)
    for size in range(1, 51):
        want = [values[i : i + size].min() for i in range(50 - size + 1)]
        assert substring_dedup.sliding_min(values, size).tolist() == want


def test_components(spark):
    draw = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (180, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    true = [p for p in pairs if None not in p]
    want = classes(true, {x for p in true for x in p})
    assert got == {n: want[n] for n in got} and {n for p in true if p[0] != p[1] for n in p} == set(got)


def near_by_rule(rows, least):
    good = {}
    for i, v, label in rows:
        if label is None or i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(v):
            good[i] = (np.array(v, float), label)
    links = defaultdict(set)
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a != b and la == lb and len(x) == len(y):
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
    roots = classes([(a, b) for a in links for b in links[a]], [r[0] for r in rows])
    return {r[0]: (len(links[r[0]]), roots[r[0]]) for r in rows}


def test_vectors_by_brute_force(make, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 20)  # many cells, many blocks
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(7)
    rows = []
    for n in range(60):
        center = draw.normal(size=8)
        for _ in range(int(draw.integers(1, 9))):
            rows.append(([float(x) for x in center + draw.normal(0, 0.25, 8)], int(draw.integers(2))))
    rows += [rows[0]] * 40  # copies
    bad = [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [None] + [1.0] * 7, [math.inf] + [0.0] * 7]
    rows += [(v, 0) for v in bad] + [(rows[0][0], None), (rows[0][0][:4], rows[0][1])]
    rows = [(int(i), *r) for i, r in zip(draw.permutation(len(rows)), rows)]
    df = make(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == near_by_rule(rows, 0.93)


def test_cells_hold_all_partners():
    draw = np.random.default_rng(3)
    v = embedding_dedup.unit(draw.normal(size=(400, 5)))
    home, near = embedding_dedup.cells(v, v[:25], math.sqrt(2 - 2 * 0.93))
    a, b = np.nonzero(v @ v.T >= 0.93)
    assert near[a, home[b]].all() and not near.all()


def test_odd_rows(odd, none, make):
    found = {(r.doc_id, r.row_key): r for r in minhash_dedup.near_duplicates(odd).collect()}
    assert minhash_dedup.near_duplicates(odd).count() == odd.count()
    by_id = defaultdict(list)
    for (i, _), r in found.items():
        by_id[i].append(r)
    assert [r.class_id for r in by_id[6]] == [5] and not by_id[6][0].kept and by_id[5][0].kept
    assert all(by_id[i][0].kept for i in (1, 2, 3, 4, 9)) and [r.class_id for r in by_id[8]] == [7]
    assert minhash_dedup.near_duplicates(none).collect() == []

    cut = substring_dedup.remove_repeats(odd, keep=("text",), untouched=True).collect()
    assert len(cut) == odd.count()
    for r in cut:
        if r.doc_id == 6:
            assert r.n_removed == 20_000 and r.kept_text == "tail"
        else:
            assert r.n_removed == 0 and r.kept_text == r.text
    assert substring_dedup.remove_repeats(none).collect() == []

    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 1)]
    df = make([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, size int")
    near = embedding_dedup.near_vectors(df).collect()
    assert len(near) == 4 and {(r.vec_id, r.component_id) for r in near} == {(None, None), (1, 1), (2, 1)}
    empty = make([], "vec_id long, embedding array<float>, label int", 1)
    assert embedding_dedup.near_vectors(empty).collect() == []


def test_vectors_of_any_length(make):
    """Lengths whose squares are no double: the cosine counts all the same."""
    rows = [
        (1, "a", [1e200, 2e200]), (2, "a", [1.0, 2.0]), (3, "a", [1e-200, 2e-200]), (4, "a", [5e-324, 1e-323]),
        (5, "b", [1e-200, 1e-200]), (6, "b", [1.0, 0.01]), (7, "b", [1e308, 1e306]),
    ]
    found = embedding_dedup.near_vectors(make(rows, "vec_id long, label string, embedding array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_passages_texts_travel_squeezed(spark):
    """Texts meet their spans as squeezed bytes, not as text; null, empty and uniform ones come back."""
    rng = random.Random(3)
    some = [" ".join(f"w{rng.randrange(4000)}" for _ in range(400)) for _ in range(30)]
    texts = [*some, None, "", "  ", "a " * 300_000, some[0] + " end", some[1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring_dedup.remove_repeats(rows, untouched=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan.split("Join LeftOuter")[1]
    assert "text#" in plan and "squeeze(" in join.replace("\n", " ")
    got = {r["doc_id"]: r for r in found.collect()}
    assert [got[i]["kept_text"] for i in range(34)] == texts[:34]
    assert got[34]["kept_text"] == "end" and got[35]["kept_text"] == ""
    common = "\n".join(some[:8]).encode()
    batch = pa.RecordBatch.from_pydict({
        "order": pa.array(range(20)), "key": pa.array(range(20)), "text": pa.array(some[:20]),
    })
    size = lambda *more: sum(len(x) for _, _, x in substring_dedup.pack(batch, 50, 500, np.empty(0, np.uint64), *more))
    assert size(common) < 0.9 * size()


def test_vectors_in_rounds(make, monkeypatch):
    """Vectors that no bound keeps apart go to every cell: a round shuffles a bounded number of copies,
    and the copies are not stored; the links are those of all pairs."""
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    tables = []
    stored = embedding_dedup.stored

    def kept(df, name, **more):
        tables.append((name, stored(df, name, **more)))
        return tables[-1][1]

    monkeypatch.setattr(embedding_dedup, "stored", kept)
    draw = np.random.default_rng(31)
    rows = [([float(np.float32(x)) for x in draw.normal(size=16)], int(draw.integers(2))) for _ in range(420)]
    rows += [([float(np.float32(x + 0.01)) for x in v], l) for v, l in rows[:60]] + rows[:5]
    rows = [(i, *r) for i, r in enumerate(rows)]
    found = embedding_dedup.near_vectors(make(rows, "vec_id long, embedding array<float>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == near_by_rule(rows, 0.93) and sum(n for n, _ in got.values()) >= 120
    assert [n for n, _ in tables].count("vector-links") > 4
    wide = [n for n, t in tables if "vec" in t.columns]
    assert wide == ["distinct-vectors"] and "array<float>" in dict(tables[0][1].dtypes).values()
    links = [t for n, t in tables if n == "vector-links"][-1]
    assert links.where("a is null and links = 0").count() == 0
