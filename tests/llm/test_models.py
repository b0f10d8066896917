"""LM scoring and SentencePiece: brute force, normalisation, exact round trips."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from parlance.llm import lm_scoring as lm
from parlance.llm import pieces as sp
from parlance.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*low.encode().split(), "end"]


def test_scores_by_brute_force(docs):
    rows = docs.collect()
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    counts = Counter(t for r in rows if not held[r.doc_id] for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in rows:
        t, g = tokens(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.train_tokens) == (held[r.doc_id], len(t), n)
        assert g.n_known == sum(counts[x] > 0 for x in t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert g.score < 0
    total = {k: sum(getattr(g, k) for g in got.values()) for k in ("score", "base_score")}
    assert total["score"] > total["base_score"]


def small_items(words=30, tails=6):
    draw = np.random.default_rng(4)
    return lm.Items(np.sort(draw.integers(3, 200, words))[::-1], draw.integers(0, 40, tails).astype(float))


def test_items_cover_all_tokens_once():
    items = small_items()
    codes = np.concatenate([items.own, items.tail])
    assert sorted(codes.tolist()) == list(range(36)) and items.chance.sum() == pytest.approx(1)
    assert (np.diff(items.chance[:36]) <= 0).all() and items.clusters * items.width >= 36
    assert items.of_cluster.sum() == pytest.approx(1)


def plain_log_chance(model, items, word, before):
    """Softmax over clusters, then over the items of the cluster, in plain loops."""
    q = [sum(float(model.before[before[p]][d] * lm.WEIGHTS[p]) for p in range(lm.PLACES)) for d in range(lm.DIMENSION)]

    def score(row):
        return sum(x * float(y) for x, y in zip(q, row[:-1])) + float(row[-1])

    cluster = word // items.width
    clusters = [score(r) for r in model.top]
    inside = [score(model.out[i]) for i in range(cluster * items.width, min((cluster + 1) * items.width, items.size))]
    return (
        clusters[cluster] - math.log(sum(map(math.exp, clusters)))
        + score(model.out[word]) - math.log(sum(map(math.exp, inside)))
    )


def test_model_by_brute_force_and_learns():
    """A cycle of seven words is learned; chances are those of the definition, and sum to one."""
    items = small_items()
    trainer = lm.Trainer(items, lm.Model.start(items).flat(), 3)
    word = np.arange(4096) % 7 * 5  # in several clusters
    before = lm.contexts(word, np.array([4096]), items.size)
    for _ in range(60):
        trainer.step(word, before)
    model = trainer.model
    every = np.arange(items.size)
    for context in ([0, 30, 25, 20, 15], [items.size] * 5, [3, 1, 4, 1, 5]):
        context = np.array(context[: lm.PLACES])
        logs = model.log_chances(every, np.repeat(context[:, None], items.size, 1))
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-5)
        want = [plain_log_chance(model, items, int(w), context) for w in every]
        assert logs == pytest.approx(np.array(want), abs=1e-4)
    after = model.log_chances(np.array([5]), np.array([[0], [30], [25], [20], [15]])[: lm.PLACES])
    assert np.exp(after[0]) > 0.5


def test_contexts():
    found = lm.contexts(np.array([5, 6, 7, 8, 9]), np.array([3, 1, 1]), 99)
    assert found[0].tolist() == [99, 5, 6, 99, 99] and found[1].tolist() == [99, 99, 5, 99, 99]
    assert (found[2:] == 99).all()


def test_scores_do_not_depend_on_the_split(docs, monkeypatch):
    """One partition or sixteen, and shards that do not fit a step: the same scores."""
    monkeypatch.setattr(lm, "SCORED", 500)
    one, many = (
        {(r.doc_id, r.n_tokens): r for r in lm.score_texts(docs.repartition(n)).collect()} for n in (1, 16)
    )
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert r.score == pytest.approx(many[k].score, rel=1e-9)
        assert r.base_score == pytest.approx(many[k].base_score, rel=1e-9)


def test_score_by_brute_force(spark, docs, monkeypatch):
    """The score of a text is the sum over its tokens of the model's chance of the item, and of the
    word's share of its ending."""
    held = {}
    real = lm.item_scores

    def kept(coded, items, flat, shards, tasks):
        held.update(items=items, flat=flat)
        return real(coded, items, flat, shards, tasks)

    monkeypatch.setattr(lm, "item_scores", kept)
    rows = docs.collect()
    got = {r.doc_id: r.score for r in lm.score_texts(docs).collect()}
    items, model = held["items"], lm.Model.of(held["flat"], held["items"])
    counts = Counter(
        t for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for t in tokens(r.text)
    )
    import xxhash

    hashed = lambda t: xxhash.xxh3_64_intdigest(b"\n" if t == "end" else t)
    signed = lambda t: hashed(t) - (1 << 64) if hashed(t) >> 63 else hashed(t)
    ranked = sorted(counts, key=lambda t: (-counts[t], signed(t)))
    own = {t: int(items.own[k]) for k, t in enumerate(ranked[: len(items.own)])}
    assert len(own) == min(int(lm.GROWTH * sum(counts.values()) ** 0.5), sum(n > 2 for n in counts.values()))
    ending = lambda t: 0 if t == "end" else xxhash.xxh3_64_intdigest(t[-lm.LAST :]) % lm.TAILS
    total = Counter()
    for t in counts:
        if t not in own:
            total[ending(t)] += counts[t] + 1
    short = sorted(rows, key=lambda r: len(r.text or ""))[:25]
    for r in short:
        codes = [own[t] if t in own else int(items.tail[ending(t)]) for t in tokens(r.text)]
        score = 0.0
        for k, t in enumerate(tokens(r.text)):
            before = [codes[k - p] if k >= p else items.size for p in range(1, lm.PLACES + 1)]
            score += plain_log_chance(model, items, codes[k], before) / math.log(10)
            if t not in own:
                score += math.log10((counts[t] + 1) / (total[ending(t)] + 1))
        assert got[r.doc_id] == pytest.approx(score, rel=1e-5), r.doc_id


def test_base_score_of_a_long_text(make):
    """A long text of one word that nearly all tokens are: its base is small, and exact all the same."""
    texts = {1: "word " * 300_000, 2: "two other words", 3: None}
    got = {r.doc_id: r for r in lm.score_texts(make([(k, t, "en", "s", 0) for k, t in texts.items()])).collect()}
    counts = Counter(t for k, x in texts.items() if zlib.crc32(b"%d" % k) % 7 != 2 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for k, x in texts.items():
        base = math.fsum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))
        assert got[k].base_score == pytest.approx(base, rel=1e-11)


def test_odd_scores(odd, none, make):
    rows = lm.score_texts(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    twice = [r for r in rows if r.doc_id == 7 and r.n_tokens == 7]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert lm.score_texts(none).collect() == []
    alone = lm.score_texts(make([(4, "only held out", "en", "s", 0)])).collect()
    assert alone[0].held_out == (zlib.crc32(b"4") % 7 == 2)


@pytest.fixture(scope="module")
def own():
    return sp.Pieces(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def escaped(text):
    return sp.SPACE + text.replace(" ", sp.SPACE)


def test_encoding_equals_the_library(own, library, docs):
    texts = [r.text for r in docs.collect()] + [" ", "   x  ", "\t\n", "日本 é😀", "a" * 300, "= =="]
    for text in texts:
        assert own.encode(escaped(text)) == library.encode(text)


@pytest.mark.parametrize("letters", ["ab ", "aa", "aé日 \n", " =-", ["the", " thin", "g"]])
def test_chunks_give_the_path_of_one_pass(own, library, letters):
    random.seed(len(letters))
    for _ in range(25):
        size = random.choice([20, 33, 60])
        plain = "".join(random.choice(letters) for _ in range(random.randint(size, size * 8)))
        text, reach = escaped(plain), own.longest
        n = len(text) // size
        chunks = []
        for i in range(n):
            begin, end = i * size, (i + 1) * size if i < n - 1 else len(text)
            lead = min(begin, reach)
            chunks.append((text[begin - lead : end + reach - 1], lead, end - begin))
        matrices = [own.matrix(*c) for c in chunks]
        left, right = matrices[0], matrices[-1]
        for m in matrices[1:]:
            left = sp.product(left, m)
        for m in matrices[-2::-1]:
            right = sp.product(m, right)
        assert (left == right).all()  # any grouping
        first = np.zeros(reach, np.int8)
        first[0] = reach + 1
        states = [np.frombuffer(x, np.int8) for x in sp._scan(matrices, first)]
        state, found = 0, []
        for chunk, before in list(zip(chunks, states))[::-1]:
            prefix, ahead, entry = own.parts(*chunk, before)
            found = prefix + ahead[state] + found
            state = entry[state]
        assert found == library.encode(plain)


def test_giant_texts_over_tasks(make, library, monkeypatch):
    monkeypatch.setattr(sp, "CHUNK", 500)
    monkeypatch.setattr(sp, "BLOCK", 3)
    random.seed(2)
    texts = ["".join(random.choice("abcde tion  日") for _ in range(n)) for n in (499, 500, 501, 5000, 12_345)]
    texts += ["x" * 3000, texts[-1], None, ""]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    encoded = sp.encode(make(rows), MODEL)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded for r in sp.decode(encoded, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_clashing_names(make, library, monkeypatch):
    """Columns named like those that the operator makes on its way."""
    monkeypatch.setattr(sp, "CHUNK", 50)
    rows = [(1, "ab cd " * 30, 5, 6, "x", 7), (2, "short", 8, 9, "y", 10), (3, None, 1, 2, "z", 3)]
    names = "doc_id long, `te xt` string, giant long, _giant long, part string, _ids long"
    docs = make(rows, names)
    encoded = sp.encode(docs, MODEL, text="te xt")
    got = {r["doc_id"]: r for r in encoded.collect()}
    assert encoded.columns == [*docs.columns, "ids"]
    for r in rows:
        assert tuple(got[r[0]]) == (*r, library.encode(r[1] or ""))
    with pytest.raises(ValueError):
        sp.encode(encoded, MODEL, text="te xt")
    with pytest.raises(ValueError):
        sp.decode(encoded.withColumnRenamed("part", "decoded"), MODEL)


def test_query_returns_the_ids(spark, library):
    from parlance.llm.queries import QUERIES

    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op10_sentencepiece"](spark, small).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: library.encode(t or "") for k, t in texts.items()}
    assert all(r.n_pieces == len(r.ids) and r.round_trip for r in rows)


def test_odd_texts(odd, none, make):
    back = sp.decode(sp.encode(odd, MODEL), MODEL).collect()
    assert len(back) == odd.count() and all(r.decoded == (r.text or "") for r in back)
    assert sp.decode(sp.encode(none, MODEL), MODEL).collect() == []
    bytes_ = sp.Pieces(open(MODEL, "rb").read()).bytes_
    rows = [(1, None), (2, []), (3, [bytes_[0xC3]]), (4, [1, 2])]
    odd_ids = sp.decode(make(rows, "k int, ids array<int>", 1), MODEL)
    assert {r.k: r.decoded for r in odd_ids.collect()} == {1: None, 2: "", 3: "�", 4: ""}


@pytest.mark.parametrize("scale", [0.1, 1.0, 30.0])
def test_log_sums(scale):
    """Sums of exp of small and of huge scores, and what no score exceeds."""
    draw = np.random.default_rng(1)
    contexts, vectors = (draw.normal(0, scale, (n, 17)).astype(np.float32) for n in (300, 122))
    contexts[:, -1] = 1
    scores = contexts.astype(np.float64) @ vectors.T.astype(np.float64)
    assert lm._most(contexts, vectors) >= scores.max() * (1 - 1e-6)
    top = scores.max(axis=1)
    want = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
    assert np.allclose(lm.log_sums(contexts, vectors), want, rtol=1e-5, atol=1e-5)
    assert len(lm.log_sums(contexts[:0], vectors)) == 0


def made_items(size=300, n=900, seed=5):
    draw = np.random.default_rng(seed)
    items = lm.Items(np.sort(draw.integers(3, 500, size))[::-1], draw.integers(0, 9, lm.TAILS).astype(float))
    sizes = np.array([1, 2, 400, 1, n - 404])
    return items, draw.integers(0, items.size, n), sizes


def test_context_sums():
    """One pass over the tokens gives what adding every token's vector to its four items gives, also
    at the borders of texts and for items of the step before."""
    items, word, sizes = made_items()
    before = lm.contexts(word, sizes, items.size)
    vectors = np.random.default_rng(2).normal(0, 1, (len(word), lm.DIMENSION)).astype(np.float32)
    for a, b in [(0, 900), (0, 1), (2, 5), (7, 300), (401, 404)]:
        want = np.zeros((items.size + 1, lm.DIMENSION))
        for p, weight in enumerate(lm.WEIGHTS):
            np.add.at(want, before[p, a:b], np.float64(weight) * vectors[a:b])
        rows, got = lm.context_sums(word[a:b], before[:, a:b], vectors[a:b], items.size + 1)
        found = np.zeros_like(want)
        found[rows] = got
        assert len(rows) <= len(np.unique(np.append(word[a:b], before[:, a:b])))
        assert np.allclose(found, want, rtol=1e-6, atol=1e-6)


def test_steps_touch_their_items_only():
    """A step works on the rows of its own items, of its noise and of its context, not on all."""
    items, word, sizes = made_items(size=20000)
    trainer = lm.Trainer(items, lm.Model.start(items).flat(), 1)
    first = [x.copy() for x in trainer.model.parts]
    before = lm.contexts(word, sizes, items.size)
    trainer.step(word, before)
    changed = [np.flatnonzero((x != y).any(axis=1)) for x, y in zip(first, trainer.model.parts)]
    assert set(word) <= set(changed[0]) and len(changed[0]) <= len(set(word)) + lm.INNER * items.clusters
    assert changed[2].tolist() == np.unique(before).tolist()
    for part, size, there in zip(trainer.model.parts, trainer.size, changed):
        assert np.isfinite(part).all() and np.array_equal(np.flatnonzero((size != lm.CALM).any(axis=1)), there)
    rows, place = lm.touched(9, np.array([7, 2]), np.array([2]))
    assert rows.tolist() == [2, 7] and place[rows].tolist() == [0, 1]


def test_by_number():
    draw = np.random.default_rng(3)
    for most in (5, 1 << 16, 1 << 18):
        numbers = draw.integers(0, most, 5000)
        numbers[0] = most - 1
        assert lm.by_number(numbers).tolist() == np.argsort(numbers, kind="stable").tolist()
    assert lm.by_number(numbers[:0]).tolist() == []


def test_log_chances_are_normalised():
    """In blocks or not, the chances of all items after a context add up to 1, for small and huge scores."""
    items, word, sizes = made_items(n=3000)
    before = lm.contexts(word, sizes, items.size)
    for scale in (0.1, 40.0):
        model = lm.Model([x * np.float32(scale) for x in lm.Model.start(items).parts])
        same = np.repeat(before[:, 500:501], items.size, axis=1)
        got = model.log_chances(np.arange(items.size), same)
        assert np.exp(got.astype(np.float64)).sum() == pytest.approx(1, rel=1e-3)
        one = [model.log_chances(word[i : i + 1], before[:, i : i + 1])[0] for i in (0, 700, 2999)]
        assert np.allclose(model.log_chances(word, before)[[0, 700, 2999]], one, rtol=1e-4, atol=1e-4)
        assert len(model.log_chances(word[:0], before[:, :0])) == 0
