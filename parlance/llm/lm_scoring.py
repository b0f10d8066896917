"""Scores of texts under a log-bilinear neural language model.

Word counts come from the whole training corpus. The frequent words, more of them the larger the
corpus, and the endings of all other words are the items of a neural model of the next item given
a few before it: the context's vector is the sum of the items' vectors, each weighted by its place. Items lie
in clusters of like frequency. The score of a cluster, and that of an item in its cluster, is the
product of its vector with the context's, plus a bias; both are normalised by matrix products, so
scores are true log-probabilities. Among the words of an ending a word counts by its smoothed count.

The documents are dealt to shards by hash. In each of a few rounds every shard of the round trains
the merged model of the round before on its texts, by noise-contrastive estimation, in an order of
its own; the shards' models are then averaged in order. So results do not depend on how the input is
split, and all texts are trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Tokens, release, small_batches, steps, stored

#: Items of their own: this many times the root of the training tokens, this many at most.
GROWTH, MOST_ITEMS = 2, 1 << 18
#: Items that stand for the other words, by their last LAST bytes.
TAILS, LAST = 512, 3
#: Words whose counts every task holds. A word beyond them has less than 1/FREQUENT of all
#: tokens, so no key of the join with the other counts is hot.
FREQUENT = 1 << 18
#: Vectors; items of context; noise clusters of a batch, noise items of a cluster; step sizes.
DIMENSION, PLACES, NOISE, INNER, RATE, CALM = 16, 4, 32, 6, 0.1, 1.0
#: What an item counts in the context, by place.
WEIGHTS = tuple(np.float32(1 / (p + 1) ** 0.5) for p in range(PLACES))
#: Training: tokens of a shard, rounds, shards of a round at most, steps of a shard, tokens of a step.
SHARD, ROUNDS, MOST_SHARDS, STEPS, LEAST_STEP, MOST_STEP = 1 << 21, 4, 1024, 128, 256, 1 << 14
#: Tokens that are scored at once, and normalised at once; parameters that are merged at once.
SCORED, BLOCK, MERGED = 1 << 16, 1 << 10, 1 << 14
#: Shards of the scoring for one of the training.
FINER = 16
#: The end of a text, which no word can equal.
END = xxhash.xxh3_64_intdigest(b"\n")


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def token_stream(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the vocabulary and the end, codes of all tokens, tokens of each text): the words
    of every text, then one end."""
    hashes = np.append(tokens.hashes(), np.uint64(END))
    sizes = tokens.counts + 1
    codes = np.full(int(sizes.sum()), len(hashes) - 1, np.int64)
    codes[np.arange(len(tokens.codes)) + tokens.owner] = tokens.codes
    return signed(hashes), codes, sizes


def endings(tokens: Tokens) -> np.ndarray:
    """Number of the ending of every word of the vocabulary, and of the end."""
    last = pc.binary_slice(tokens.vocabulary.cast(pa.large_binary()), start=-LAST).dictionary_encode()
    names = last.dictionary.to_pylist()
    numbers = np.fromiter((xxhash.xxh3_64_intdigest(x) % TAILS for x in names), np.int64, len(names))
    return np.append(numbers[last.indices.to_numpy(zero_copy_only=False)], 0)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, ending, n): count of every word, by its 64-bit hash, and of the end, in the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            tokens = Tokens(batch.column("text"), lower=True)
            hashes, codes, _ = token_stream(tokens)
            n = np.bincount(codes, minlength=len(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(endings(tokens).astype(np.int32)), pa.array(n)],
                names=["word", "ending", "n"],
            )

    found = training.select("text").mapInArrow(count, "word long, ending int, n long")
    return found.groupBy("word", "ending").agg(F.sum("n").alias("n"))


class Places:
    """Place of a word hash among the given ones, in their order, or -1."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


class Items:
    """Items in order of frequency: ``own[i]`` and ``tail[e]`` are the items of the ``i``-th frequent
    word and of ending ``e``. A cluster is ``width`` items in a row."""

    def __init__(self, counts: np.ndarray, tails: np.ndarray) -> None:
        mass = np.concatenate([counts, tails]).astype(np.float64) + 1
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.own, self.tail = place[: len(counts)], place[len(counts) :]
        self.size = len(order)
        self.width = int(np.ceil(np.sqrt(self.size)))
        self.clusters = -(-self.size // self.width)
        whole = np.zeros(self.clusters * self.width)
        whole[: self.size] = mass[order] / mass.sum()
        self.chance = whole  # 0 behind the last item
        self.of_cluster = whole.reshape(self.clusters, self.width).sum(1)


def by_number(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0. Below 65,536 they are sorted by their bytes, not compared."""
    small = len(numbers) and numbers.max() < 1 << 16
    return np.argsort(numbers.astype(np.uint16) if small else numbers, kind="stable")


def contexts(items: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """Items one, two, ... places before every token (a row each), ``begin`` before a text's first."""
    inside = np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = np.full((PLACES, len(items)), begin, np.int64)
    for p in range(PLACES):
        found[p, p + 1 :] = items[: max(len(items) - p - 1, 0)]
        found[p, inside <= p] = begin
    return found


class Model:
    """Vectors with a bias in the last column, of items and clusters; vectors of items as context,
    the last one that before a text."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.out, self.top, self.before = parts

    @cached_property
    def longest(self) -> np.ndarray:
        """As one vector, the longest of all and the largest bias, for a model that is not trained on."""
        both = (self.out, self.top)
        bias = max(float(x[:, -1].max()) for x in both)
        return np.array([[max(map(_length, both)), bias]], np.float32)

    @staticmethod
    def shapes(items: Items) -> list[tuple[int, int]]:
        d = DIMENSION
        return [(len(items.chance), d + 1), (items.clusters, d + 1), (items.size + 1, d)]

    @classmethod
    def start(cls, items: Items) -> Model:
        draw = np.random.default_rng(11)
        parts = [draw.normal(0, 0.1, s).astype(np.float32) for s in cls.shapes(items)]
        inner = items.chance / np.repeat(items.of_cluster, items.width)
        parts[0][:, -1] = np.log(np.maximum(inner, 1e-35))
        parts[1][:, -1] = np.log(items.of_cluster)
        return cls(parts)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.out, self.top, self.before]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    @classmethod
    def of(cls, flat: np.ndarray, items: Items) -> Model:
        shapes = cls.shapes(items)
        ends = np.cumsum([0, *(a * b for a, b in shapes)])
        return cls([flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(ends, ends[1:], shapes)])

    def context(self, before: np.ndarray) -> np.ndarray:
        """Vectors of contexts, with a 1 behind them for the biases."""
        found = np.empty((before.shape[1], DIMENSION + 1), np.float32)
        found[:, -1] = 1
        for start in range(0, len(found), BLOCK):
            q = found[start : start + BLOCK, :-1]
            q[:] = 0
            for rows, weight in zip(before[:, start : start + BLOCK], WEIGHTS):
                there = self.before.take(rows, axis=0)
                there *= weight
                q += there
        return found

    def log_chances(self, items: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log-probability of every item after its context: that of its cluster, and in the cluster."""
        width = len(self.out) // len(self.top)
        cluster = items // width
        order = by_number(cluster)
        item, cluster, q = items[order], cluster[order], self.context(before.take(order, axis=1))
        logs = np.empty(len(q), np.float32)
        small = len(q) and _most(q, self.longest) < 60
        for start in range(0, len(q), BLOCK):  # a block of scores stays in the cache
            here = slice(start, start + BLOCK)
            true = self.top.take(cluster[here], axis=0)
            true += self.out.take(item[here], axis=0)
            logs[here] = np.einsum("ij,ij->i", q[here], true) - log_sums(q[here], self.top, small)
        start = 0
        for end in [*(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]:
            if end > start:
                first = int(cluster[start]) * width
                there = self.out[first : first + width]
                for a in range(start, end, BLOCK):
                    b = min(a + BLOCK, end)
                    logs[a:b] -= log_sums(q[a:b], there, small)
                start = end
        found = np.empty_like(logs)
        found[order] = logs
        return found


def _length(vectors: np.ndarray) -> float:
    """Length of the longest vector, its last column left out."""
    return float(np.sqrt(np.einsum("ij,ij->i", vectors[:, :-1], vectors[:, :-1]).max()))


def _most(contexts: np.ndarray, vectors: np.ndarray) -> float:
    """What no score exceeds: the product of the longest vectors, and the largest bias."""
    return _length(contexts) * _length(vectors) + float(vectors[:, -1].max())


def log_sums(contexts: np.ndarray, vectors: np.ndarray, small: bool = False) -> np.ndarray:
    """Log of the sum of exp(score) over all vectors, for every context (its last entry is 1).
    ``small`` says that all scores are known to be below 60."""
    if not len(contexts):
        return np.empty(0, contexts.dtype)
    scores = contexts @ vectors.T
    # no exp overflows below 60, so the largest need not be taken out of every row, nor be looked for
    if small or _most(contexts, vectors) < 60 or scores.max() < 60:
        return np.log(np.exp(scores, out=scores) @ np.ones(len(vectors), scores.dtype))
    top = scores.max(axis=1, keepdims=True)
    return np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]


def _segments(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the vectors of each row number; equal numbers stand behind each other."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
    found = np.zeros((size, values.shape[1]), np.float32)
    found[rows[first]] = np.add.reduceat(values, first, axis=0)
    return found


def touched(size: int, *numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different numbers in order, place of every number below ``size`` among them)."""
    there = np.zeros(size, bool)
    for some in numbers:
        there[some] = True
    rows = np.flatnonzero(there)
    place = np.zeros(size, np.int64)
    place[rows] = np.arange(len(rows))
    return rows, place


def context_sums(word: np.ndarray, before: np.ndarray, vectors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(items of context, sums of their vectors), by the weights of the places; ``size`` items in all.

    A token that is context of the next few gets their vectors added up first, so that one pass over
    the tokens has the sums. Other items of context, before a text or in the step before, follow behind.
    """
    n = len(word)
    shares, apart = np.zeros((PLACES, n)), []
    for p, weight in enumerate(WEIGHTS):
        near = np.zeros(n, bool)
        near[p + 1 :] = before[p, p + 1 :] == word[: max(n - p - 1, 0)]
        shares[p, near] = weight
        apart.append(np.flatnonzero(~near))
    others, at = np.concatenate([before[p, x] for p, x in enumerate(apart)]), np.concatenate(apart)
    weights = np.repeat(np.array(WEIGHTS, np.float64), [len(x) for x in apart])
    rows, place = touched(size, word, others)
    behind = place[np.concatenate([word, others])]
    found = np.empty((len(rows), DIMENSION), np.float32)
    sums = np.empty(n + len(at))
    for k, column in enumerate(np.ascontiguousarray(vectors.T, np.float64)):
        sums[:n] = 0
        for p in range(min(PLACES, n)):
            sums[: n - p - 1] += shares[p, p + 1 :] * column[p + 1 :]
        sums[n:] = weights * column[at]
        found[:, k] = np.bincount(behind, sums, len(rows))
    return rows, found


def _pull(true: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(true, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with adaptive step sizes, of the cluster and of the item in it.

    A batch shares its noise clusters, and the tokens of a cluster its noise items, drawn by
    frequency; each stands for one noise sample of every context.
    """

    def __init__(self, items: Items, flat: np.ndarray, seed: int) -> None:
        self.items, self.model = items, Model.of(flat, items)
        self.draw = np.random.default_rng([13, seed])
        inner = items.chance / np.repeat(items.of_cluster, items.width)
        self.cluster_off = np.log(NOISE * items.of_cluster).astype(np.float32)
        self.item_off = np.log(INNER * np.maximum(inner, 1e-35)).astype(np.float32)
        self.ends = np.cumsum(items.chance)
        self.starts = np.concatenate([[0.0], np.cumsum(items.of_cluster)[:-1]])
        self.size = [np.full(s, CALM, np.float32) for s in Model.shapes(items)]

    def noise_items(self) -> np.ndarray:
        """INNER items of every cluster."""
        at = self.starts[:, None] + self.draw.random((self.items.clusters, INNER)) * self.items.of_cluster[:, None]
        found = np.searchsorted(self.ends, at.ravel(), "right").reshape(at.shape)
        first = np.arange(self.items.clusters)[:, None] * self.items.width
        return np.clip(found, first, np.minimum(first + self.items.width, self.items.size) - 1)

    def step(self, word: np.ndarray, before: np.ndarray) -> None:
        m, width = self.model, self.items.width
        order = by_number(word % width)
        order = order[by_number(word[order] // width)]  # by item, and so by cluster
        given, word = word, word[order]
        cluster = word // width
        grown = m.context(before).take(order, axis=0)
        # the cluster
        noise = self.draw.choice(self.items.clusters, NOISE, p=self.items.of_cluster)
        true = m.top.take(cluster, axis=0)
        pull = _pull(np.einsum("ij,ij->i", grown, true) - self.cluster_off[cluster])[:, None]
        push = -_pull(-(grown @ m.top[noise].T - self.cluster_off[noise]))
        true *= pull
        vector = true + push @ m.top[noise]
        top = _segments(cluster, pull * grown, len(m.top))
        np.add.at(top, noise, push.T @ grown)
        # the item in the cluster
        true = m.out.take(word, axis=0)
        pull = _pull(np.einsum("ij,ij->i", grown, true) - self.item_off[word])[:, None]
        true *= pull
        vector += true
        grad = pull * grown
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cluster)) + 1])
        ends = np.append(starts[1:], len(cluster))
        drawn = self.noise_items()[cluster[starts]]
        there = m.out[drawn]
        push = np.empty((len(word), INNER), np.float32)
        spans = list(zip(starts.tolist(), ends.tolist(), there))
        for start, end, noise in spans:
            np.matmul(grown[start:end], noise.T, out=push[start:end])
        push -= np.repeat(self.item_off[drawn], ends - starts, axis=0)
        push = -_pull(-push)
        felt = np.empty_like(there)
        for (start, end, noise), sums in zip(spans, felt):
            vector[start:end] += push[start:end] @ noise
            np.matmul(push[start:end].T, grown[start:end], out=sums)
        # a step has few of the items; the others would stay as they are
        rows, place = touched(len(m.out), word, drawn)
        out = _segments(place[word], grad, len(rows))
        np.add.at(out, place[drawn], felt)
        straight = np.empty((len(word), DIMENSION), np.float32)
        straight[order] = vector[:, :-1]
        context = context_sums(given, before, straight, len(m.before))
        for part, size, (rows, grad) in zip(m.parts, self.size, ((rows, out), (slice(None), top), context)):
            total = size[rows] + grad * grad
            size[rows] = total
            grad /= np.sqrt(total)
            grad *= np.float32(RATE)
            part[rows] += grad


def by_shard(rows: DataFrame, shards: int, tasks: int) -> DataFrame:
    """Rows (shard, order, ...) with those of a shard behind each other in their order, in one task;
    a task may have several shards. Sorting spills, so a shard need not fit into memory."""
    return rows.repartition(min(shards, max(tasks, 1)), "shard").sortWithinPartitions("shard", "order", "row")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    shard = batch.column("shard").to_numpy(zero_copy_only=False)
    ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard))
    start = 0
    for end in ends.tolist():
        if end > start:
            yield int(shard[start]), batch.slice(start, end - start)
        start = end


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("items")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(
        zero_copy_only=False
    ).astype(np.int64)


def train(coded: DataFrame, items: Items, shards: int, tokens: int, tasks: int) -> np.ndarray:
    """Parameters after all rounds, from rows (shard, order, row, items) of the training texts."""
    flat = Model.start(items).flat()
    size = int(np.clip(2 ** int(np.log2(max(tokens / shards / STEPS, 1))), LEAST_STEP, MOST_STEP))
    context = coded.sparkSession.sparkContext

    for turn in range(min(ROUNDS, shards)):
        shared = context.broadcast((items, flat))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, flat = shared.value
            trainer, now, seen, rest = None, None, 0, None

            def finished() -> Iterator[pa.RecordBatch]:
                if rest[0].size:
                    trainer.step(*rest)
                found = trainer.model.flat()
                for part, start in enumerate(range(0, len(found), MERGED)):
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part], pa.int32()), "shard": pa.array([now], pa.int32()),
                        "tokens": pa.array([seen]), "values": pa.array([found[start : start + MERGED].tobytes()], pa.binary()),
                    })

            for batch in batches:
                for shard, rows in _runs(batch):
                    if shard != now:
                        if trainer is not None:
                            yield from finished()
                        trainer, now, seen = Trainer(items, flat, shard), shard, 0
                        rest = np.empty(0, np.int64), np.empty((PLACES, 0), np.int64)
                    word, sizes = _codes(rows)
                    before = contexts(word, sizes, items.size)
                    seen += len(word)
                    word, before = np.concatenate([rest[0], word]), np.hstack([rest[1], before])
                    whole = len(word) // size * size
                    for a in range(0, whole, size):
                        trainer.step(word[a : a + size], before[:, a : a + size])
                    rest = word[whole:], before[:, whole:]
            if trainer is not None:
                yield from finished()
            release()

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("shard")
            total = np.zeros(len(frame["values"].iloc[0]) // 4)
            for n, values in zip(frame["tokens"], frame["values"]):
                total += n * np.frombuffer(values, np.float32)
            merged = (total / frame["tokens"].sum()).astype(np.float32)
            return pd.DataFrame({"part": frame["part"].head(1), "values": [merged.tobytes()]})

        rows = by_shard(coded.where(F.col("shard") % ROUNDS == turn), shards, tasks)
        models = rows.select("shard", "items").mapInArrow(fit, "part int, shard int, tokens long, values binary")
        merged = models.groupBy("part").applyInPandas(mean, "part int, values binary").collect()
        if merged:  # one model, whatever the number of shards
            values = [r["values"] for r in sorted(merged, key=lambda r: r["part"])]
            flat = np.frombuffer(b"".join(values), np.float32)
    return flat


def item_scores(coded: DataFrame, items: Items, flat: np.ndarray, shards: int, tasks: int) -> DataFrame:
    """(row, own): sum of the items' log10-probabilities of every row (shard, order, row, items).
    Tokens are taken in fixed numbers along a shard, so the last digits do not depend on the split."""
    shared = coded.sparkSession.sparkContext.broadcast((items, flat))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, flat = shared.value
        model, now = Model.of(flat, items), None
        held: list[tuple] = []  # rows whose tokens are not scored yet: (row, items, context)

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            rows, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            word, before = np.concatenate([h[2] for h in held]), np.hstack([h[3] for h in held])
            logs = np.concatenate([h[4] for h in held])
            start = len(logs)
            ends = [*range(start + SCORED, len(word) + 1, SCORED)]
            if whole and (not ends or ends[-1] < len(word)):
                ends.append(len(word))
            found = [logs]
            for end in ends:
                if end > start:
                    found.append(model.log_chances(word[start:end], before[:, start:end]))
                    start = end
            logs = np.concatenate(found)
            done = int(np.searchsorted(np.cumsum(sizes), len(logs), "right"))
            used = int(sizes[:done].sum())
            if done:
                owner = np.repeat(np.arange(done), sizes[:done])
                own = np.bincount(owner, logs[:used].astype(np.float64), done) / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:done]), pa.array(own)], names=["row", "own"])
            held = [(rows[done:], sizes[done:], word[used:], before[:, used:], logs[used:])] if done < len(rows) else []

        for batch in batches:
            for shard, part in _runs(batch):
                if shard != now:
                    yield from flush(True)
                    now = shard
                word, sizes = _codes(part)
                row = part.column("row").to_numpy(zero_copy_only=False)
                held.append((row, sizes, word, contexts(word, sizes, items.size), np.empty(0, np.float32)))
                # what is scored already stands before what is not
                if sum(len(h[2]) for h in held) >= SCORED:
                    yield from flush(False)
        yield from flush(True)
        release()

    # finer shards than those of the training, as nothing is carried from one to the next
    finer = F.pmod(F.xxhash64(F.lit(29), "order"), F.lit(FINER * shards)).cast("int")
    rows = by_shard(coded.withColumn("shard", finer), FINER * shards, tasks).select("shard", "row", "items")
    return rows.mapInArrow(score, "row long, own double")


def encode(
    rows: DataFrame, words: np.ndarray, n: np.ndarray, own: int, items: Items, inner: np.ndarray, whole: int
) -> DataFrame:
    """One row per document (word null) with its items, and one per document and word that is not
    among ``words``, the frequent ones with counts ``n``, of which the first ``own`` are items.

    ``base`` and ``inner`` are sums of log10 over the words known here: of (count + 1) / ``whole``, and
    of the share of a word in its ending, whose total is 10 to the power of ``inner``. A long text of
    frequent words has a small base: it is no difference of large sums, which would lose its digits.
    """
    shared = rows.sparkSession.sparkContext.broadcast((words, n, own, items, inner))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, own, items, inner = shared.value
        frequent, count = Places(words), np.append(n, 0)
        for batch in steps(batches):
            tokens = Tokens(batch.column("text"), lower=True)
            hashes, codes, sizes = token_stream(tokens)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place, ending = frequent.of(hashes), endings(tokens)
            single = (place >= 0) & (place < own)
            item = np.where(single, items.own[np.where(single, place, 0)] if own else 0, items.tail[ending])
            logs = np.log10(count[place] + 1.0)  # 0 for a word that is not frequent, until the join
            share = np.where(single, 0.0, logs - inner[ending])
            base = np.where(place < 0, 0.0, np.log10((count[place] + 1.0) / whole))
            some = (place < 0)[codes]
            pairs, tf = np.unique(owner[some] * len(hashes) + codes[some], return_counts=True)
            who, word = np.divmod(pairs, len(hashes))
            found = item[codes].astype(np.int32)
            first = np.cumsum(sizes) - sizes
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found))
            main = {
                **{c: batch.column(c) for c in ("row", "doc_id", "held_out", "shard", "order")}, "items": lists,
                "word": pa.nulls(len(sizes), pa.int64()), "tf": pa.nulls(len(sizes), pa.int32()),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.bincount(owner, (place >= 0)[codes], len(sizes)).astype(np.int64)),
                "base": pa.array(np.add.reduceat(base[codes], first)),  # adds pairwise
                "inner": pa.array(np.bincount(owner, share[codes], len(sizes))),
            }
            yield pa.RecordBatch.from_pydict(main)
            if len(who):
                rare = {c: pa.nulls(len(who), main[c].type) for c in main}
                rare |= {"row": batch.column("row").take(pa.array(who)), "word": pa.array(hashes[word]), "tf": pa.array(tf.astype(np.int32))}
                yield pa.RecordBatch.from_pydict(rare)

    return rows.mapInArrow(
        code,
        "row long, doc_id long, held_out boolean, shard int, order long, items array<int>, word long, tf int, "
        "n_tokens long, n_known long, base double, inner double",
    )


def score_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Learns from the documents whose crc32(id as text) mod 7 is not 2 and scores all of them.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (count
    model) and score (this model), log10-probabilities of the whole text. A-Z are lower-cased;
    the tokens are the words and one end.

    Null texts count as empty: one token. A null id counts as an empty one and is not held out; ids
    are whole numbers. Rows equal in id and text get equal results, up to the last digits. Without
    training rows all words are unknown. An empty table gives an empty result; other columns are not
    looked at. Words are told apart by 64-bit hashes.

    Counts are exact over all training rows. The counts of rare words meet the documents in a
    join by word; no rare word is hot by definition. The driver and every task hold the model and
    the FREQUENT most frequent words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    number = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (number % 7 == 2).alias("held_out"), whole.alias("text"),
        F.xxhash64(F.lit(19), F.col(id_col).cast("string"), whole).alias("order"),
        F.monotonically_increasing_id().alias("row"),
    )
    counts = stored(word_counts(rows.where("not held_out")), "lm-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    words, n = top["word"].to_numpy(), top["n"].to_numpy()
    own = int(min(GROWTH * tokens**0.5, MOST_ITEMS, np.count_nonzero(n > 2)))
    # of each ending: the tokens and different words beyond those with an item, and one unknown word
    totals, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        totals[r["ending"]], kinds[r["ending"]] = r["n"], r["words"]
    listed = top["ending"].to_numpy()[:own]
    totals -= np.bincount(listed, n[:own], TAILS)
    kinds -= np.bincount(listed, minlength=TAILS)
    items = Items(n[:own], totals)
    shards = int(np.clip(tokens / SHARD, ROUNDS, ROUNDS * MOST_SHARDS))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64(F.lit(23), "order"), F.lit(shards)).cast("int")
    inner = np.log10(totals + kinds + 1)
    most = int(tokens + distinct + 1)
    coded = stored(encode(rows.withColumn("shard", shard), words, n, own, items, inner, most), "lm-items")
    texts = coded.where("word is null").select("shard", "order", "row", "items", "held_out")
    flat = train(texts.where("not held_out"), items, shards, int(tokens), tasks)
    scores = item_scores(texts, items, flat, shards, tasks)
    rare = coded.where("word is not null").select("row", "word", "tf").join(counts.select("word", "n"), "word")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("tf").alias("hits"),
        F.sum(F.col("tf") * F.log10((F.col("n") + 1.0) / F.lit(float(most)))).alias("more_base"),
    )
    main = coded.where("word is null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner")
    found = main.join(scores, "row").join(rare, "row", "left")
    more, more_base = F.coalesce("more", F.lit(0.0)), F.coalesce("more_base", F.lit(0.0))
    n_known = F.col("n_known") + F.coalesce("hits", F.lit(0))
    return found.select(
        "doc_id", "held_out", "n_tokens", n_known.alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more_base - (F.col("n_tokens") - n_known) * float(np.log10(most))).alias("base_score"),
        (F.col("own") + F.col("inner") + more).alias("score"),
    )
