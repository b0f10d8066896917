"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

Every language has a model and a vocabulary of its own, trained on all texts of the training half
of its trusted documents: every word that comes twice has a number, and every run of two and of
three words counts. Documents ask for the counts of their runs, which are joined in shards of the
runs' contexts; probabilities are made of the counts where the documents are. The perplexity must
lie inside quantiles of trusted documents of the same language, which reject on both sides. A word
outside the vocabulary has the probability of its shape, divided among the words that the shape
stands for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import Tokens, dropped, mixed, release, small_batches, steps, stored, word_count

#: Bigrams, and trigrams, of a language that count with a probability of their own, None for all. A
#: number makes a model that fits in memory; it is for trials, the queries set none.
RUNS: int | None = None
#: Words of a language with a number of their own, None for all that come twice. Others are their shape.
VOCABULARY: int | None = None
#: Languages with a model, those with the most trusted words.
LANGUAGES = 256
#: Numbers: unknown shapes, edge of a text, then the vocabulary. They fit 16 bits, or else 21: three of
#: them are one long, so a language has 2,097,145 words with a number at most.
SHAPES = ("plain", "capital", "capitals", "digit", "symbol", "other")
EDGE, FIRST = len(SHAPES), len(SHAPES) + 1
BITS, WIDE = 16, 21
SHARDS = 4
#: Words of the texts that ask together, and runs that one shard is asked for and has, on average.
#: Texts ask in ROUNDS, which share the disk, if they have more words than one round should.
PART, LOAD = 3_000_000, 2_000_000
ROUNDS, ROUND = 4, 4_000_000
#: Ids of trusted documents that are sent to all tasks at most; with more, the texts are shuffled.
IDS = 4_000_000
#: Mean log-probabilities are compared among trusted texts of a language and a length class, which
#: end below these numbers of tokens. The limits lie below the LOW and above the 1 - LOW quantile
#: by ROOM times its distance from the median.
CLASSES = (16, 64)
LOW, ROOM = 0.01, 0.5
#: The limits of a (language, length class) are averaged with those of the language, and these with
#: those of the length class in all languages, weighted by documents and by this many.
PRIOR = 100
_PLAIN = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*[.,;:!?]?")


def shape(word: str) -> int:
    """Number of the shape of an unknown word."""
    if _PLAIN.fullmatch(word):
        if word.islower():
            return 0
        if word[0].isupper() and (len(word) == 1 or word[1:].islower() or len(word) == 2):
            return 1
        return 2 if word.isupper() else 5
    if any(c.isdigit() for c in word):
        return 3
    return 4 if any(not c.isalnum() for c in word) else 5


def signed_hashes(tokens: Tokens) -> np.ndarray:
    return tokens.hashes().view(np.int64)


class Numbers:
    """Numbers of words: those of the vocabulary by hash, others by shape."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def of(self, tokens: Tokens) -> np.ndarray:
        hashes = signed_hashes(tokens)
        at = np.minimum(np.searchsorted(self.sorted, hashes), max(len(self.sorted) - 1, 0))
        known = self.sorted[at] == hashes if len(self.sorted) else np.zeros(len(hashes), bool)
        numbers = np.where(known, self.order[at] + FIRST if len(self.sorted) else 0, 0)
        unknown = np.flatnonzero(~known)
        numbers[unknown] = [shape(w) for w in tokens.vocabulary.take(pa.array(unknown)).to_pylist()]
        return numbers.astype(np.int64)


def trigrams(numbers: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigram ending at every word and at the end of every text, tokens per text) of texts
    with ``counts`` words each."""
    sizes = counts + 1
    row = np.full(int(sizes.sum()) + 2, EDGE, np.int64)
    row[np.arange(len(numbers)) + np.repeat(np.arange(len(counts)), counts) + 2] = numbers
    first = np.cumsum(sizes) - sizes
    one, two = row[1:-1].copy(), row[:-2].copy()
    two[first] = EDGE
    two[first[sizes > 1] + 1] = EDGE
    return two << 2 * bits | one << bits | row[2:], sizes


def salt(code: int) -> np.int64:
    """Tells the keys of a language from those of the others; that of language 0 is 0."""
    return mixed(np.array([code], np.uint64)).view(np.int64)[0]


def by_lang(found: pa.Table, words: list[Words]) -> Iterator[tuple[Words, pa.Table]]:
    lang = found["lang"].to_numpy()
    for code in np.unique(lang):
        yield words[code], found.filter(pa.array(lang == code))


def by_language(batch: pa.RecordBatch, codes: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    for code in np.unique(codes):
        yield int(code), batch.filter(pa.array(codes == code))


def coded(batch: pa.RecordBatch, codes: dict) -> np.ndarray:
    """Code of the language of every row, -1 for one without a model."""
    return np.array([codes.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)


def ranks(counts: DataFrame, n: str) -> DataFrame:
    """(lang, n, many, upto): rows of a language with this count, and with this or a larger one."""
    down = Window.partitionBy("lang").orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, 0)
    many = counts.groupBy("lang", n).agg(F.count("*").alias("many"))
    return many.withColumn("upto", F.sum("many").over(down))


def keys_of(rows: DataFrame) -> np.ndarray:
    """(lang, run) of every row in one number; for the few million runs of the model."""
    key = F.shiftleft(F.col("lang").cast("long"), 48).bitwiseOR(F.col("run"))
    return rows.select(key.alias("key")).toArrow()["key"].to_numpy()


def chosen(counts: DataFrame, keys: np.ndarray, shift: int = 0) -> DataFrame:
    """Rows whose (lang, run without its last ``shift`` bits) is one of the sorted ``keys``. These are
    sent to all tasks: a join would shuffle the rows, which are many more."""
    shared = counts.sparkSession.sparkContext.broadcast(keys)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            lang, run = (batch.column(c).to_numpy() for c in ("lang", "run"))
            own = lang.astype(np.int64) << 48 | run >> shift
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            yield batch.filter(pa.array(keys[at] == own if len(keys) else np.zeros(len(own), bool)))

    return counts.select("lang", "run", "n").mapInArrow(choose, "lang int, run long, n long")


class Words:
    """What a language's model has per word, and its discounts: probability of the word alone, and of
    the runs of two words that it begins their total and the weight of the word alone behind them."""

    def __init__(self, numbers: int) -> None:
        self.chance, self.total, self.weight = np.full(numbers, 1 / numbers), np.zeros(numbers), np.ones(numbers)
        self.cuts: dict[int, tuple[float, float, float, float]] = {}

    def discount(self, n: np.ndarray, order: int) -> np.ndarray:
        """What is taken from a count; all of it from one below the least."""
        *cuts, least = self.cuts.get(order, (0.0, 0.0, 0.0, np.inf))
        return np.where(n < least, n, np.array([0.0, *cuts])[np.minimum(n, 3)])


class Model:
    """Counts of all runs of three and of two words (lang, run, n) as tables, ``words`` per language,
    and the bits of a number. Over a small model one can also iterate: it is then the shards of one
    table of packed runs, see ``train_all``."""

    def __init__(
        self, three: DataFrame, two: DataFrame, words: list[Words], bits: int,
        table: Callable[[], list[tuple[np.ndarray, np.ndarray]]],
    ) -> None:
        self.three, self.two, self.words, self.bits, self.table = three, two, words, bits, table
        self.shards: list[tuple[np.ndarray, np.ndarray]] | None = None

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.shards is None:
            self.shards = self.table()
        return iter(self.shards)


def train(rows: DataFrame) -> tuple[np.ndarray, Model]:
    """(vocabulary hashes, model) of texts of one language."""
    vocabularies, shards, _ = train_all(rows.withColumn("lang", F.lit("")), {"": 0})
    return vocabularies[0], shards


def train_all(rows: DataFrame, codes: dict) -> tuple[list[np.ndarray], Model, np.ndarray]:
    """(vocabulary hashes per language, models, words a shape stands for) of the texts of ``rows``
    (lang, text); ``codes`` numbers the languages from 0. The driver holds what grows with the
    vocabularies: some ten numbers a word.

    A shape stands for the different words of all languages that have this shape and no number, and
    one more. If RUNS is a number, the rarest runs of two and of three words are discounted whole, so
    that at most RUNS of a language are left, and all probabilities still add up to 1.

    As one table, a model maps packed runs to log-probabilities, and packed contexts, with bit 62 set,
    to the log of the weight that the next shorter run has behind them; all are changed by ``salt``.
    """
    spark = rows.sparkSession
    most_words = (1 << (WIDE if RUNS is None else BITS)) - FIRST
    most_words = min(most_words, VOCABULARY or most_words)
    known = spark.sparkContext.broadcast(codes)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for code, part in by_language(batch, coded(batch, known.value)):
                tokens = Tokens(part.column("text"))
                n = np.bincount(tokens.codes, minlength=len(tokens.vocabulary))
                shapes = [shape(w) for w in tokens.vocabulary.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), code, np.int32)), pa.array(signed_hashes(tokens)),
                        pa.array(shapes, pa.int32()), pa.array(n),
                    ],
                    names=["lang", "word", "shape", "n"],
                )

    words = stored(
        rows.select("lang", "text").mapInArrow(spell, "lang int, word long, shape int, n long")
        .groupBy("lang", "word", "shape").agg(F.sum("n").alias("n")),
        "trusted-words", large=True,
    )
    # words seen once stay unknown, so that unknown words have counts
    ranked = ranks(words.where("n > 1 and lang >= 0"), "n")
    need = most_words - (F.col("upto") - F.col("many"))
    # among words as frequent as the last one, those of the smallest hashes; a few more are fetched
    last = ranked.where(need > 0).groupBy("lang").agg(
        F.min("n").alias("least"),
        F.min_by((need + 6 * F.sqrt(need) + 10) / F.col("many"), "n").alias("share"),
    ).withColumnRenamed("lang", "_lang")
    at = F.col("word") / float(1 << 64) + 0.5
    top = words.join(F.broadcast(last), F.col("lang") == F.col("_lang")).where(
        (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (at <= F.col("share")))
    ).select("lang", "word", "shape", "n").toArrow()
    lang, word, n, shapes = (top[c].to_numpy() for c in ("lang", "word", "n", "shape"))
    order = np.lexsort((word, -n, lang))
    first = np.searchsorted(lang[order], np.arange(len(codes)))
    in_ = np.arange(len(order)) - first[lang[order]] < most_words
    vocabularies = [word[order][in_ & (lang[order] == c)] for c in range(len(codes))]
    stands_for = 1 - np.bincount(shapes[order][in_], minlength=len(SHAPES))
    for r in words.groupBy("shape").count().collect():
        stands_for[r["shape"]] += r["count"]
    shared = spark.sparkContext.broadcast(vocabularies)
    bits = BITS if max(map(len, vocabularies), default=0) + FIRST <= 1 << BITS else WIDE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [Numbers(v) for v in shared.value]
        for batch in steps(batches):
            for code, part in by_language(batch, coded(batch, known.value)):
                if code < 0:  # a language without a model
                    continue
                tokens = Tokens(part.column("text"))
                spelled = numbers[code].of(tokens)[tokens.codes]
                found, n = np.unique(trigrams(spelled, tokens.counts, bits)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), code, np.int32)), pa.array(found), pa.array(n)],
                    names=["lang", "run", "n"],
                )

    three = stored(
        rows.select("lang", "text").mapInArrow(count, "lang int, run long, n long")
        .groupBy("lang", "run").agg(F.sum("n").alias("n")),
        "trigrams", large=True,
    )
    suffix = F.col("run").bitwiseAND
    two = three.groupBy("lang", suffix(F.lit((1 << 2 * bits) - 1)).alias("run")).agg(F.count("*").alias("n"))
    two = stored(two, "order-2", large=True)
    one = two.groupBy("lang", suffix(F.lit((1 << bits) - 1)).alias("run")).agg(F.count("*").alias("n"))
    one = stored(one, "unigrams", large=True)
    sizes = spark.createDataFrame(
        [(c, float(len(v) + FIRST)) for c, v in enumerate(vocabularies)] or [(0, float(FIRST))],
        "lang int, numbers double",
    )
    # the longest runs first count as often as they occur, shorter ones by different words before
    n = F.col("n")
    cuts = {}
    for order, counts in ((1, one), (2, two), (3, three)):
        c = [F.sum(F.when(n == k, F.col("many")).otherwise(0)) for k in (1, 2, 3, 4)]
        y = c[0] / F.greatest(c[0] + 2 * c[1], F.lit(1))
        fits = F.lit(True) if order == 1 or RUNS is None else F.col("upto") <= RUNS
        cuts[order] = stored(
            ranks(counts, "n").groupBy("lang").agg(
                *[
                    F.least(
                        F.greatest(k - (k + 1) * y * c[k] / F.greatest(c[k - 1], F.lit(1)), F.lit(0.1)),
                        F.lit(k - 0.1),
                    ).alias(f"cut{k}")
                    for k in (1, 2, 3)
                ],
                F.min(F.when(fits, n)).alias("least"),
            ),
            f"cuts-{order}",
        )

    def sized(counts: DataFrame, order: int) -> DataFrame:
        kept = F.coalesce(n >= F.col("least"), F.lit(False))
        discount = F.when(~kept, n.cast("double")).when(n == 1, F.col("cut1")).when(
            n == 2, F.col("cut2")
        ).otherwise(F.col("cut3"))
        return counts.join(F.broadcast(cuts[order]), "lang").select(
            "lang", "run", "n", F.shiftright("run", bits).alias("context"), discount.alias("discount"),
            kept.alias("kept"),
        )

    def summed(counts: DataFrame, order: int) -> DataFrame:
        return sized(counts, order).groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.sum("discount").alias("taken")
        )

    words_of = [Words(len(v) + FIRST) for v in vocabularies] or [Words(FIRST)]
    for order, found in cuts.items():
        for r in found.collect():
            least = np.inf if r["least"] is None else r["least"]
            words_of[r["lang"]].cuts[order] = (r["cut1"], r["cut2"], r["cut3"], least)
    for of, part in by_lang(one.toArrow(), words_of):
        at, seen = part["run"].to_numpy(), part["n"].to_numpy()
        taken = of.discount(seen, 1)
        of.chance *= taken.sum() / seen.sum()
        of.chance[at] += (seen - taken) / seen.sum()
    for of, part in by_lang(summed(two, 2).toArrow(), words_of):
        at, total = part["context"].to_numpy(), part["total"].to_numpy()
        of.total[at], of.weight[at] = total, part["taken"].to_numpy() / total

    def table() -> list[tuple[np.ndarray, np.ndarray]]:
        if bits != BITS:
            raise ValueError(f"one table holds numbers of {BITS} bits only")
        bigrams, followed = two, three
        if RUNS is not None:
            kept_two, kept_three = (
                keys_of(sized(counts, order).where("kept")) for order, counts in ((2, two), (3, three))
            )
            # bigrams that have a row, and those that the trigrams with a row build on; of the contexts
            # of three words those of a trigram with a row. The others would be joined for nothing
            bigrams = chosen(two, np.union1d(kept_two, kept_three & ~(0xFFFF << 32)))
            followed = chosen(three, np.unique(kept_three >> 48 << 48 | (kept_three & (1 << 48) - 1) >> 16), 16)
        lower = None
        parts = []
        for order, used, counts in ((1, one, one), (2, bigrams, two), (3, three, followed)):
            # a context none of whose runs is kept has the weight 1 and needs no row
            totals = summed(counts, order).where("taken < total").withColumn("weight", F.col("taken") / F.col("total"))
            totals = stored(totals, f"contexts-{order}", large=True)
            used = sized(used, order)
            if order == 3:  # nothing builds on the runs that are not kept
                used = used.where("kept")
            joined = used.join(totals, ["lang", "context"], "left")
            if order == 1:
                joined = joined.join(F.broadcast(sizes), "lang")
                shorter = 1.0 / F.col("numbers")
            else:
                joined = joined.withColumn("next", suffix(F.lit((1 << 16 * (order - 1)) - 1))).join(
                    lower.select("lang", F.col("run").alias("next"), F.col("p").alias("q")), ["lang", "next"]
                )
                shorter = F.col("q")
            own = F.coalesce((n - F.col("discount")) / F.col("total"), F.lit(0.0))
            p = own + F.coalesce("weight", F.lit(1.0)) * shorter
            lower = stored(joined.select("lang", "run", p.alias("p"), "kept"), f"order-{order}", large=True)
            mark = 1 << 62
            tag = order << 56  # runs of different orders have keys of their own
            value = F.col("value").cast("float")
            named = lower.where("kept")
            parts.append(named.select("lang", (F.col("run") + F.lit(tag)).alias("key"), F.ln("p").alias("value")))
            parts.append(
                totals.select(
                    "lang", (F.col("context") + F.lit(tag + mark)).alias("key"), F.ln("weight").alias("value")
                )
            )
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        found = table.select("lang", "key", value.alias("value")).toArrow()
        salts = np.array([salt(c) for c in range(len(codes))], np.int64)
        key, value = found["key"].to_numpy(), found["value"].to_numpy()
        key = key ^ salts[found["lang"].to_numpy()] if len(key) else key
        order = np.argsort(key)
        ends = np.linspace(0, len(key), SHARDS + 1).astype(int)
        return [(key[order[a:b]], value[order[a:b]]) for a, b in zip(ends, ends[1:])]

    model = Model(three, two, words_of, bits, table)
    if RUNS is not None:
        iter(model)
    return vocabularies, model, stands_for


def looked_up(keys: np.ndarray, shards: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Value of every key, NaN where no shard has it."""
    result = np.full(len(keys), np.nan, np.float32)
    for known, values in shards:
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            result[hit] = values[at[hit]]
    return result


def log_chances(runs: np.ndarray, shards: list, numbers: int, salt: int = 0) -> np.ndarray:
    """Log-probability of the last number of every packed trigram, in the language of ``salt``."""
    distinct, back = np.unique(runs, return_inverse=True)
    mark = 1 << 62
    total = np.zeros(len(distinct))
    open_ = np.ones(len(distinct), bool)
    for order in (3, 2, 1):
        mask, tag = (1 << 16 * order) - 1, order << 56
        run = distinct[open_] & mask
        value = looked_up((run + tag) ^ salt, shards)
        hit = ~np.isnan(value)
        at = np.flatnonzero(open_)
        total[at[hit]] += value[hit]
        miss = at[~hit]
        weight = looked_up(((run[~hit] >> 16) + (tag + mark)) ^ salt, shards)
        total[miss] += np.where(np.isnan(weight), 0.0, weight)  # an unseen context weighs 1
        open_[at[hit]] = False
    total[open_] -= np.log(numbers)
    return total[back]


class Vocabularies:
    """Finds the language of a text whose own has no model."""

    def __init__(self, vocabularies: list[np.ndarray]) -> None:
        self.langs = np.repeat(np.arange(len(vocabularies)), [len(v) for v in vocabularies])
        words = np.concatenate([np.empty(0, np.int64), *vocabularies])
        order = np.argsort(words, kind="stable")
        self.words, self.langs = words[order], self.langs[order]

    def nearest(self, tokens: Tokens) -> np.ndarray:
        """Per text the language whose vocabulary has most of its words, the first of equals."""
        hashes = signed_hashes(tokens)[tokens.codes]
        low, high = (np.searchsorted(self.words, hashes, s) for s in ("left", "right"))
        many = high - low
        owner = np.repeat(tokens.owner, many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many - low, many)
        pairs, hits = np.unique(np.stack([owner, self.langs[at]]), axis=1, return_counts=True)
        best = np.lexsort((-pairs[1], hits))  # the last of a text wins
        result = np.zeros(len(tokens.counts), np.int64)
        result[pairs[0][best]] = pairs[1][best]
        return result


def squeezed(values: np.ndarray, bytes_: int = 8) -> bytes:
    """Numbers of so many bytes as planes, one for each of these: small numbers and steps need little."""
    planes = values.astype(f"<i{bytes_}").view(np.uint8).reshape(-1, bytes_).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def opened(data: bytes, n: int, bytes_: int = 8) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=bytes_ * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(bytes_, n).T).view(f"<i{bytes_}").ravel().astype(np.int64)


def stepped(keys: np.ndarray) -> bytes:
    """Ascending longs, not negative."""
    return squeezed(np.diff(keys, prepend=0))


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.diff(values, prepend=-1))


def shard_of(contexts: np.ndarray, code: int, shards: int) -> np.ndarray:
    found = mixed(contexts ^ salt(code)) % np.uint64(shards)
    return found.astype(np.uint16 if shards <= 1 << 16 else np.uint32)  # sorted faster if short


def at_keys(keys: np.ndarray, known: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values of ``keys`` among the ascending ``known``, 0 where there is none."""
    if not len(known):
        return [np.zeros(len(keys), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return [np.where(hit, v[at], 0) for v in values]


def asked(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigrams of a part's texts, then a run for the last two words of each text, whose context
    these are, so that all runs of two words are contexts; tokens per text)."""
    counts = np.array(row["_counts"], np.int64)
    numbers = opened(row["_numbers"], int(counts.sum()), 4)
    runs, sizes = trigrams(numbers, counts, bits)
    last = runs[np.cumsum(sizes) - 1] & (1 << 2 * bits) - 1
    return np.concatenate([runs, last << bits]), sizes


def spelled(rows: DataFrame, codes: dict, vocabularies: list[np.ndarray]) -> DataFrame:
    """Texts as the numbers of their words, those of PART words of one language in a row; other columns
    as lists. Texts of a language without a model are in the one whose vocabulary has most of their words."""
    known = rows.sparkSession.sparkContext.broadcast((codes, vocabularies))
    names = [c for c in rows.columns if c != "text"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, vocabularies = known.value
        numbers = [Numbers(v) for v in vocabularies or [np.empty(0, np.int64)]]
        every = Vocabularies(vocabularies)
        held: dict[int, list[tuple]] = {}
        made = TaskContext.get().partitionId() << 32

        def given(code: int) -> pa.RecordBatch:
            nonlocal made
            texts, counts, others = zip(*held.pop(code))
            counts = np.concatenate(counts)
            made += 1
            ends = pa.array([0, len(counts)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([made]), pa.array([code], pa.int32()), pa.array([int(counts.sum()) + len(counts)]),
                    pa.array([squeezed(np.concatenate(texts), 4)], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(counts)),
                    *[pa.ListArray.from_arrays(ends, pa.concat_arrays(c)) for c in zip(*others)],
                ],
                names=["_part", "_code", "_tokens", "_numbers", "_counts", *names],
            )

        for batch in steps(batches):
            found = coded(batch, codes)
            strange = np.flatnonzero(found < 0)
            if len(strange):
                found[strange] = every.nearest(Tokens(batch.column("text").take(pa.array(strange))))
            for code, part in by_language(batch, found):
                tokens = Tokens(part.column("text"))
                text = numbers[code].of(tokens)[tokens.codes].astype(np.int32)
                mine = held.setdefault(code, [])
                mine.append((text, tokens.counts, [part.column(n) for n in names]))
                if sum(len(c) + c.sum() for _, c, _ in mine) >= PART:
                    yield given(code)
        for code in list(held):
            yield given(code)

    others = "".join(f", `{n}` array<{t}>" for n, t in rows.dtypes if n != "text")
    schema = f"_part long, _code int, _tokens long, _numbers binary, _counts array<long>{others}"
    return rows.mapInArrow(spell, schema)


def questions(texts: DataFrame, bits: int, shards: int) -> DataFrame:
    """The different runs of every part, by the shard of their contexts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.sort(asked(row, bits)[0])
                keys = keys[starts_of(keys)]
                shard = shard_of(keys >> bits, row["_code"], shards)
                order = np.argsort(shard, kind="stable")
                keys, shard = keys[order], shard[order]
                starts = starts_of(shard.astype(np.int64))
                sets = np.split(keys, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[starts].astype(np.int32)), pa.array([row["_part"]] * len(sets), pa.int64()),
                        pa.array([row["_code"]] * len(sets), pa.int32()),
                        pa.array([len(x) for x in sets], pa.int64()), pa.array([stepped(x) for x in sets], pa.binary()),
                    ],
                    names=["shard", "part", "code", "size", "keys"],
                )
        release()

    asking = texts.select("_part", "_code", "_numbers", "_counts")
    return asking.mapInArrow(ask, "shard int, part long, code int, size long, keys binary")


def in_shards(counts: DataFrame, order: int, bits: int, shards: int) -> DataFrame:
    """Counts (lang, run, n) of runs of ``order`` words, by the shard of their first two words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def given() -> Iterator[pa.RecordBatch]:
            lang, run, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for code in np.unique(lang):
                mine = lang == code
                keys, own = run[mine], n[mine]
                shard = shard_of(keys >> bits if order == 3 else keys, int(code), shards)
                place = np.lexsort((keys, shard))
                keys, own, shard = keys[place], own[place], shard[place]
                starts = starts_of(shard.astype(np.int64))
                sets, ns = np.split(keys, starts[1:]), np.split(own, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[starts].astype(np.int32)), pa.array(np.full(len(sets), code, np.int32)),
                        pa.array(np.full(len(sets), order, np.int32)), pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([stepped(x) for x in sets], pa.binary()), pa.array([squeezed(x) for x in ns], pa.binary()),
                    ],
                    names=["shard", "code", "words", "size", "keys", "n"],
                )

        for batch in batches:
            if len(batch):
                held.append([batch.column(c).to_numpy() for c in ("lang", "run", "n")])
            if sum(len(x[0]) for x in held) >= LOAD:
                yield from given()
        if held:
            yield from given()
        release()

    schema = "shard int, code int, words int, size long, keys binary, n binary"
    return counts.select("lang", "run", "n").mapInArrow(deal, schema)


class Counted:
    """Counts of one language in one shard: runs of three words, of two, and of the former by context:
    all, those of runs that count as nothing, and the runs that count once, twice and more often."""

    def __init__(self, three: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], least: float, bits: int) -> None:
        self.runs, n = three
        self.two = two
        contexts = self.runs >> bits
        starts = starts_of(contexts)
        kept = n >= least
        self.n = np.where(kept, n, 0)
        self.contexts = contexts[starts]
        each = (n, n - self.n, self.n == 1, self.n == 2, self.n > 2)
        self.sums = [np.add.reduceat(x.astype(np.int64), starts) if len(n) else x for x in each]


def answered(asks: DataFrame, known: DataFrame, least: dict[int, float], bits: int) -> DataFrame:
    """For every part and shard, the counts of its runs and of their contexts, in the order of the runs."""

    def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        none = [np.empty(0, np.int64)]
        keys = np.concatenate(none + [np.cumsum(opened(r["keys"], r["size"])) for r in rows])
        n = np.concatenate(none + [opened(r["n"], r["size"]) for r in rows])
        order = np.argsort(keys, kind="stable")
        return keys[order], n[order]

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        rows = known.to_pylist() if len(asks) else []
        counted, found = {}, []
        for code in {r["code"] for r in rows}:
            three, two = (merged([r for r in rows if r["code"] == code and r["words"] == k]) for k in (3, 2))
            counted[code] = Counted(three, two, least[code], bits)
        rows.clear()
        none = (np.empty(0, np.int64),) * 2
        for ask in asks.to_pylist():
            own = counted.get(ask["code"]) or Counted(none, none, 0, bits)
            keys = np.cumsum(opened(ask["keys"], ask["size"]))
            contexts = keys >> bits
            contexts = contexts[starts_of(contexts)]
            of_contexts = [*at_keys(contexts, own.contexts, *own.sums), *at_keys(contexts, *own.two)]
            found.append(
                {
                    "shard": ask["shard"], "part": ask["part"], "runs": squeezed(at_keys(keys, own.runs, own.n)[0]),
                    "contexts": squeezed(np.concatenate(of_contexts)),
                }
            )
        return pa.Table.from_pylist(found, SCHEMA)

    schema = "shard int, part long, runs binary, contexts binary"
    return asks.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, schema)


SCHEMA = pa.schema(
    [("shard", pa.int32()), ("part", pa.int64()), ("runs", pa.binary()), ("contexts", pa.binary())]
)


def log_scores(
    rows: DataFrame, codes: dict, vocabularies: list[np.ndarray], model: Model, stands_for: np.ndarray
) -> DataFrame:
    """Replaces ``text`` by n_tokens and ``mean``, the mean log-probability of its tokens.

    Texts ask the shards of the counts for their different runs, PART words at a time, and get counts
    back. A task holds the runs of one part, or one shard's counts: LOAD on average. The tables of
    ``model`` are deleted as soon as they lie in shards.
    """
    context, bits = rows.sparkSession.sparkContext, model.bits
    texts = stored(spelled(rows, codes, vocabularies), "numbers")
    tokens = texts.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]
    rounds = max(1, min(ROUNDS, tokens // ROUND))
    shards = int((tokens // rounds + model.three.count()) // LOAD) + 1
    known = in_shards(model.three, 3, bits, shards).unionByName(in_shards(model.two, 2, bits, shards))
    known = stored(known, "counts")
    dropped(model.three, model.two)
    least = {code: of.cuts.get(3, (np.inf,))[-1] for code, of in enumerate(model.words)}
    shared = context.broadcast((model.words, np.log(stands_for)))
    names = [c for c in rows.columns if c != "text"]

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, within = shared.value
        texts = texts.combine_chunks()
        row = texts.select(["_code", "_numbers", "_counts"]).to_pylist()[0]
        runs, sizes = asked(row, bits)
        order = np.argsort(runs)
        keys = runs[order]
        starts = starts_of(keys)
        place = np.empty(len(runs), np.int64)  # of a run among the different ones
        place[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
        keys = keys[starts]
        contexts = keys >> bits
        starts = starts_of(contexts)
        of_key = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
        contexts = contexts[starts]
        shard = shard_of(contexts, row["_code"], shards)
        n, sums = np.zeros(len(keys), np.int64), np.zeros((6, len(contexts)), np.int64)
        by_shard = []
        for values in (shard[of_key], shard):
            order = np.argsort(values, kind="stable")
            by_shard.append((values[order], order))
        for answer in answers.to_pylist():
            ends = [answer["shard"], answer["shard"] + 1]
            of_keys, of_contexts = (order[slice(*np.searchsorted(s, ends))] for s, order in by_shard)
            n[of_keys] = opened(answer["runs"], len(of_keys))
            sums[:, of_contexts] = opened(answer["contexts"], 6 * len(of_contexts)).reshape(6, -1)
        own, share, shorter = chances(n, of_key, contexts, sums, words[row["_code"]], bits)
        # the last two words of a run are the context of the next one, or of the run after the texts
        end = np.cumsum(sizes) - 1
        then = place[1 : end[-1] + 2].copy()
        then[end] = place[end[-1] + 1 :]
        place = place[: end[-1] + 1]
        logs = np.log(own[place] + share[of_key[place]] * shorter[of_key[then]])
        last = runs[: len(place)] & (1 << bits) - 1
        shape = last < len(SHAPES)
        logs[shape] -= within[last[shape]]  # within a shape all words are equally likely
        mean = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes)) / sizes
        return pa.Table.from_arrays(
            [*[texts[n].chunk(0).flatten() for n in names], pa.array(sizes), pa.array(mean)],
            names=[*names, "n_tokens", "mean"],
        )

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text") + ", n_tokens long, mean double"
    scored = None
    for k in range(rounds):
        some = texts.where(F.pmod(F.xxhash64("_part"), F.lit(rounds)) == k)
        answers = stored(answered(questions(some, bits, shards), known, least, bits), "answers", large=True)
        found = some.groupBy("_part").cogroup(answers.groupBy("part")).applyInArrow(score, schema)
        found = stored(found, "log-scores", large=True)
        dropped(answers)
        scored = found if scored is None else scored.unionByName(found)
    dropped(texts, known)
    return scored


def chances(
    n: np.ndarray, of_key: np.ndarray, contexts: np.ndarray, sums: np.ndarray, words: Words, bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of a run among those of its context, after its discount; what the discounts leave of every
    context; probability of a context's last word after its first)."""
    total, lost, once, twice, more, n_two = sums
    cut1, cut2, cut3, _ = words.cuts.get(3, (0.0, 0.0, 0.0, 0.0))
    own = (n - words.discount(n, 3)) / np.maximum(total, 1)[of_key]
    taken = lost + cut1 * once + cut2 * twice + cut3 * more
    share = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
    begin, last = contexts >> bits, contexts & (1 << bits) - 1
    shorter = (n_two - words.discount(n_two, 2)) / np.maximum(words.total, 1)[begin]
    return own, share, shorter + words.weight[begin] * words.chance[last]


def classify(
    docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, lang, n_tokens (words and one end), perplexity, limit, kept,
    and ``row_key``, a hash of the text.

    ``trusted`` holds the ids of trusted documents. A hash of the id splits them: one half trains
    the models, the other half sets the limits; all of either does. The LANGUAGES with the most trusted words have models. Limits of a
    language and length class lean on those of the language, and these on those of all languages,
    by their numbers of documents. A document is kept if its perplexity is at most the limit of its language
    and length class, and not below what the most predictable trusted texts have. Texts that a
    model was trained on are more predictable than others, and so are their copies: that lower
    limit is of these or of the other half, whichever is lower. Texts of a language without a
    model are scored by the one whose vocabulary has most of their words.

    Null, empty and blank texts are one token, the end. Null languages are a language of their
    own. Null ids are never trusted. Rows equal in all columns get equal results. With no
    trusted document at all every document is kept, with a null limit. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    ids = trusted.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    trains = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("row_key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    training = ids.where(trains)
    if training.count() <= IDS:
        training = F.broadcast(training)
    learned = rows.where(trains).join(training, "doc_id", "left_semi").select("lang", "text")
    learned = learned.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    learned = stored(learned, "trusted-texts", large=True)
    totals = learned.groupBy("lang").agg(F.sum(word_count(F.col("text"))).alias("total"))
    langs = [r["lang"] for r in totals.orderBy(F.desc("total"), "lang").limit(LANGUAGES).collect()]
    codes = {x: i for i, x in enumerate(sorted(langs, key=lambda x: (x is not None, x)))}
    trained = train_all(learned, codes)
    dropped(learned)
    scored = log_scores(rows, codes, *trained)
    size = F.lit(0)
    for end in CLASSES:
        size = size + (F.col("n_tokens") >= end).cast("int")
    scored = scored.withColumn("size", size)
    known = F.array(*[F.lit(x) for x in langs]).cast(f"array<{dict(docs.dtypes)[lang]}>")
    named = F.coalesce(F.array_contains(known, F.col("lang")), F.lit(False))
    if None in langs:
        named = named | F.col("lang").isNull()
    calibrating = scored.join(ids, "doc_id").withColumn("trained", trains).where("n_tokens > 1")
    calibrating = stored(calibrating.where(~F.col("trained") | named), "calibrating")

    def limits(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        own, seen = (F.when(F.col("trained") == t, F.col("mean")) for t in (False, True))
        found = rows.groupBy(*by).agg(
            F.percentile_approx(own, [LOW, 0.5, 1 - LOW], 10000).alias("at"),
            F.percentile_approx(seen, [0.5, 1 - LOW], 10000).alias("seen"), F.count(own).alias("docs"),
        ).where("docs > 0")
        at, seen = F.col("at"), F.col("seen")
        return found.select(
            *[F.col(c).alias(f"{name}_{c}") for c in by], F.col("docs").alias(f"{name}_docs"),
            (at[0] - ROOM * (at[1] - at[0])).alias(f"{name}_floor"),
            F.greatest(  # null where nothing of the group was trained on
                at[2] + ROOM * (at[2] - at[1]), seen[1] + ROOM * (seen[1] - seen[0])
            ).alias(f"{name}_ceiling"),
        )

    def leaning(name: str, side: str, on: Column) -> Column:
        """A group's limit, averaged with that of the larger group it leans on."""
        n, own = F.col(f"{name}_docs"), F.col(f"{name}_{side}")
        return F.when(own.isNull(), on).when(on.isNull(), own).otherwise((n * own + PRIOR * on) / (n + PRIOR))

    def side(name: str) -> Column:
        return leaning("own", name, leaning("lang", name, F.col(f"every_{name}")))

    # one row per length class, and per length class and language of the LANGUAGES largest at most:
    # they are sent to the documents, which stay where they are
    with_model = calibrating.where(named)
    own, of_lang = limits(with_model, ["lang", "size"], "own"), limits(with_model, ["lang"], "lang")
    every = F.broadcast(limits(calibrating, ["size"], "every"))
    floor, ceiling = side("floor"), side("ceiling")
    scored = scored.join(every, F.col("size") == F.col("every_size"), "left").join(
        F.broadcast(of_lang), F.col("lang").eqNullSafe(F.col("lang_lang")), "left"
    ).join(
        F.broadcast(own), F.col("lang").eqNullSafe(F.col("own_lang")) & (F.col("size") == F.col("own_size")), "left"
    )
    return scored.select(
        "doc_id", "lang", "row_key", "n_tokens", F.exp(-F.col("mean")).alias("perplexity"),
        F.exp(-floor).alias("limit"), F.coalesce(F.col("mean").between(floor, ceiling), F.lit(True)).alias("kept"),
    )
