"""Near-duplicate texts by weighted minwise hashing of word shingles.

A text is the multiset of its runs of five words. Signatures sample from Poisson processes over
shingles and discretised weights, so that two registers agree with the probability of the
weighted Jaccard similarity; bands of registers find candidates, and multiset overlap of the
texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import (
    Tokens, components, joined, mixed, small_batches, steps, stored, window_hashes,
)

SHINGLE = 5
#: 25 bands of 5 registers miss a pair of similarity 0.8 with a probability below 1 in 20,000.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Texts of one block of a bucket.
BLOCK = 1024
NO_ID = (1 << 63) - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of every run of SHINGLE words inside a text."""
    sizes = np.maximum(np.diff(offsets) - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + offsets[:-1][owner]
    return owner, window_hashes(hashes, SHINGLE)[start] if len(start) else np.empty(0, np.uint64)


def weighted(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), each pair once, in no order."""
    key = mixed(values + mixed(owner + 1))
    rank = np.argsort(key)
    key = key[rank]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return owner[rank[first]], values[rank[first]], np.diff(np.append(first, len(key)))


def points(
    owner: np.ndarray, values: np.ndarray, weights: np.ndarray, until: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(register slot, time, identity) of all points with a time below ``until`` of their text.

    Weights are discretised at whole numbers and lie in the levels [0, 1), [1, 2), [2, 4), ...
    Each (shingle, level) is one Poisson process whose rate is the level's length. A level that
    the weight fills only in part is halved as often as needed: the bits of a point's position
    say in which half it lies, and points above the weight do not count.
    """
    found = []
    level = 0
    while len(owner):
        low = 0 if level == 0 else 1 << (level - 1)
        length = max(low, 1)
        some = weights > low
        owner, values, weights = owner[some], values[some], weights[some]
        state = mixed(values + np.uint64((level + 1) * int(GOLDEN) % (1 << 64)))
        who, top, time = owner, weights, np.zeros(len(owner))
        while len(who):
            state = mixed(state + GOLDEN)
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / length
            live = time < until[who]
            who, top, state, time = who[live], top[live], state[live], time[live]
            extra = mixed(state ^ GOLDEN)
            counts = low + (extra >> np.uint64(32)).astype(np.int64) % length < top
            register = (extra & np.uint64(0xFFFFFFFF)).astype(np.int64) % REGISTERS
            found.append((who[counts] * REGISTERS + register[counts], time[counts], state[counts]))
        level += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(owner: np.ndarray, values: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """Identity of the earliest point of every register, per text; texts without shingles get 0.
    Time is cut off where nearly all registers are full, and doubled for texts where one is not."""
    result = np.zeros(texts * REGISTERS, np.uint64)
    total = np.bincount(owner, weights, texts)
    todo = total > 0
    until = REGISTERS / np.maximum(total, 1) * (np.log(REGISTERS) + 3)
    while todo.any():
        some = todo[owner]
        slot, time, identity = points(owner[some], values[some], weights[some], until)
        best = np.full(texts * REGISTERS, np.inf)
        np.minimum.at(best, slot, time)
        full = np.isfinite(best).reshape(texts, REGISTERS).all(axis=1)
        first = (time == best[slot]) & full[slot // REGISTERS]
        result[slot[first]] = identity[first]
        todo &= ~full
        until = until * 2
    return result.reshape(texts, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Hash of every band's registers and number, per text."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, (len(signature), 1))
    cut = signature.reshape(-1, BANDS, ROWS)
    for k in range(ROWS):
        keys = mixed(keys * GOLDEN + cut[:, :, k])
    return keys.view(np.int64)


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    n = len(left)
    both = pa.chunked_array([left.cast(pa.large_string()), right.cast(pa.large_string())])
    tokens = Tokens(both.combine_chunks())
    owner, values = shingles(mixed(tokens.codes + 1), tokens.offsets)
    owner, values, counts = weighted(owner, values)
    total = np.bincount(owner, counts, 2 * n)
    # a shingle of both texts of a pair: equal hash of (pair, shingle)
    key = mixed(values + mixed(owner % n + 1))
    one = owner < n
    _, a, b = np.intersect1d(key[one], key[~one], assume_unique=True, return_indices=True)
    common = np.bincount(owner[one][a], np.minimum(counts[one][a], counts[~one][b]), n)
    union = total[:n] + total[n:] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def block_links(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the classes (root) of the texts of a block, enough to connect all classes
    that any pair of similarity ``least`` connects. Texts of the largest class are not compared
    among themselves."""
    frame = frame.drop_duplicates("node").sort_values("node").reset_index(drop=True)
    tokens = Tokens(pa.array(frame["text"], pa.large_string()))
    owner, values = shingles(mixed(tokens.codes + 1), tokens.offsets)
    owner, values, counts = weighted(owner, values)
    rank = np.argsort(owner, kind="stable")
    owner, values, counts = owner[rank], values[rank], counts[rank]
    # the k-th occurrence of a shingle is an element of its own: multisets become sets
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner, values = np.repeat(owner, counts), np.repeat(values, counts)
    _, element = np.unique(mixed(values + GOLDEN * nth.astype(np.uint64)), return_inverse=True)
    sizes = np.bincount(owner, minlength=len(frame))
    rank = np.argsort(element, kind="stable")
    postings = owner[rank]
    ends = np.cumsum(np.bincount(element))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    classes, root = np.unique(frame["root"].to_numpy(), return_inverse=True)
    largest = np.bincount(root).argmax()
    link = np.arange(len(classes))

    def find(i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    found = []
    for i in np.flatnonzero(root != largest):
        mine = element[begin[i] : begin[i + 1]]
        start = np.concatenate([[0], ends])[mine]
        span = ends[mine] - start
        place = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(start, span)
        common = np.bincount(postings[place], minlength=len(frame))
        for j in np.flatnonzero(common >= least * (sizes[i] + sizes - common) - 1e-9):
            a, b = find(root[i]), find(root[j])
            if a != b and common[j] > 0:
                link[max(a, b)] = min(a, b)
                found.append((frame["node"][i], frame["node"][j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.8
) -> DataFrame:
    """One row per input row: doc_id, class_id, kept, and ``row_key``, a hash of the text.

    Rows are in one class if a chain of links joins them: texts of equal words, and texts whose
    multisets of five-word runs have a weighted Jaccard similarity of ``least`` or more.
    class_id is the smallest id of the class; kept is true for one row of a class, that of the
    smallest id (and, among rows of this id, of the smallest row_key; rows equal in both share
    their result).

    Texts without a word (null, empty, blank) are in no class with others. Texts of under five
    words are linked only to equal ones. A null id counts as larger than any other. An empty
    table gives an empty result. Words, texts and shingles are told apart by hashes of 64 bits.

    Candidates are found in two rounds: every text of a bucket against one pivot, then, only in
    buckets that still hold several classes, the texts outside the largest class against all, in
    blocks. Neither writes out all pairs of a bucket.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"),
        F.col(text).alias("text"),
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            tokens = Tokens(batch.column("text"))
            texts = joined(tokens.flat, tokens.offsets).cast(pa.large_binary()).to_pylist()
            digests = [xxhash.xxh3_64_intdigest(x) for x in texts]
            nodes, first, copy = np.unique(
                np.array(digests, np.uint64), return_index=True, return_inverse=True
            )
            owner, values = shingles(tokens.hashes()[tokens.codes], tokens.offsets)
            one = np.zeros(len(batch), bool)
            one[first] = True  # copies are signed once
            owner, values, counts = weighted(owner[one[owner]], values[one[owner]])
            keys = band_keys(signatures(owner, values, counts, len(batch)))[first][copy]
            sizes = np.where(tokens.counts >= SHINGLE, BANDS, 0)
            flat = keys[tokens.counts >= SHINGLE].ravel()
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row_key"),
                    pa.array(nodes.view(np.int64)[copy]), pa.array(tokens.counts), bands,
                ],
                names=["doc_id", "row_key", "node", "n_words", "bands"],
            )

    signed = stored(
        rows.mapInArrow(
            sign, "doc_id long, row_key long, node long, n_words long, bands array<long>"
        ),
        "signatures",
    )
    texts = signed.where(F.size("bands") > 0).groupBy("node").agg(
        F.min(F.struct("doc_id", "row_key")).alias("at"), F.first("bands").alias("bands")
    )
    texts = stored(texts, "distinct-texts")
    banded = texts.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("other"))
    buckets = stored(buckets.where("pivot <> other").select("bucket", "pivot"), "buckets")
    shared = stored(banded.join(buckets, "bucket"), "bucket-members")
    pairs = stored(
        shared.where("node <> pivot").select("pivot", "node").distinct(), "pairs"
    )
    wanted = shared.select("node").distinct().join(texts.select("node", "at.*"), "node")
    wanted = stored(
        rows.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "text")
        .join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("row_key")))
        .select("node", "text").dropDuplicates(["node"]),
        "candidate-texts",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            good = pa.array(similarities(batch.column("text"), batch.column("pivot_text")) >= least - 1e-12)
            yield batch.select(["a", "b"]).filter(good)

    sides = pairs.join(wanted, "node").join(
        wanted.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot"
    )
    stars = sides.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "text", "pivot_text")
    links = stored(stars.mapInArrow(verify, "a long, b long"), "star-links")
    roots = components(links)

    member = shared.select("bucket", "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    mixed_up = member.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
    ).where("lo <> hi")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    left = member.join(mixed_up.select("bucket", "blocks"), "bucket").withColumn("block", block)
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")),
    )
    left = left.join(wanted, "node").withColumn("pair", F.explode(meets)).select(
        "bucket", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "node", "root", "text"
    )
    rest = left.groupBy("bucket", "i", "j").applyInPandas(
        lambda frame: block_links(frame, least), "a long, b long"
    )
    rest = stored(rest.distinct(), "block-links")
    both = components(links.unionByName(rest))

    blank = F.col("n_words") == 0
    found = signed.select("doc_id", "row_key", "node", "n_words").join(both, "node", "left")
    found = stored(found.withColumn("root", F.coalesce("root", "node")), "classes")
    order = F.coalesce("doc_id", F.lit(NO_ID))
    heads = found.where(~blank).groupBy("root").agg(
        F.min(F.struct(order.alias("order"), F.col("row_key").alias("key"))).alias("head"),
        F.min("doc_id").alias("class_id"),
    )
    return found.join(heads, "root", "left").select(
        "doc_id", F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (blank | ((order == F.col("head.order")) & (F.col("row_key") == F.col("head.key")))).alias("kept"),
        "row_key",
    )
