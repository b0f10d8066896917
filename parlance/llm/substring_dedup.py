"""Removal of repeated passages by super-k-mer partitioning.

A window of words belongs to the bucket of its minimiser: the run of a few words in it with the
smallest hash. Consecutive windows with the same minimiser travel to their bucket as one packed
string. All occurrences of a window meet in one bucket, where sorting finds the first document
of each exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Tokens, joined, mixed, release, shuffle_tasks, small_batches, steps, window_hashes

#: Words of a minimiser.
SEED_WORDS = 10
#: Text that the windows of one bucket come from; travelling windows overlap, hence the factor.
BUCKET_BYTES, OVERLAP = 3 << 20, 4
#: One document in SAMPLE is looked at for runs of words that stand in more than one of HOT of
#: them; such runs are minimisers only where a window has no other. This only moves work around.
SAMPLE, HOT, HOT_RUNS = 64, 200, 1 << 16
#: Effort of squeezing; texts that all tasks squeeze against, and characters of each.
LEVEL, COMMON, COMMON_CHARS = 3, 64, 2048
NO_ID = (1 << 63) - 1


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every run of ``size`` values, by doubling."""
    if len(values) < size:
        return values[:0]
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def minimisers(tokens: Tokens, window: int, hot: np.ndarray) -> np.ndarray:
    """Hash of the minimiser of every window, by its first word; runs in ``hot`` come last."""
    seeds = window_hashes(tokens.hashes()[tokens.codes], min(SEED_WORDS, window))
    seeds >>= np.uint64(1)
    if len(hot):
        seeds[np.isin(seeds, hot)] |= np.uint64(1 << 63)
    return sliding_min(seeds, window - min(SEED_WORDS, window) + 1)


def super_runs(
    offsets: np.ndarray, least: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window) of every run of windows that share a minimiser."""
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + offsets[:-1][owner]
    if not len(start):
        return owner, start, start
    found = least[start]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return owner[first], start[first], start[last]


def pack(
    batch: pa.RecordBatch, window: int, buckets: int, hot: np.ndarray, common: bytes = b""
) -> Iterator[tuple]:
    """(bucket, records, strings) of the windows of a batch of (order, key, text).

    A string that a smaller document of the batch sends too is not sent again: all its windows
    are known to repeat, which its record says by an empty string and its last window. ``common``
    is text that the strings are squeezed against: a bucket gets the less of a batch the more
    buckets there are, too little to be squeezed well by itself.
    """
    order = batch.column("order").to_numpy(zero_copy_only=False)
    ranks = np.argsort(order, kind="stable")
    order, key = order[ranks], batch.column("key").to_numpy(zero_copy_only=False)[ranks]
    tokens = Tokens(batch.column("text").take(pa.array(ranks)))
    if len(tokens.codes) < window:
        return
    least = minimisers(tokens, window, hot)
    owner, first, last = super_runs(tokens.offsets, least, window)
    whole = joined(tokens.flat, np.array([0, len(tokens.flat)]))
    data = memoryview(whole.cast(pa.large_binary())[0].as_buffer())
    sizes = pc.binary_length(tokens.vocabulary).to_numpy()[tokens.codes] + 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bucket = (mixed(least[first]) % np.uint64(buckets)).astype(np.int64)
    parts, rows = defaultdict(list), defaultdict(list)
    seen: dict[bytes, int] = {}
    begin, stop = ends[first].tolist(), (ends[last + window] - 1).tolist()
    place = (first - tokens.offsets[owner]).tolist()
    count = (last - first + 1).tolist()
    for b, o, k, x, y, p, n in zip(
        bucket.tolist(), order[owner].tolist(), key[owner].tolist(), begin, stop, place, count
    ):
        string = bytes(data[x:y])
        if seen.setdefault(string, o) < o:
            string = b""
        parts[b].append(string)
        rows[b].append((o, k, p, n, len(string)))
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    squeeze_text = zstandard.ZstdCompressor(level=LEVEL, dict_data=known_text(common)).compress
    for b, strings in parts.items():
        yield b, squeeze(np.array(rows[b], np.int64).tobytes()), squeeze_text(b"".join(strings))


def known_text(common: bytes) -> zstandard.ZstdCompressionDict | None:
    if not common:
        return None
    found = zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    found.precompute_compress(level=LEVEL)
    return found


def repeated(records: np.ndarray, strings: pa.Array, window: int) -> pd.DataFrame:
    """Spans of words of one bucket (order, key, from, to) covered by windows that also stand in
    a document of smaller order. records: (order, key, place, windows, bytes) per string."""
    known = records[records[:, 4] == 0]
    spans = [np.column_stack([known[:, :3], known[:, 2] + known[:, 3] - 1 + window])]
    records = records[records[:, 4] > 0]
    tokens = Tokens(strings)
    codes, sizes = tokens.codes, records[:, 3]
    if len(codes):
        row = np.repeat(np.arange(len(records)), sizes)
        within = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        start = tokens.offsets[row] + within
        # rolling hash: differences of running sums of code times power, scaled back
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(len(codes), base, np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(codes + 1) * power)])
            scale = np.multiply.accumulate(np.full(len(codes), inverse, np.uint64))
            value = (sums[start + window] - sums[start]) * scale[start]
        order = records[row, 0]
        rank = np.lexsort((order, value))
        value, start, order, row, within = (x[rank] for x in (value, start, order, row, within))
        new = np.concatenate([[True], value[1:] != value[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = np.flatnonzero(order[head] < order)
        same = np.ones(len(later), bool)
        for k in range(window):  # equal hashes are compared word by word
            same &= codes[start[later] + k] == codes[start[head[later]] + k]
        bad = np.unique(head[later[~same]])
        later = later[same]
        if len(bad):  # different windows with one hash: compared as texts
            inside = np.flatnonzero(np.isin(head, bad))
            firsts: dict[bytes, int] = {}
            texts = [codes[start[i] : start[i] + window].tobytes() for i in inside]
            for i, x in zip(inside, texts):
                firsts[x] = min(firsts.get(x, int(order[i])), int(order[i]))
            again = [i for i, x in zip(inside, texts) if firsts[x] < order[i]]
            later = np.concatenate([later[~np.isin(head[later], bad)], np.array(again, np.int64)])
        later = later[np.lexsort((within[later], row[later]))]
        if len(later):
            r, w = row[later], within[later]
            cut = np.flatnonzero((r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)) + 1
            a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(r)]]) - 1
            at = records[r[a]]
            spans.append(
                np.column_stack([at[:, :2], at[:, 2] + w[a], at[:, 2] + w[b] + window])
            )
    found = np.concatenate(spans)
    return pd.DataFrame(found, columns=["order", "key", "from", "to"])


def hot_runs(rows: DataFrame, window: int) -> np.ndarray:
    """Hashes of runs of words that stand in over one in HOT sampled documents, at most
    HOT_RUNS of them."""
    sample = rows.where(F.pmod("key", F.lit(SAMPLE)) == 0)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            tokens = Tokens(batch.column("text"))
            seeds = window_hashes(tokens.hashes()[tokens.codes], SEED_WORDS) >> np.uint64(1)
            pairs = pd.DataFrame({"o": tokens.owner[: len(seeds)], "s": seeds}).drop_duplicates()
            found, n = np.unique(pairs["s"].to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"]
            )

    documents = sample.count()
    counts = sample.mapInArrow(runs, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    hot = counts.where(F.col("n") * HOT > max(documents, HOT)).orderBy(F.desc("n"), "s")
    return np.array([r[0] for r in hot.limit(HOT_RUNS).collect()], np.uint64)


def common_text(rows: DataFrame) -> Broadcast[bytes]:
    """The beginnings of a few texts, to squeeze others against; which ones changes no result."""
    some = rows.where("text is not null").limit(COMMON).select(F.substring("text", 1, COMMON_CHARS))
    return rows.sparkSession.sparkContext.broadcast("\n".join(r[0] for r in some.collect()).encode())


def squeezed(rows: DataFrame, common: Broadcast[bytes]) -> DataFrame:
    """The rows with ``text`` as squeezed bytes and its length as ``size``: the shuffle's own
    compression gains next to nothing on texts."""
    names = [c for c in rows.columns if c != "text"]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_text(common.value)
        for batch in steps(batches):
            compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress
            texts = batch.column("text").cast(pa.large_binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            small = [None if x is None else compress(x) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], sizes, pa.array(small, pa.binary())],
                names=[*names, "size", "text"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInArrow(squeeze, f"{schema}, size long, text binary")


def repeated_spans(rows: DataFrame, window: int, common: Broadcast[bytes]) -> DataFrame:
    """(order, key, from, to): word spans, which may overlap, covered by repeated windows."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_tasks(rows.sparkSession), OVERLAP * size // BUCKET_BYTES + 1)
    hot = rows.sparkSession.sparkContext.broadcast(hot_runs(rows, window))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = list(zip(*pack(batch, window, buckets, hot.value, common.value)))
            if found:
                kinds = (pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(found, kinds)],
                    names=["bucket", "records", "strings"],
                )

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor().decompress
        expand_text = zstandard.ZstdDecompressor(dict_data=known_text(common.value)).decompress
        records = np.concatenate(
            [np.frombuffer(expand(x), np.int64).reshape(-1, 5) for x in frame["records"]]
        )
        data = b"".join(expand_text(x) for x in frame["strings"])
        sizes = records[records[:, 4] > 0, 4]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        strings = pa.Array.from_buffers(
            pa.large_string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)]
        )
        found = repeated(records, strings, window)
        release()
        return found

    packed = rows.mapInArrow(send, "bucket int, records binary, strings binary")
    return packed.groupBy("bucket").applyInPandas(
        count, "order long, key long, from int, to int"
    )


def remove_repeats(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 50,
    keep: tuple[str, ...] = (), untouched: bool = False,
) -> DataFrame:
    """One row per input row: id, the columns ``keep``, n_words, n_removed, kept_text.

    Every word covered by a window of ``window`` consecutive words whose words also stand, in
    this order, in a document with a smaller id is removed; kept_text joins the others by one
    blank. Windows are judged on the input. Repeats inside one document stay. With ``untouched``,
    texts of which nothing is removed come back as they are, white space and null included.

    Null texts have no words. A null id counts as larger than any other, and equal ids (null
    ones too) as neither smaller nor larger. Rows equal in id and text get equal results. Texts
    shorter than a window keep all words; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("order"),
        F.xxhash64(id_col, text).alias("key"), F.col(text).alias("text"),
    )
    common = common_text(rows)
    spans = repeated_spans(rows.select("order", "key", "text"), window, common)
    spans = spans.groupBy("order", "key").agg(
        F.collect_list("from").alias("from"), F.collect_list("to").alias("to")
    )
    names = ["doc_id", *[f"_keep_{c}" for c in keep]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=known_text(common.value)).decompress
        for batch in steps(batches, "size"):
            small = batch.column("text").to_pylist()
            texts = pa.array([None if x is None else expand(x) for x in small], pa.large_binary())
            texts = texts.view(pa.large_string())
            tokens = Tokens(texts)
            change = np.zeros(len(tokens.codes) + 1, np.int64)
            for name, step in (("from", 1), ("to", -1)):
                lists = batch.column(name)
                at = pc.list_parent_indices(lists).to_numpy()
                np.add.at(change, pc.list_flatten(lists).to_numpy() + tokens.offsets[at], step)
            gone = np.cumsum(change)[:-1] > 0
            removed = np.bincount(tokens.owner[gone], minlength=len(batch))
            left = np.concatenate([[0], np.cumsum(tokens.counts - removed)])
            kept = joined(tokens.flat.filter(pa.array(~gone)), left)
            kept = kept.cast(pa.string())
            if untouched:
                kept = pc.if_else(pa.array(removed == 0), texts.cast(pa.string()), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names], pa.array(tokens.counts),
                    pa.array(removed.astype(np.int64)), kept,
                ],
                names=[*names, "n_words", "n_removed", "kept_text"],
            )

    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema
    )
    small = squeezed(rows, common).join(spans, ["order", "key"], "left")
    found = small.select(*names, "size", "text", "from", "to").mapInArrow(
        cut, f"{schema}, n_words long, n_removed long, kept_text string"
    )
    return found.withColumnsRenamed({f"_keep_{c}": c for c in keep})
