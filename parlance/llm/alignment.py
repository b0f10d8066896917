"""Alignment of two tokenizers' encodings of the same texts, and corpus-wide counts of linked ids.

Byte offsets at which tokens of both sides end cut a text into groups; the two tokens that end
there are linked. Nearly all groups are one token on each side with the same bytes, so the link
is that of an id with its same-bytes id, known beforehand: these are counted in a vector as long as
the vocabulary. Only links of other groups become (id, id) rows that are shuffled and counted.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, steps, stored
from parlance.llm.pieces import Pieces

#: Most frequent irregular pairs that every task holds; a rarer one has less than this part of all links.
HELD = 1 << 16
#: Text that is aligned at once; its tokens and their places take about a hundred times as much.
ALIGNED = 1 << 20


def byte_values() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones are
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + k): b for k, b in enumerate(others)}


def read_byte_vocabulary(path: str) -> dict[bytes, int]:
    """Bytes -> id of a byte-level merge vocabulary (JSON), without its special tokens."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
    values = byte_values()
    return {
        bytes(values[c] for c in token): i
        for token, i in model["model"]["vocab"].items() if token not in special
    }


class ByteTokenizer:
    """Byte-level merges: a token is joined from the two parts whose joint id is lowest, first."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding(
            "alignment", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}
        )

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, each with a blank before it."""
        found = [np.array(self.encoding.encode_ordinary(f" {t}"), np.int32) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return offsets, np.concatenate(found) if found else np.zeros(0, np.int32)


def _table(values: dict[bytes, int] | pa.Array) -> pa.Array:
    """Bytes of each id; ids without an entry have none."""
    if isinstance(values, pa.Array):
        return values
    table = [b""] * (max(values.values(), default=-1) + 1)
    for token, i in values.items():
        table[i] = token
    return pa.array(table, pa.large_binary())


def same_bytes(first: pa.Array, second: pa.Array) -> np.ndarray:
    """For every id of ``first`` the id of ``second`` with the same bytes, or -1; where several have
    them, the last one, which is a piece of its own and no single byte of the fallback."""
    known = {x: i for i, x in enumerate(second.to_pylist()) if x}
    return np.array([known.get(x, -1) if x else -1 for x in first.to_pylist()], np.int64)


def _flat(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(bytes of all ids in a row, end of each)."""
    found = table.take(pa.array(ids))
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    data = found.buffers()[2]
    first = int(offsets[0]) if len(offsets) else 0
    body = memoryview(data).cast("B")[first : int(offsets[-1])] if data is not None else memoryview(b"")
    return body, (offsets[1:] - first).astype(np.int64)


class Aligner:
    """Both vocabularies, and the tables that an alignment looks up."""

    def __init__(self, first: pa.Array, second: pa.Array) -> None:
        self.first, self.second = first, second
        self.same = same_bytes(first, second)
        a, b = len(first), len(second)
        # decimal ids with what follows them: , or | behind a first id, , or ; behind a second one
        self.spelled = pa.array(
            [f"{i}," for i in range(a)] + [f"{i}|" for i in range(a)]
            + [f"{i}," for i in range(b)] + [f"{i};" for i in range(b)],
            pa.large_binary(),
        )

    @classmethod
    def shared(cls, vocabulary: dict[bytes, int], pattern: str, second: pa.Array) -> tuple[ByteTokenizer, Aligner]:
        """One first tokenizer and one aligner per worker process, which stays for later tasks."""
        held = sys.modules.setdefault("parlance_alignment", types.ModuleType("parlance_alignment"))
        key = (len(vocabulary), hash(frozenset(vocabulary.items())), pattern, len(second))
        if getattr(held, "key", None) != key:
            held.made = ByteTokenizer(vocabulary, pattern), cls(_table(vocabulary), second)
            held.key = key
        return held.made

    def whole(self, texts: list[bytes], offsets: np.ndarray, table: pa.Array, ids: np.ndarray) -> np.ndarray:
        """Which texts their tokens' bytes spell, after a blank."""
        body, ends = _flat(table, ids)
        ends = np.concatenate([[0], ends])
        found = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            start, stop = int(ends[offsets[k]]), int(ends[offsets[k + 1]])
            found[k] = stop - start == len(text) + 1 and body[start:stop] == b" " + text
        return found

    def align(
        self, offsets_a: np.ndarray, a: np.ndarray, offsets_b: np.ndarray, b: np.ndarray
    ) -> dict[str, np.ndarray | list]:
        """Texts of equal bytes on both sides, each with a token -> numbers and digests of each
        text's groups; links in order with the text they lie in, regular or not."""
        owner = np.repeat(np.arange(len(offsets_a) - 1), np.diff(offsets_a))
        _, ends_a = _flat(self.first, a)
        _, ends_b = _flat(self.second, b)
        at = np.searchsorted(ends_b, ends_a)  # the texts lie one behind the other on both sides
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        size_a = np.diff(last_a, prepend=-1)
        size_b = np.diff(last_b, prepend=-1)
        linked_a, linked_b = a[last_a].astype(np.int64), b[last_b].astype(np.int64)
        regular = (size_a == 1) & (size_b == 1) & (self.same[linked_a] == linked_b)
        # all ids in the order of the groups, the first side's before the second's
        group_a = np.repeat(np.arange(len(last_a)), size_a)
        group_b = np.repeat(np.arange(len(last_b)), size_b)
        place_a = np.arange(len(a)) + (last_b + 1 - size_b)[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        codes = np.empty(len(a) + len(b), np.int64)
        n, m = len(self.first), len(self.second)
        shown = a.astype(np.int64)
        shown[last_a] += n
        codes[place_a] = shown
        shown = b.astype(np.int64) + 2 * n
        shown[last_b] += m
        codes[place_b] = shown
        body, ends = _flat(self.spelled, codes)
        texts = len(offsets_a) - 1
        stops = ends[offsets_a[1:] + offsets_b[1:] - 1]
        starts = np.concatenate([[0], stops[:-1]])
        digests = [hashlib.sha256(body[s : e - 1]).hexdigest() for s, e in zip(starts.tolist(), stops.tolist())]
        return {
            "groups": np.bincount(owner[last_a], minlength=texts), "digests": digests,
            "owner": owner[last_a], "a": linked_a, "b": linked_b, "regular": regular,
        }


def _lists(owner: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def links(
    docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, model: bytes, text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` of every row and: n_a, n_b, n_groups, groups_sha256, ``regular`` (first ids
    of links with their same-bytes id, in order) and ``pairs`` (first id * size of the second
    vocabulary + second id, of all other links).

    Null and empty texts, and those that the bytes of either side's tokens do not spell, have no
    tokens: zeros, empty arrays and ''. Whole texts are encoded, in steps of a few megabytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((vocabulary, model))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(shared.value[1])
        tokenizer, aligner = Aligner.shared(shared.value[0], pattern, pieces.table)
        width = len(pieces.table)
        for batch in steps(batches, "_text", ALIGNED):
            texts = pc.fill_null(batch.column("_text"), "").cast(pa.large_string())
            used = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            texts = texts.take(pa.array(used))
            raw = texts.cast(pa.large_binary()).to_pylist()
            offsets_a, a = tokenizer.encode_all(texts.to_pylist())
            offsets_b, b = pieces.encode_all(texts)
            good = aligner.whole(raw, offsets_a, aligner.first, a)
            good &= aligner.whole(raw, offsets_b, aligner.second, b)
            if not good.all():
                a, b = a[np.repeat(good, np.diff(offsets_a))], b[np.repeat(good, np.diff(offsets_b))]
                offsets_a = np.concatenate([[0], np.cumsum(np.diff(offsets_a)[good])])
                offsets_b = np.concatenate([[0], np.cumsum(np.diff(offsets_b)[good])])
                used = used[good]
            found = aligner.align(offsets_a, a, offsets_b, b)
            rows = len(batch)
            columns = {"n_a": np.diff(offsets_a), "n_b": np.diff(offsets_b), "n_groups": found["groups"]}
            arrays = []
            for values in columns.values():
                whole = np.zeros(rows, np.int64)
                whole[used] = values
                arrays.append(pa.array(whole))
            digests = np.full(rows, "", object)
            digests[used] = found["digests"]
            owner, regular = used[found["owner"]], found["regular"]
            other = ~regular
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep], *arrays, pa.array(digests.tolist(), pa.string()),
                    _lists(owner[regular], found["a"][regular], rows, pa.int32()),
                    _lists(owner[other], found["a"][other] * width + found["b"][other], rows, pa.int64()),
                ],
                names=[*keep, *columns, "groups_sha256", "regular", "pairs"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes) + (
        ", n_a long, n_b long, n_groups long, groups_sha256 string, regular array<int>, pairs array<long>"
    )
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(encode, schema)


def count_regular(linked: DataFrame, size: int) -> DataFrame:
    """(id, n): regular links of each first id, counted per task in a vector of the vocabulary's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("regular").flatten().to_numpy(False), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"]
        )

    return linked.select("regular").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def count_pairs(linked: DataFrame) -> DataFrame:
    """(pair, n): irregular links of each pair; equal pairs of a batch are one row of the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column("pairs").flatten().to_numpy(False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return linked.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(
    docs: DataFrame, vocabulary_path: str, pattern: str, model_path: str, text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first tokenizer encodes the text after a blank, the second, which puts a blank before it
    itself, the text; neither knows special tokens. A link's count is how many links of the corpus
    join its two ids; ``n_best`` counts the links whose count is the highest of their second id,
    ties included; ``count_sum`` adds up the counts. ``groups_sha256`` digests the groups written as
    ``a1,a2|b1;a3|b2,b3``. Rows without tokens (see ``links``) have zeros and ''. Repeated rows count
    each; null and repeated ids keep their rows; other columns are not looked at; an empty table gives
    an empty result. The vocabulary files are read by the caller's process.

    The driver and every task hold one count per id and the HELD most frequent irregular pairs;
    rows of the other pairs are joined, and none of those is frequent.
    """
    spark = docs.sparkSession
    vocabulary, model = read_byte_vocabulary(vocabulary_path), Path(model_path).read_bytes()
    first, second = _table(vocabulary), Pieces.shared(model).table
    width = len(second)
    rows = links(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")),
        vocabulary, pattern, model, keep=("row", "doc_id"),
    )
    rows = stored(rows, "aligned")
    same = same_bytes(first, second)
    regular = np.zeros(len(first), np.int64)
    for r in count_regular(rows, len(first)).collect():  # one row per id at most
        regular[r["id"]] = r["n"]
    pairs = stored(count_pairs(rows), "aligned-pairs")
    best = np.zeros(width, np.int64)
    for r in pairs.groupBy((F.col("pair") % width).alias("id")).agg(F.max("n").alias("n")).collect():
        best[r["id"]] = r["n"]
    np.maximum.at(best, same[same >= 0], regular[same >= 0])
    top = pairs.orderBy(F.desc("n"), "pair").limit(HELD).collect()
    held = np.array(sorted((r["pair"], r["n"]) for r in top), np.int64).reshape(-1, 2)
    is_best = (regular == best[same]) & (same >= 0)
    tables = spark.sparkContext.broadcast((regular, is_best, held[:, 0].copy(), held[:, 1].copy(), best))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regular, is_best, pair, n, best = tables.value
        for batch in batches:
            size = len(batch)

            def owners(lists: pa.Array) -> np.ndarray:
                return np.repeat(np.arange(size), lists.value_lengths().to_numpy(False))

            def sums(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
                total = np.zeros(size, np.int64)
                np.add.at(total, owner, values)
                return total

            lists = batch.column("regular")
            ids, owner = lists.flatten().to_numpy(False), owners(lists)
            count, good = sums(owner, regular[ids]), sums(owner, is_best[ids])
            lists = batch.column("pairs")
            codes, owner = lists.flatten().to_numpy(False), owners(lists)
            known = np.zeros(len(codes), bool)
            if len(pair):
                at = np.minimum(np.searchsorted(pair, codes), len(pair) - 1)
                known = pair[at] == codes
                m, owned = n[at[known]], owner[known]
                count += sums(owned, m)
                good += sums(owned, m == best[codes[known] % width])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(good), pa.array(count),
                    _lists(owner[~known], codes[~known], size, pa.int64()),
                ],
                names=["row", "n_best", "count_sum", "rest"],
            )

    scored = rows.select("row", "regular", "pairs").mapInArrow(
        score, "row long, n_best long, count_sum long, rest array<long>"
    )
    scored = stored(scored, "aligned-scores")
    rare = scored.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("m"))
    tops = spark.createDataFrame([(i, int(x)) for i, x in enumerate(best) if x], "id long, most long")
    counted = pairs.join(F.broadcast(tops), F.col("pair") % width == F.col("id")).select(
        "pair", "n", (F.col("n") == F.col("most")).cast("long").alias("top")
    )
    rare = rare.join(counted, "pair").groupBy("row").agg(
        F.sum(F.col("m") * F.col("top")).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_count")
    )
    parts = scored.select("row", "n_best", "count_sum").join(rare, "row", "left")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(parts, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
