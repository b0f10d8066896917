"""SentencePiece encoding and decoding for merge (BPE) models, with giant texts split over tasks.

A sequence of pieces is the encoding of a text exactly if every two neighbours are the encoding of
what they spell together. So the encoding is the best path over the pieces when a step between
such neighbours scores 0 and any other step minus infinity, and every prefix of a text has one
last piece. A giant text is split into chunks. The boundary state of a path is how far a piece
reaches into the next chunk, and that piece's length; the transfer matrix of a chunk says from
which entry states which exit states are reached. Max-plus products of the matrices, taken in any
grouping, give the states at all boundaries; from these each chunk finds its own part of the path.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import shuffle_tasks, small_batches, steps, stored

#: Characters of a chunk; longer texts are split, shorter ones encoded in one go.
CHUNK = 1 << 15
#: Chunks of one block, whose matrices are multiplied in one task.
BLOCK = 64
#: Longest word that is merged step by step; the time for longer ones would grow with the square.
MERGED = 64
#: Pairs of neighbours whose fit a task remembers.
REMEMBERED = 1 << 17
SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
_START = re.compile(f"(?<!{SPACE}){SPACE}")


class Pieces:
    """Pieces of a model file: their ids and scores, and the bytes they stand for."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        p = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        if p.normalize(" a  Éﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}Éﬁ":
            raise ValueError("only models that leave the text as it is, after a blank, are supported")
        self.score: dict[str, float] = {}
        self.ids: dict[str, list[int]] = {}
        self.bytes_ = [0] * 256
        table = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_[value] = i
                table.append(bytes([value]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                table.append(b"")
            else:
                self.score[piece], self.ids[piece] = p.get_score(i), [i]
                table.append(piece.replace(SPACE, " ").encode())
        self.table = pa.array(table, pa.large_binary())
        self.prefixes = {piece[:k] for piece in self.score for k in range(1, len(piece) + 1)}
        self.longest = max(map(len, self.score))
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.score)
        self.words = None if inner else _WORDS
        self.stable: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    @classmethod
    def shared(cls, model: bytes) -> Pieces:
        """One instance per worker process and model, so that tasks share what is remembered."""
        held = sys.modules.setdefault("parlance_pieces", types.ModuleType("parlance_pieces"))
        key = f"m{hash(model)}"
        if not hasattr(held, key):
            setattr(held, key, cls(model))
        return getattr(held, key)

    def merged(self, text: str) -> list[str]:
        """Encoding by definition: the neighbours whose joint piece has the highest score are
        merged, the leftmost of equals first, until no joint piece exists. For short texts."""
        parts, get, none = list(text), self.score.get, -np.inf
        joint = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while joint and (best := max(joint)) > none:
            k = joint.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joint[k]
            if k:
                joint[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(joint):
                joint[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def forward(self, text: str, start: dict[int, int], upto: int) -> list[int]:
        """Length of the last piece at every position that the path may pass, else 0, given those
        of the entries ``start`` (BEGIN: no piece before). Pieces start before ``upto``."""
        last = [0] * (len(text) + 1)
        for at, length in start.items():
            last[at] = length
        prefixes, score, size = self.prefixes, self.score, len(text)
        begin = self.longest + 1
        for i in range(min(start, default=upto), min(upto, size)):
            length = last[i]
            if not length:
                continue
            before = text[i - length : i] if length != begin else ""
            fits = self.stable.get(before)
            if fits is None:
                if self.pairs > REMEMBERED:
                    self.stable.clear()
                    self.pairs = 0
                fits = self.stable[before] = {}
            end = i + 1
            while end <= size:
                piece = text[i:end]
                if end > i + 1 and piece not in prefixes:
                    break
                if end == i + 1 or piece in score:
                    good = fits.get(piece)
                    if good is None:
                        both = self.merged(before + piece)
                        good = fits[piece] = both == ([before, piece] if before else [piece])
                        self.pairs += 1
                    if good:
                        last[end] = end - i
                end += 1
        return last

    def path(self, last: list[int], end: int, start: dict[int, int]) -> list[int]:
        """Positions of the piece ends from the entry of the path to ``end``."""
        found = [end]
        while end not in start:
            end -= last[end]
            found.append(end)
        return found[::-1]

    def ids_of(self, text: str, cuts: list[int]) -> list[int]:
        found: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            piece = self.ids.get(text[a:b])
            found += piece or [self.bytes_[x] for x in text[a:b].encode()]
        return found

    def best_ids(self, text: str) -> list[int]:
        if len(text) <= MERGED:
            cuts = [0]
            for part in self.merged(text):
                cuts.append(cuts[-1] + len(part))
            return self.ids_of(text, cuts)
        start = {0: self.longest + 1}
        last = self.forward(text, start, len(text))
        return self.ids_of(text, self.path(last, len(text), start))

    def spelled(self, words: list[str]) -> list[list[int]]:
        """Ids of words that begin with an escaped blank, by the library's merges."""
        found = self.library.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
        return [ids or self.best_ids(SPACE) for ids in found]  # one blank alone is no text there

    def encode(self, text: str) -> list[int]:
        """Ids of a text with its blanks escaped. If no piece has a blank behind another
        character, no piece crosses into the next word, and each different word is merged once."""
        if not text or self.words is None:
            return self.best_ids(text) if text else []
        words = self.words.findall(text)
        different = list(dict.fromkeys(words))
        ids = dict(zip(different, self.spelled(different)))
        return list(chain.from_iterable(map(ids.__getitem__, words)))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of plain texts. Each different word of all texts is encoded once; texts
        with several blanks in a row, or escaped ones, are encoded one by one."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, f"^ | $|  |{SPACE}|^$").to_numpy(zero_copy_only=False)
        odd |= self.words is None
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        words = lists.flatten().dictionary_encode()
        spelled = self.library.encode(words.dictionary.to_pylist(), num_threads=1)
        spelled += [self.encode(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts.filter(pa.array(odd)).to_pylist()]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        start = np.cumsum(size) - size
        flat = np.fromiter(chain.from_iterable(spelled), np.int32, int(size.sum()))
        # every text as a run of entries of ``spelled``: its words, or the one entry of an odd text
        entries = np.ones(len(texts), np.int64)
        entries[~odd] = np.diff(lists.offsets.to_numpy())
        first = np.cumsum(entries) - entries
        owner = np.repeat(np.arange(len(texts)), entries)
        code = np.empty(len(owner), np.int64)
        code[~odd[owner]] = words.indices.to_numpy(zero_copy_only=False)
        code[first[odd]] = len(words.dictionary) + np.arange(odd.sum())
        length = size[code]
        ends = np.cumsum(length)
        place = np.arange(int(length.sum())) + np.repeat(start[code] - (ends - length), length)
        totals = np.bincount(owner, length, len(texts)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(totals)]), flat[place]

    def inside(self, text: str, lead: int, size: int) -> tuple[int, int] | None:
        """Starts of the first and last words that begin in a chunk, if there are two."""
        if self.words is None:
            return None
        first = _START.search(text, lead, lead + size)
        if first is None:
            return None
        last = first.start()
        k = text.rfind(SPACE, lead, lead + size)
        while k > last:
            if text[k - 1] != SPACE:
                last = k
                break
            k = text.rfind(SPACE, lead, k)
        return (first.start(), last) if last > first.start() else None

    def matrix(self, text: str, lead: int, size: int) -> np.ndarray:
        """Transfer matrix of the chunk ``text[lead:lead + size]``: for each entry state (offset,
        length of the piece that ends there) and each exit offset, the length of the piece that
        ends there, or 0 where no path leads. ``text`` shows as much before and behind the chunk
        as a piece may take."""
        states, begin = self.longest, self.longest + 1
        result = np.zeros((states, begin + 1, states), np.int8)
        entries = {}
        for a in range(min(states, size)):
            for length in range(1, min(lead + a, states) + 1):
                if length > a and (length == 1 or text[lead + a - length : lead + a] in self.score):
                    entries[a, length] = {lead + a: length}
        if lead == 0:
            entries = {(0, begin): {0: begin}}
        words = self.inside(text, lead, size)
        if words:  # all paths meet where a word begins
            head, tail = text[: words[0]], {words[1]: begin}
            last = self.forward(text, tail, lead + size)[lead + size : lead + size + states]
            for (a, length), start in entries.items():
                if lead + a <= words[0] and self.forward(head, start, words[0])[words[0]]:
                    result[a, length, : len(last)] = last
            return result
        look = states
        while True:
            look = min(look * 4, size)
            part = text[: lead + look + states - 1]
            ends = {}
            for key, start in entries.items():
                last = self.forward(part, start, lead + look)[lead + look : lead + look + states]
                if any(last):
                    ends[key] = last + [0] * (states - len(last))
            entries = {key: entries[key] for key in ends}
            if look == size or len({tuple(x) for x in ends.values()}) <= 1:
                break
        if look < size and ends:  # all entries share their paths from here on
            start = {k + lead + look: x for k, x in enumerate(next(iter(ends.values()))) if x}
            last = self.forward(text, start, lead + size)[lead + size : lead + size + states]
            ends = dict.fromkeys(ends, last + [0] * (states - len(last)))
        for (a, length), last in ends.items():
            result[a, length] = last
        return result

    def parts(
        self, text: str, lead: int, size: int, state: np.ndarray
    ) -> tuple[list[int], list, list[int]]:
        """(ids common to all exits, further ids for each exit, entry of each exit) of a chunk,
        given the lengths of the pieces that reach into it (by offset, 0 for none)."""
        start = {lead + a: int(x) for a, x in enumerate(state) if x}
        words = self.inside(text, lead, size)
        if words:
            head, entered = text[: words[0]], {k: x for k, x in start.items() if k <= words[0]}
            cuts = self.path(self.forward(head, entered, words[0]), words[0], entered)
            prefix = self.ids_of(head, cuts) + self.encode(text[words[0] : words[1]])
            tail = {words[1]: self.longest + 1}
            last = self.forward(text, tail, lead + size)
            ahead = [[] for _ in range(self.longest)]
            for b in range(min(self.longest, len(last) - lead - size)):
                if last[lead + size + b]:
                    ahead[b] = self.ids_of(text, self.path(last, lead + size + b, tail))
            return prefix, ahead, [cuts[0] - lead] * self.longest
        last = self.forward(text, start, lead + size)
        exits = [b for b in range(self.longest) if lead + size + b < len(last) and last[lead + size + b]]
        paths = {b: self.path(last, lead + size + b, start) for b in exits}
        common = set.intersection(*(set(x) for x in paths.values()))
        cut = max(common, default=-1)
        ahead: list[list[int]] = [[] for _ in range(self.longest)]
        entry = [0] * self.longest
        prefix: list[int] = []
        for b, cuts in paths.items():
            at = cuts.index(cut) if cut >= 0 else 0
            if cut >= 0 and not prefix:
                prefix = self.ids_of(text, cuts[: at + 1])
            ahead[b], entry[b] = self.ids_of(text, cuts[at:]), cuts[0] - lead
        return prefix, ahead, entry


def applied(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exit lengths from entry lengths: the max-plus product of a state vector and a matrix, in
    which a length stands for score 0 and 0 for minus infinity. At most one entry reaches an exit."""
    return product(state[None, :], matrix)[0]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: rows of exit lengths ``a``, continued by the transfer matrix ``b``, whose
    rows for length 0 are empty."""
    return b[np.arange(len(b)), a.astype(np.int64)].max(axis=-2)


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    found = []
    for m in frame.sort_values("part")["m"]:
        data = np.frombuffer(zstandard.decompress(m), np.int8)
        states = next(n for n in range(1, 256) if n * (n + 2) * n == len(data))
        found.append(data.reshape(states, states + 2, states))
    return found


def _packed(matrix: np.ndarray) -> bytes:
    return zstandard.compress(matrix.tobytes())


def _block_product(frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for m in _matrices(frame):
        total = m if total is None else product(total, m)
    return frame[["giant", "block"]].head(1).assign(m=_packed(total))


def _scan(matrices: list[np.ndarray], state: np.ndarray) -> list[bytes]:
    """State before each matrix."""
    found = []
    for m in matrices:
        found.append(state.astype(np.int8).tobytes())
        state = applied(state, m)
    return found


def _block_starts(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block").rename(columns={"block": "part"})
    matrices = _matrices(frame)
    first = np.zeros(len(matrices[0]), np.int8)
    first[0] = len(first) + 1  # the beginning of the text
    return pd.DataFrame(
        {"giant": frame["giant"], "block": frame["part"], "start": _scan(matrices, first)}
    )


def _chunk_starts(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("part")
    first = np.frombuffer(frame["start"].iloc[0], np.int8)
    return frame[["giant", "part"]].assign(start=_scan(_matrices(frame), first))


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """Exit state of every chunk of a text, from the last one back."""
    frame = frame.sort_values("part", ascending=False)
    state, found = 0, []
    for entry in frame["entry"]:
        found.append(state)
        state = int(entry[state])
    return frame[["giant", "part"]].assign(exit=found)


def _giant_ids(giants: DataFrame, model) -> DataFrame:
    """(giant, ids) of rows (giant, text) with one text each, of over CHUNK characters."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = Pieces.shared(model.value).longest
        for batch in steps(batches):
            for giant, text in zip(batch.column("giant").to_pylist(), batch.column("text").to_pylist()):
                text = SPACE + text.replace(" ", SPACE)
                n = len(text) // CHUNK  # the last chunk takes the rest
                for i in range(n):
                    begin, end = i * CHUNK, (i + 1) * CHUNK if i < n - 1 else len(text)
                    lead = min(begin, longest)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "giant": pa.array([giant]), "part": pa.array([i], pa.int32()),
                            "lead": pa.array([lead], pa.int32()),
                            "size": pa.array([end - begin], pa.int32()),
                            "text": pa.array([text[begin - lead : end + longest - 1]]),
                        }
                    )

    tasks = shuffle_tasks(giants.sparkSession)
    chunks = giants.mapInArrow(split, "giant long, part int, lead int, size int, text string")
    chunks = stored(chunks.repartition(tasks, "giant", "part"), "chunks")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(model.value)
        for batch in steps(batches):
            columns = (batch.column(c).to_pylist() for c in ("text", "lead", "size"))
            found = [_packed(pieces.matrix(*row)) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("giant"), batch.column("part"), pa.array(found, pa.binary())],
                names=["giant", "part", "m"],
            )

    block = F.floor(F.col("part") / BLOCK).cast("int")
    matrices = stored(
        chunks.mapInArrow(measure, "giant long, part int, m binary").withColumn("block", block),
        "matrices",
    )
    blocks = matrices.groupBy("giant", "block").applyInPandas(
        _block_product, "giant long, block int, m binary"
    )
    starts = blocks.groupBy("giant").applyInPandas(
        _block_starts, "giant long, block int, start binary"
    )
    starts = matrices.join(starts, ["giant", "block"]).groupBy("giant", "block").applyInPandas(
        _chunk_starts, "giant long, part int, start binary"
    )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(model.value)
        for batch in steps(batches):
            columns = (batch.column(c).to_pylist() for c in ("text", "lead", "size", "start"))
            found = [pieces.parts(*row, np.frombuffer(s, np.int8)) for *row, s in zip(*columns)]
            prefix, ahead, entry = zip(*found)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("giant"), batch.column("part"), pa.array(prefix, ints),
                    pa.array(ahead, pa.list_(ints)), pa.array(entry, ints),
                ],
                names=["giant", "part", "prefix", "ahead", "entry"],
            )

    traced = stored(
        chunks.join(starts, ["giant", "part"]).mapInArrow(
            trace,
            "giant long, part int, prefix array<int>, ahead array<array<int>>, entry array<int>",
        ),
        "traced-chunks",
    )
    exits = traced.select("giant", "part", "entry").groupBy("giant").applyInPandas(
        _exits, "giant long, part int, exit int"
    )
    ids = F.concat("prefix", F.get("ahead", F.col("exit")))
    return (
        traced.join(exits, ["giant", "part"]).groupBy("giant")
        .agg(F.sort_array(F.collect_list(F.struct("part", ids.alias("ids")))).alias("parts"))
        .select("giant", F.flatten(F.col("parts.ids")).alias("ids"))
    )


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``out`` (which must be a new name): the ids that a merge model
    gives the whole text, with byte ids for characters without a piece.

    Null and empty texts have no ids. Texts of over CHUNK characters are encoded in chunks, with
    the result of one pass. Equal giant texts are encoded once. Giant texts are told apart by
    64-bit hashes. The model file is read by the caller's process.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    names = docs.columns
    if out in names:
        raise ValueError(f"{out} is a column already")
    giant = F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) > CHUNK

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(model.value)
        for batch in steps(batches, text):
            ends, flat = pieces.encode_all(batch.column(text))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, out])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{out}` array<int>"
    plain = docs.where(~giant).mapInArrow(short, schema)
    row = F.struct(*[F.col(f"`{n}`") for n in names])  # no name of a column meets one of ours
    large = docs.where(giant).select(row.alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("giant"))
    once = large.select("giant", F.col("row")[text].alias("text"))
    ids = _giant_ids(once.dropDuplicates(["giant"]), model)
    large = large.join(ids, "giant").select(*[F.col("row")[n].alias(n) for n in names], F.col("ids").alias(out))
    return plain.unionByName(large)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that ids stand for, in place of ``ids``; ``out`` must be a new name. Bytes that
    are no UTF-8 become U+FFFD; null ids become null, ids of control pieces nothing. The text of
    encode() comes back exactly, unless it holds U+2581, which comes back as a blank. Repeated
    rows each come back; an empty table gives an empty result."""
    small_batches(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    names = [n for n in encoded.columns if n != ids]
    if out in names:
        raise ValueError(f"{out} is a column already")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces.shared(model.value).table
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                lists = part.column(ids)
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))])
                flat = table.take(pc.list_flatten(lists))
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                found = pc.binary_join(runs, pa.scalar(b"", pa.large_binary())).to_pylist()
                texts = [x[1:].decode("utf-8", "replace") if x[:1] == b" " else x.decode("utf-8", "replace") for x in found]
                texts = [None if null else x for null, x in zip(pc.is_null(lists).to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, out]
                )

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes if n != ids)
    return encoded.mapInArrow(spell, f"{schema}, `{out}` string")
