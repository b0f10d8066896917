"""Spelling variants: frequent words that differ by one letter from a far more frequent one.

Words are counted over all texts. One inserted, deleted or replaced letter changes the squared
distance of two words' letter counts by two at most, and their lengths by one at most. Words are
dealt to cells by length and by how many letters of each class they have, and visit the cells that
one edit can lead to; a cell's words are compared in blocks, whose letter counts are multiplied
(Gram matrix) to give all squared distances, and the edits of the few near pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

#: Runs of these letters are words; only the ASCII ones are lower-cased.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Letter classes (code point modulo this) whose counts tell cells apart.
CLASSES = 4
#: Words of a block; two blocks are compared in one task.
BLOCK = 2048
#: Near pairs verified at once, in letters.
VERIFIED = 1 << 24
#: One letter in so many runs is lost, by checksum (the noise that makes variants).
LOSS = 199


def corpus_words(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_size: int = 6, least: int = 5,
    loss: int | None = LOSS,
) -> DataFrame:
    """(word, n): words of at least ``least_size`` letters that occur ``least`` times or more.

    A run of letters loses that at place ``h % length`` where ``loss`` divides its checksum ``h``;
    a null id counts as an empty one. Shorter runs can make no word and are never cut out."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{least_size},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word: Column = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run"))
    rows = rows.select("id", word.alias("word"))
    if loss is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        rows = rows.select(F.when(h % loss == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = rows.where(F.length("word") >= least_size).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one row a word, 0 behind its end; lengths) of words up to U+00FF."""
    raw = [w.encode("latin-1") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    width = int(size.max(initial=1))
    return np.array(raw, f"S{width}").view(np.uint8).reshape(len(raw), width), size


def _cell(size: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Number of a cell; words of different cells may share one, which costs time only."""
    key = size.astype(np.uint64)
    for k in range(CLASSES):
        key = key * np.uint64(0x100000001B3) + classes[:, k].astype(np.uint64)
    return key.astype(np.int64)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word in its home cell, and in those cells that one edit of it can lead to, of the
    same length (one of each two) or one letter longer."""
    for whole in batches:
        for start in range(0, len(whole), BLOCK * 4):
            batch = whole.slice(start, BLOCK * 4)
            codes, size = _letters(batch.column("word").to_pylist())
            classes = np.stack(
                [((codes % CLASSES == k) & (codes > 0)).sum(1) for k in range(CLASSES)], 1
            ).astype(np.int64)
            rows, cells, sizes, home = [], [], [], []
            steps = [(np.zeros(CLASSES, np.int64), 0)]
            for a in range(CLASSES):
                unit = np.eye(CLASSES, dtype=np.int64)
                steps.append((unit[a], 1))
                steps += [(unit[b] - unit[a], 0) for b in range(a)]
            for step, longer in steps:
                moved = classes + step
                at = np.flatnonzero((moved >= 0).all(1))
                rows.append(at)
                cells.append(_cell(size[at] + longer, moved[at]))
                sizes.append(size[at] + longer)
                home.append(np.full(len(at), not step.any()))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(cells)),
                    pa.array(np.concatenate(home)), batch.column("word").take(at), batch.column("n").take(at),
                ],
                names=["size", "cell", "home", "word", "n"],
            )


def _histograms(codes: np.ndarray) -> np.ndarray:
    """Letter counts; a-z and U+00C0-U+00FF."""
    place = np.zeros(256, np.int64)
    place[97:123], place[192:256] = np.arange(26), np.arange(26, 90)
    row, column = np.nonzero(codes)
    flat = np.bincount(row * 90 + place[codes[row, column]], minlength=len(codes) * 90)
    return flat.reshape(len(codes), 90).astype(np.float32)


def _one_edit(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (words of lengths that differ by one at most) are one edit apart."""
    if size_a == size_b:
        return (a[:, :size_a] != b[:, :size_b]).sum(1) == 1
    if size_a > size_b:
        a, b, size_a, size_b = b, a, size_b, size_a
    same = a[:, :size_a] == b[:, :size_a]
    behind = a[:, :size_a] == b[:, 1 : size_a + 1]
    head = np.where(same.all(1), size_a, same.argmin(1))
    tail = np.where(behind.all(1), size_a, behind[:, ::-1].argmin(1))
    return head + tail >= size_a


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words one edit apart, by a Gram matrix of their letter counts."""
    (a, size_a), (b, size_b) = _letters(left), _letters(right)
    x, y = _histograms(a), _histograms(b)
    distance = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(distance < 2.5)
    keep = np.abs(size_a[i] - size_b[j]) <= 1
    i, j = i[keep], j[keep]
    good = np.zeros(len(i), bool)
    kinds = size_a[i] * (1 << 32) + size_b[j]
    order = np.argsort(kinds, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1):
        if not len(part):
            continue
        m, n = int(size_a[i[part[0]]]), int(size_b[j[part[0]]])
        step = max(1, VERIFIED // max(m, n))
        for start in range(0, len(part), step):
            at = part[start : start + step]
            good[at] = _one_edit(a[i[at]], b[j[at]], m, n)
    return i[good], j[good]


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of blocks: per word the number of its near words there and the most frequent."""
    ask, data = frame[frame["query"]], frame[frame["data"]]
    names = ["word", "n", "n_near", "form", "form_n"]
    if not len(ask) or not len(data):
        return pd.DataFrame({c: pd.Series([], dtype=object if c in ("word", "form") else np.int64) for c in names})
    i, j = near_pairs(ask["word"].tolist(), data["word"].tolist())
    word, n = ask["word"].to_numpy()[i], ask["n"].to_numpy()[i]
    other, m = data["word"].to_numpy()[j], data["n"].to_numpy()[j]
    # home words meet each other in both orders; visitors are met here only
    back = ~ask["home"].to_numpy()[i]
    pairs = pd.DataFrame(
        {
            "word": np.concatenate([word, other[back]]), "n": np.concatenate([n, m[back]]),
            "form": np.concatenate([other, word[back]]), "form_n": np.concatenate([m, n[back]]),
        }
    ).sort_values(["word", "form_n", "form"], ascending=[True, False, True], kind="stable")
    counts = pairs.groupby("word", sort=False).size()
    best = pairs.drop_duplicates("word")
    return best.assign(n_near=counts.to_numpy())[names]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of ``words`` (word, n; distinct) are one edit away, and
    the most frequent of them, the smallest by code points among equals. Words without one are
    missing. Every two blocks of a cell are compared by one task, so no cell is too large."""
    cell = ["size", "cell"]
    sent = stored(
        words.mapInArrow(_deal, "size int, cell long, home boolean, word string, n long"), "spelling-cells"
    )
    ceil = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sizes = sent.groupBy(*cell).agg(
        ceil(F.count("*")).alias("asked"), ceil(F.count_if("home")).alias("held"), F.max("home").alias("any")
    ).where("any")
    i = F.pmod(F.xxhash64("word"), F.col("asked")).cast("int")
    j = F.pmod(F.xxhash64(F.lit(2), "word"), F.col("held")).cast("int")
    # a word asks all blocks of the cell's own words; an own word is also held against all that ask
    asks = F.transform(F.sequence(F.lit(0), F.col("held") - 1), lambda x: F.struct(i.alias("i"), x.alias("j")))
    holds = F.transform(F.sequence(F.lit(0), F.col("asked") - 1), lambda x: F.struct(x.alias("i"), j.alias("j")))
    pairs = F.when(F.col("home"), F.array_union(asks, holds)).otherwise(asks)
    dealt = sent.join(sizes, cell).select(
        *cell, F.explode(pairs).alias("pair"), "home", "word", "n", i.alias("own_i"), j.alias("own_j")
    ).select(
        *cell, "pair.i", "pair.j", "home", "word", "n", (F.col("pair.i") == F.col("own_i")).alias("query"),
        (F.col("home") & (F.col("pair.j") == F.col("own_j"))).alias("data"),
    )
    found = dealt.groupBy(*cell, "i", "j").applyInPandas(
        _compare, "word string, n long, n_near long, form string, form_n long"
    )
    # of all near words the largest count, then the smallest word
    first = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) that lead to ever more frequent words: the last one.
    Each round doubles the steps taken, so the rounds grow with the logarithm of the chain."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = now.join(ahead, F.col("root") == F.col("_at"), "left")
        now = stored(
            moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct, up to U+00FF).

    ``form``: the near word of largest n (ties: smallest in code-point order) if its n is at least
    ``ratio`` times the word's, else null; ``root``: the word that forms lead to in the end, the word
    itself if it has none. An empty table gives an empty result."""
    words = stored(words.select("word", "n"), "spelling-words")
    near = stored(near_words(words), "spelling-near")
    best = F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best.getField("word").alias("form"),
        (-best.getField("less")).alias("form_n"),
    )
    found = stored(found, "spelling-forms")
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", ratio: int = 5, loss: int | None = LOSS
) -> DataFrame:
    """``variants`` of the words of all whole texts; null and empty texts have none. Equal rows
    count each; other columns are not looked at; an empty table gives an empty result."""
    return variants(corpus_words(docs, text, id_col, loss=loss), ratio)
