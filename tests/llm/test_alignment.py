"""Alignment against a walk over both token sequences of each text, with the libraries' encodings."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parlance.llm import alignment
from parlance.llm.queries import BYTE_PATTERN, QUERIES, TOKENIZERS

SMALL = "/root/testdata/sf0.001"
FIRST, SECOND = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def walk():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    values = alignment.byte_values()

    def spelled(i):
        if second.is_byte(i):
            return bytes([int(second.id_to_piece(i)[3:5], 16)])
        return second.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return [], [], []
        whole = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(values[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [spelled(i) for i in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], [], []
        found, i, j, ends = [], 0, 0, [0, 0]
        mine, other = [], []
        while i < len(a) or j < len(b):
            if ends[0] <= ends[1]:
                ends[0] += len(bytes_a[i])
                mine.append(a[i])
                i += 1
            else:
                ends[1] += len(bytes_b[j])
                other.append(b[j])
                j += 1
            if ends[0] == ends[1]:
                found.append((mine, other))
                mine, other = [], []
        return a, b, found

    def run(rows):
        held = [(d, *groups(t)) for d, t in rows]
        counts = collections.Counter((g[0][-1], g[1][-1]) for *_, gs in held for g in gs)
        best = collections.Counter()
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        out = []
        for d, a, b, gs in held:
            ids = [(g[0][-1], g[1][-1]) for g in gs]
            shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in gs)
            digest = hashlib.sha256(shown.encode()).hexdigest() if gs else ""
            out.append((
                d, len(a), len(b), len(gs), len(gs), sum(counts[p] == best[p[1]] for p in ids),
                sum(counts[p] for p in ids), digest,
            ))
        return out

    return run


ODD_TEXTS = [
    " ", "  two  blanks ", "\n\tline\r\n", "a▁b", "▁", "<|endoftext|> <s></s> <unk> <0x41>", "日本語 \U0001f600\U0001f468‍\U0001f469",
    "  x", "é é ﬁ", "\x00\x07", "ab" * 9000, "x", "12345 67.89", "don't WE'LL", " lead",
]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("held", [1 << 16, 5])
def test_query_by_walk(spark, walk, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD", held)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op13_tokenizer_alignment"](spark, SMALL)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(walk([tuple(r) for r in rows]))


def test_odd_texts_by_walk(make, walk, odd, none):
    def got(docs):
        return sorted(map(tuple, alignment.align_documents(docs, FIRST, BYTE_PATTERN, SECOND).collect()), key=key)

    rows = [(k, t, "en", "a", 1) for k, t in enumerate(ODD_TEXTS)]
    assert got(make(rows)) == sorted(walk([r[:2] for r in rows]), key=key)
    want = walk([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert got(odd) == sorted(want, key=key) and got(none) == []


def test_tables():
    values = alignment.byte_values()
    assert sorted(values.values()) == list(range(256)) and values["Ġ"] == 32 and values["Ċ"] == 10
    same = alignment.same_bytes(pa.array([b"a", b"", b"b"], pa.large_binary()), pa.array([b"a", b"x", b"a"], pa.large_binary()))
    assert same.tolist() == [2, -1, -1]
    vocabulary = alignment.read_byte_vocabulary(FIRST)
    assert len(vocabulary) == 50_256 and np.unique(list(vocabulary.values())).size == 50_256
