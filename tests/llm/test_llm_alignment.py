"""Alignment of two tokenizers against a plain version from the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from encoscope.llm import alignment

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def byte_of(letter):
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in kept]
    return ord(letter) if ord(letter) in kept else rest[ord(letter) - 256]


def plain_document(a, b, text):
    """(ids, ends) of both sides, or nothing where the bytes differ."""
    if not text:
        return None
    whole = (" " + text).encode()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_raw = [bytes(map(byte_of, a.id_to_token(i))) for i in a_ids]
    b_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
    if b"".join(a_raw) != whole or b"".join(b_raw) != whole:
        return None
    return (a_ids, np.cumsum([len(x) for x in a_raw]).tolist()), (b_ids, np.cumsum([len(x) for x in b_raw]).tolist())


def plain_alignment(libraries, rows):
    docs = [plain_document(*libraries, t) for _, t in rows]
    counts = Counter()
    links = []
    for doc in docs:
        by_end = dict(zip(doc[1][1], doc[1][0])) if doc else {}
        found = [(i, by_end[e]) for i, e in zip(*doc[0]) if e in by_end] if doc else []
        links.append(found)
        counts.update(found)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for (doc_id, _), doc, found in zip(rows, docs, links):
        if doc is None:
            out.append((str(doc_id), 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted(set(doc[0][1]) & set(doc[1][1]))
        groups, low = [], 0
        sides = [dict(zip(ends, ids)) for ids, ends in doc]
        for cut in cuts:
            groups.append("|".join(",".join(str(s[e]) for e in range(low + 1, cut + 1) if e in s) for s in sides))
            low = cut
        best = sum(counts[f] == most[f[1]] for f in found)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((str(doc_id), len(doc[0][0]), len(doc[1][0]), len(cuts), len(found), best, sum(counts[f] for f in found), digest))
    return sorted(out)


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb \n c", "<|endoftext|> x <|endoftext|>", "<s> </s> <unk> <0x41>", "one\u2581two", "\u2581", "é \u0301 ﬁ ½ Å",
       "日本語テキスト", "\U0001f600 \U0001f469\u200d\U0001f4bb", "\x00 \x01\x7f", "don't we'll 12345 3.14", "\t\ttab", "\u00a0nb\u00a0sp", "\u3000wide \u2003em", "x" * 300, "ÀÖß ñ", "a b c d", "\x1ca\x1d b\x1e\x1f", "\u0085x \u0085", "\u180e\u200b z\u2028\u2029y", "١٢٣ Ⅷ ²", "I'M we'RE 's''t"]


def aligned(spark, rows):
    table = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, block long, pairs string")
    return sorted((str(r[0]), *r[1:]) for r in alignment.align_documents(table, *PATHS).collect())


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_alignment(spark, libraries, monkeypatch, segment):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    rng = random.Random(segment)
    given = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    texts = ODD + [t[:1500] for t in given] + ["".join(rng.choice("ab \n.,é日 '1") for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "a b"), (3, "a b")]
    assert aligned(spark, rows) == plain_alignment(libraries, rows)
    assert aligned(spark, []) == []


def test_whole_table_and_a_very_long_text(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", 5000)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, " ".join(t for _, t in rows[:30])), (9001, "z" * 20_000)]
    assert aligned(spark, rows) == plain_alignment(libraries, rows)


def test_overlaps_stay_in_their_groups():
    order, group, a, b = alignment.coalesced(np.array([2, 5, 6, 9]), np.array([1, 3, 5, 6, 7, 9]))
    assert group.tolist() == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2]
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (3, 4), (3, 5)]
    assert [x.tolist() for x in alignment.coalesced(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], [], [], []]
