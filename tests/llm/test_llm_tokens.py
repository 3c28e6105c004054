"""Token ids, counts, files and packing against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from encoscope.llm import ans, counting, packing
from encoscope.llm.tokens import SPACES, Encoder, chunks
from encoscope.session import scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "a  b", "a\n\nb", " \n x", "a \n\n\n b", "don't  stop<|endoftext|> now", "a  <|endoftext|>", "\x1cfoo\x1c bar",
    "x y z", "１２ 三 foo's 'S 'll", "tab\there there", "trail \n", "é́ é", "<|startoftext|> a", "ΑΣ ΑΣ.", "İ i",
    "a\r\nb", " x   y", "A,b.C! (d) $5 x²", "ÀÉß×÷ ÿ", "\x85a\xa0b", "word%%% other### _x_",
]
TEXT = st.text(st.sampled_from(list(SPACES) + list("abcDÉß.,'!%0９三é́\x1c<|>")) | st.characters(codec="utf-8"), max_size=40)
DOCS = "doc_id long, text string, source string, item long, bucket int, part int"


@pytest.fixture(scope="module")
def pair():
    return {p: (Encoder(p), Tokenizer.from_file(p)) for p in (BYTE, WORD)}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(pair, path):
    mine, library = pair[path]
    for text in ODD:
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_equal_the_library_on_any_text(pair, text):
    for mine, library in pair.values():
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert "".join(chunks(text)) == text


@pytest.fixture(scope="module")
def counter():
    return counting.Counter(BYTE)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(pair, counter, text):
    assert counter.count(text) == len(pair[BYTE][1].encode(text, add_special_tokens=False).ids)


def test_count_cases(pair, counter):
    for text in ODD:
        assert counter.count(text) == len(pair[BYTE][1].encode(text, add_special_tokens=False).ids), text


def test_cache_stays_bounded(pair):
    mine = Encoder(BYTE)
    mine.cache.spaced.limit = mine.cache.bare.limit = mine.words.limit = 3
    text = " ".join(f"w{i} common," for i in range(50))
    assert mine.encode(text).tolist() == pair[BYTE][1].encode(text, add_special_tokens=False).ids
    assert len(mine.cache.spaced) <= 3 and len(mine.cache.spaced.older) <= 3


def test_merges_take_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert counting.merge_count(list("abc"), ranks) == 2
    assert counting.merge_count(list("ab"), ranks) == 1
    assert counting.merge_count(list("aaaa"), {("a", "a"): 0, ("aa", "aa"): 1}) == 3
    assert counting.merge_count([], ranks) == counting.merge_count(["a"], ranks) == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], DOCS)


LONG = "lorem ipsum dolor, " * 4000
ROWS = [(7, "a b c"), (3, None), (5, ""), (9, LONG), (1, "x<|endoftext|>y"), (5, "again"), (7, "a b c"), (None, "no id")]


def test_token_counts(spark, pair):
    got = sorted(tuple(r) for r in counting.token_counts(frame(spark, ROWS), BYTE).where("doc_id is not null").collect())
    want = []
    for i, text in ROWS:
        n = len(pair[BYTE][1].encode(text or "", add_special_tokens=False).ids)
        want += [(i, len((text or "").encode()), n, n > 1024)] * (i is not None)
    assert got == sorted(want)
    assert counting.token_counts(frame(spark, []), BYTE).collect() == []


def expected_starts(pair):
    ids = [(i, [*pair[BYTE][1].encode(t or "", add_special_tokens=False).ids, 0]) for i, t in ROWS]
    return ids


def test_token_files_round_trip(spark, pair):
    path = scratch_path(spark, "files")
    ans.write_tokens(frame(spark, ROWS), path, BYTE, block_tokens=64)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in ans.read_tokens(spark, path).collect())
    want = {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in expected_starts(pair)}
    assert {g[1:] for g in got} == want and len(got) == len(ROWS)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    order = [g[1] for g in got]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_token_files_of_an_empty_table(spark):
    path = scratch_path(spark, "files")
    ans.write_tokens(frame(spark, []), path, BYTE)
    assert ans.read_tokens(spark, path).collect() == []


def test_a_damaged_block_is_an_error(spark):
    path, other = scratch_path(spark, "files"), scratch_path(spark, "files")
    ans.write_tokens(frame(spark, ROWS), path, BYTE)
    spark.read.parquet(f"{path}/table").write.parquet(f"{other}/table")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.selectExpr("*").withColumn("payload_crc32", blocks["payload_crc32"] + 1).write.parquet(f"{other}/blocks")
    with pytest.raises(Exception, match="damaged"):
        ans.read_tokens(spark, other).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 9), st.integers(1, 7))
def test_coder_round_trip_and_checkpoints(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    table = ans.Table(ans.scaled(np.bincount(ids, minlength=1)))
    points, words = ans.encode(ids, table, lanes, every)
    assert ans.decode(points, words, len(ids), table, lanes, every).tolist() == ids.tolist()
    if len(ids) > 2 * lanes * every:
        middle = ans.decode(points, words, len(ids), table, lanes, every, 1, 2)
        assert middle.tolist() == ids[lanes * every : 2 * lanes * every].tolist()


def test_skewed_counts_keep_every_symbol():
    counts = np.array([10**12, 1, 0, 1] + [1] * 40_000)
    freq = ans.scaled(counts)
    assert freq.sum() & (freq.sum() - 1) == 0 and (freq[counts > 0] > 0).all() and freq[2] == 0


def check_packing(rows, pieces, capacity, tokenizer, end_id):
    want = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((str(i), k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in pieces) == sorted(want)
    bins = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece(spark, pair, monkeypatch):
    rows = ROWS + [(100 + i, "w " * (1 + i * 37 % 50)) for i in range(300)]
    for items in (25_000, 60, 20):
        monkeypatch.setattr(packing, "BUCKET_ITEMS", items)
        got = packing.pack_documents(frame(spark, rows), WORD, 64, 1).collect()
        bins = check_packing(rows, got, 64, pair[WORD][1], 1)
        least = -(-sum(r["length"] for r in got) // 64)
        assert bins <= least * (1.02 if items > 20 else 1.1) + 1
    assert packing.pack_documents(frame(spark, []), WORD).collect() == []


def test_small_buckets_need_hardly_more_sequences(spark, monkeypatch):
    rows = [(i, "w " * (1 + i * 7919 % 500)) for i in range(12_000)]
    made = {}
    for items in (25_000, 3000, 1000):
        monkeypatch.setattr(packing, "BUCKET_ITEMS", items)
        made[items] = packing.pack_documents(frame(spark, rows), WORD, 1024, 1).select("sequence_id").distinct().count()
    assert max(made.values()) <= 1.001 * made[25_000]


def test_pieces_that_share_no_sequence_stay_in_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 50)
    sizes, whole = [], packing._pack_round
    monkeypatch.setattr(packing, "_pack_round", lambda items, buckets, *rest: sizes.append((items.count(), buckets)) or whole(items, buckets, *rest))
    rows = [(i, "w " * 40) for i in range(400)] + [(1000 + i, "w " * 20) for i in range(100)]
    got = packing.pack_documents(frame(spark, rows), WORD, 64, 1)
    assert got.select("sequence_id").distinct().count() == 400
    assert all(n <= 50 * buckets for n, buckets in sizes) and len(sizes) <= 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_fills_bins(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, fills = packing.best_fit(lengths, 20)
    assert all(f <= 20 for f in fills)
    for b in range(len(fills)):
        held = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
        assert sum(n for _, n in held) == fills[b]
        assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held]])[:-1].tolist()
    # no two bins would fit into one
    least = sorted(fills)[:2]
    assert len(least) < 2 or sum(least) > 20
