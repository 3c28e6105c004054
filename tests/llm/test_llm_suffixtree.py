"""Suffix-tree scores against a plain tree over words."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from encoscope.llm import queries, suffixtree, tally

SF = "/root/testdata/sf0.01"


def plain_tokens(text):
    folded = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    return re.findall(rb"[^\x20\x09-\x0D]+", folded) + [b" end"]


def plain_scores(rows, order, least, least_gain):
    texts = [plain_tokens(t) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = defaultdict(Counter)
    for tokens, out in zip(texts, held):
        for at, word in enumerate(tokens):
            for k in range(min(at, order) + 1):
                if not out:
                    counts[tuple(tokens[at - k : at])][word] += 1
    n, v = sum(counts[()].values()), len(counts[()])
    seen = {s: sum(c.values()) for s, c in counts.items()}
    states = {()}

    def chance(context, word):
        if not context:
            return (counts[()][word] + 0.5) / (n + 0.5 * (v + 1))
        shorter = chance(context[1:], word)
        if context not in states:
            return shorter
        weight = seen[context] ** suffixtree.POWER
        return (counts[context][word] + weight * shorter) / (seen[context] + weight)

    for k in range(1, order + 1):
        for s in [s for s in seen if len(s) == k and s[1:] in states and seen[s] >= least]:
            weight, gain = seen[s] ** suffixtree.POWER, 0
            for word, c in counts[s].items():
                p = chance(s[1:], word)
                gain += c * round(1e6 * math.log10((c - 1 + weight * p) / (seen[s] - 1 + weight) / p))
            if gain > least_gain * 1e6 * seen[s]:
                states.add(s)
    out = []
    for (i, _), tokens, no in zip(rows, texts, held):
        contexts = [tuple(tokens[max(0, at - order) : at]) for at in range(len(tokens))]
        score = sum(math.log10(chance(c, w)) for c, w in zip(contexts, tokens))
        base = sum(math.log10(chance((), w)) for w in tokens)
        out.append((str(i), no, len(tokens), sum(counts[()][w] > 0 for w in tokens), n, round(base, 6), round(score, 6)))
    return sorted(out), states


def scored(spark, rows, **more):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row long, words string")
    got = suffixtree.score_documents(table, **more).collect()
    return sorted((str(r[0]), *r[1:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got)


def prose(seed, n):
    rng = random.Random(seed)
    follows = {w: [f"w{rng.randrange(30)}" for _ in range(3)] for w in (f"w{k}" for k in range(30))}
    word, rows = "w1", []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 60)):
            word = rng.choice(follows[word]) if rng.random() < 0.8 else f"W{rng.randrange(60)}"
            words.append(word)
            word = word.lower() if word.lower() in follows else "w1"
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(words)))
    return rows


ODD = [(None, "w1 w2"), (None, None), (5001, None), (5002, ""), (5003, " \n"), (5004, "W1\x0bw2\x0cW3\rw1\u00a0w2 \u0085 \x1cw1"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (5005, "ÀÉ w1")]


@pytest.mark.parametrize("block", [1 << 21, 37])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, monkeypatch, block, order):
    monkeypatch.setattr(suffixtree, "BLOCK_TOKENS", block)
    monkeypatch.setattr(suffixtree, "MIN_COUNT", 4)
    rows = prose(order, 150) + ODD
    want, states = plain_scores(rows, order, 4, suffixtree.MIN_GAIN)
    assert {len(s) for s in states} == set(range(order + 1))
    tested = {s for s in states if len(s) == 1}
    assert len(tested) < 60
    assert scored(spark, rows, order=order) == want


def test_empty_tables(spark):
    assert scored(spark, []) == []
    only_held = [(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    assert [r[1:5] for r in scored(spark, only_held)] == [(True, 3, 0, 0)] * 3


def test_contexts_help_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = suffixtree.score_documents(docs)
    assert got.count() == docs.count()
    sums = got.where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert (sums["s"] - sums["b"]) / sums["n"] > 0.02


def test_words_are_cut_at_ascii_white_space():
    texts = [t for _, t in ODD if t is not None] + ["", " a", "a ", "\x1f\x00 b"]
    tokens, words, sizes = suffixtree.word_codes(pa.array(["skip", *texts])[1:])
    assert sizes.tolist() == [len(plain_tokens(t)) for t in texts]
    flat = [w for t in texts for w in plain_tokens(t)]
    assert len({(int(words[c]), w) for c, w in zip(tokens, flat)}) == len(set(flat)) == len(set(words[tokens].tolist()))


def test_the_least_count_grows_with_the_root(spark, monkeypatch):
    assert [suffixtree.least_count(n) for n in (0, 10**6, 10**8, 10**10)] == [64, 64, 156, 1562]
    monkeypatch.setattr(suffixtree, "MIN_COUNT", 1)
    monkeypatch.setattr(suffixtree, "MIN_ROOT", 10)
    rows = prose(9, 150)
    want, states = plain_scores(rows, 2, suffixtree.least_count(sum(len(plain_tokens(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1)), suffixtree.MIN_GAIN)
    assert max(map(len, states)) == 2 and scored(spark, rows) == want


def test_the_query_needs_as_many_occurrences_in_any_corpus(spark, monkeypatch, tmp_path):
    rows = prose(9, 150)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(suffixtree, "MIN_COUNT", 4)
    monkeypatch.setattr(suffixtree, "MIN_ROOT", 1)  # stands for a corpus large enough that the root says more than 4
    want, _ = plain_scores(rows, 2, 4, suffixtree.MIN_GAIN)
    got = queries.QUERIES["op13_lm_scoring"](spark, str(tmp_path)).collect()
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), rng.integers(-9, 9, 100), rng.integers(-(1 << 62), 1 << 62, 7)):
        assert (tally.unpacked(tally.packed(values)) == values).all()
    small = rng.integers(0, 1 << 31, 50).astype(np.uint32)
    assert (tally.unpacked(tally.packed(small), np.uint32) == small).all()


@pytest.mark.parametrize("largest", [False, True])
def test_totals(spark, largest):
    rng = random.Random(4)
    given = {b: {rng.randrange(1 << 64) if rng.random() < 0.5 else 77 * k << 50: rng.randrange(-3, 9) for k in range(rng.randrange(80))} for b in range(9)}
    rows = []
    for block, numbers in given.items():
        keys = np.array(sorted(numbers), np.uint64)
        batch = tally.dealt(block, keys, np.array([numbers[int(k)] for k in keys], np.int64), 5)
        rows += batch.to_pylist()
    table = spark.createDataFrame([tuple(r.values()) for r in rows], tally.PARTS)
    step = tally.totals(table, 3, largest)
    blocks = tally.filed(spark.createDataFrame([(b,) for b in given], "block long"), "test", 4)
    want = defaultdict(list)
    for numbers in given.values():
        for k, n in numbers.items():
            want[k].append(n)
    want = {k: max(n) if largest else sum(n) for k, n in want.items()}
    got = tally.answered(blocks, [step, step], 4).toArrow().to_batches()
    for batch in got:
        for i in range(batch.num_rows):
            numbers = given[batch.column("block")[i].as_py()]
            one, two = tally.answers_of(batch, i, 2)
            assert one.tolist() == two.tolist() == [want[k] for k in sorted(numbers)]
    assert step.agg({"found": "sum"}).first()[0] == sum(n > 0 for n in want.values())


def test_coded_rows_round_trip():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3):
        for top in (2, 900, (1 << 32) - 1):
            rows = np.unique(rng.integers(0, top, (400, width), endpoint=True), axis=0)
            columns = [np.ascontiguousarray(c) for c in rows.T]
            back = tally.decoded(tally.coded(columns), width)
            assert len(back) == width and all((x == y).all() for x, y in zip(back, columns, strict=True))


def test_rows_of_numbers_take_a_fraction_of_hashes():
    rng = np.random.default_rng(3)
    rows = np.unique(np.minimum(rng.zipf(1.3, (40_000, 2)), 1 << 31), axis=0)
    hashes = np.unique(rng.integers(0, 1 << 63, len(rows)).astype(np.uint64))
    assert len(tally.coded(list(rows.T))) < 0.4 * len(tally.packed(np.diff(hashes, prepend=np.uint64(0))))


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("sign", [False, True])
def test_totals_of_rows(spark, width, sign):
    rng = random.Random(5)
    given = {b: {tuple(rng.choice([3, (1 << 32) - 1, rng.randrange(40)]) for _ in range(width)): rng.randrange(-9, 9) for _ in range(90)} for b in range(7)}
    rows, want, asked = [], Counter(), {}
    for block, numbers in given.items():
        asked[block] = sorted(numbers, key=lambda k: (k[0] % 4, k))  # equal keys go to equal buckets
        columns = [np.array(c, np.int64) for c in zip(*asked[block])]
        rows += tally.dealt_rows(block, columns[0] % 4, columns, np.array([numbers[k] for k in asked[block]])).to_pylist()
        for k, n in numbers.items():
            want[k] += n
    table = spark.createDataFrame([tuple(r.values()) for r in rows], tally.PARTS)
    blocks = tally.filed(spark.createDataFrame([(b,) for b in [*given, 99]], "block long"), "test", 4)
    step = tally.gathered(tally.totals(table, 3, width=width, sign=sign), "test", 4)
    for batch in tally.beside(blocks, [step, step]).toArrow().to_batches():
        for i in range(batch.num_rows):
            keys = asked.get(batch.column("block")[i].as_py(), [])
            assert tally.told_of(batch, i, 0).tolist() == tally.told_of(batch, i, 1).tolist() == [int(want[k] > 0) if sign else want[k] for k in keys]


def test_places_tell_keys_apart_and_are_small_for_large_totals(spark):
    rng = random.Random(6)
    given = {b: {rng.randrange(60) << 58 | rng.randrange(5): rng.randrange(9) for _ in range(70)} for b in range(6)}
    rows = []
    for block, numbers in given.items():
        keys = np.array(sorted(numbers), np.uint64)
        rows += tally.dealt(block, keys, np.array([numbers[int(k)] for k in keys], np.int64), 3).to_pylist()
    table = spark.createDataFrame([tuple(r.values()) for r in rows], tally.PARTS)
    blocks = tally.filed(spark.createDataFrame([(b,) for b in given], "block long"), "test", 4)
    step = tally.gathered(tally.totals(table, 3, bits=3), "test", 4)
    placed, counted = {}, {}
    for batch in tally.beside(blocks, [step]).toArrow().to_batches():
        for i in range(batch.num_rows):
            keys = sorted(given[batch.column("block")[i].as_py()])
            for k, place, total in zip(keys, tally.told_of(batch, i, 0, "places", np.uint32).tolist(), tally.told_of(batch, i, 0).tolist(), strict=True):
                assert placed.setdefault(k, place) == place and place % 8 == k >> 61
                counted[k] = total
    assert len(set(placed.values())) == len(placed) == len({k for n in given.values() for k in n})
    for a in placed:
        assert all(placed[a] < placed[b] for b in placed if a >> 61 == b >> 61 and counted[a] > counted[b])


def test_what_a_step_says_is_shuffled_once(spark, monkeypatch, capsys):
    given, plain = [], suffixtree.asked
    monkeypatch.setattr(suffixtree, "asked", lambda blocks, *more: (given.append(blocks), plain(blocks, *more))[1])
    monkeypatch.setattr(suffixtree, "MIN_COUNT", 4)
    assert scored(spark, prose(3, 40))
    capsys.readouterr()
    assert len(given) == 5
    for blocks in given:
        blocks.explain()
        assert "Exchange" not in capsys.readouterr().out


@pytest.mark.parametrize("share", [1, 5])
def test_events_of_frequent_contexts_go_to_several_buckets(spark, monkeypatch, share):
    monkeypatch.setattr(suffixtree, "SHARE", share)
    monkeypatch.setattr(suffixtree, "MIN_COUNT", 4)
    monkeypatch.setattr(suffixtree, "BLOCK_TOKENS", 300)
    rows = prose(11, 120) + ODD
    assert scored(spark, rows) == plain_scores(rows, 2, 4, suffixtree.MIN_GAIN)[0]
