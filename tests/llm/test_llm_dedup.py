"""Near-duplicates, repeated windows and benchmark items against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import oracle
from encoscope.llm import components, decontam, simhash, suffix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, fp long, kd long, mask long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], DOCS)


def plain_fingerprint(text):
    folded = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", folded)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, ids):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, one in enumerate(ids):
        if one is not None:
            least[find(i)] = min(least.get(find(i), one), one)
    return [least.get(find(i)) for i in range(len(prints))]


def test_near_duplicates(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "Ab cD"), (5004, "ab\tcd"), (5005, "x"), (3, rows[3][1]), (None, rows[5][1]), (5006, "ÀB c d e")]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(i), f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_classes(prints, [i for i, _ in rows])))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).collect() == []

    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "fp", "kd", "mask"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in want})


def test_rows_are_kept_by_their_own_text(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (4, c), (None, "e f"), (None, "e f"), (None, d), (None, None), (7, b)]
    kept = [tuple(r) for r in simhash.keep_one(frame(spark, rows)).select("doc_id", "text").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (None, "e f"), (None, None)], key=str)
    assert simhash.keep_one(frame(spark, [])).collect() == []


def test_very_long_texts_have_whole_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 64)
    texts = [" ".join(f"w{k % 997}" for k in range(n)) for n in (3000, 64, 65, 66, 67)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_hot_groups_are_dealt_again(spark):
    rng = random.Random(2)
    base, prints = rng.getrandbits(64), set()
    while len(prints) < 1500:
        x = base
        for b in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(500)})
    want = plain_classes(prints, prints)
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    for group in (4096, 40):
        root = {a % (1 << 64): b for a, b in components.connected(simhash.near_links(table, group=group)).collect()}
        pairs = {(w, root.get(p, simhash._signed(p))) for p, w in zip(prints, want)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({r for _, r in pairs})


def test_masks_split_the_free_bits():
    masks = [0]
    for _ in range(simhash.LEVELS):
        masks = [c for m in masks for c in simhash.split_mask(m)]
    assert max(64 - m.bit_count() for m in masks) <= 21
    assert sorted(b for m in simhash.split_mask(0) for b in range(64) if m >> b & 1) == list(range(64))


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 3), (10, 11), (11, 10), (5, 5), (20, 21), (None, 4)] + [(100 + i, 101 + i) for i in range(60)]
    got = dict(tuple(r) for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10, 20: 20, 21: 20} | {100 + i: 100 for i in range(61)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def repeat_rows():
    rng = random.Random(1)

    def prose(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    shared = [prose(n) for n in (180, 199, 200, 201, 230, 400, 700)]
    texts = [None, "", prose(50), "a" * 300, "b" * 150, "a" * 450, "ab" * 200]
    texts += [prose(rng.randint(0, 300)) + rng.choice(shared) + prose(rng.randint(0, 300)) + rng.choice(shared) for _ in range(60)]
    texts += [texts[20]] * 3 + [texts[21][:-1] + "x", texts[22][3:], "zz" + texts[23]]
    big = prose(3000)
    texts += [big, big[:1500] + "Q" + big[1500:]]
    return list(enumerate(texts)) + [(20, texts[20])] * 2 + [(None, texts[30]), (None, prose(500)), (25, prose(300))]


@pytest.mark.parametrize(("piece", "spans"), [(1 << 20, 50_000), (500, 50_000), (1 << 20, 1)])
def test_repeated_windows(spark, monkeypatch, piece, spans):
    monkeypatch.setattr(suffix, "PIECE", piece)
    rows = repeat_rows()
    want = sorted((str(i), *p[:4]) for (i, _), p in zip(rows, plain_repeats([t for _, t in rows])))
    got = suffix.remove_repeats(frame(spark, rows), anchor_spans=spans).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_drop_repeats_keeps_rows_and_columns(spark):
    rows = repeat_rows()
    given = frame(spark, rows).selectExpr("*", "cast(length(text) as long) as n_chars")
    got = suffix.drop_repeats(given)
    assert got.schema.simpleString() == given.schema.simpleString()
    want = [(str(i), None if t is None else p[4]) for (i, t), p in zip(rows, plain_repeats([t for _, t in rows]))]
    found = got.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in found) == sorted((i, t or "") for i, t in want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)
    assert sum(r["text"] is None for r in found) == 1
    assert suffix.remove_repeats(frame(spark, [])).collect() == []


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(3)
    core = bytes(rng.choice(b"ab ") for _ in range(260))
    places = set()
    for lead in (0, 1, 17, 333):
        data = np.frombuffer(bytes(rng.choice(b"xyz") for _ in range(lead)) + core, np.uint8)
        first, n, anchor, _ = suffix.runs_of(data, np.array([len(data)]))
        places.add(tuple(int(a) - lead for f, c, a in zip(first, n, anchor) for s in range(f, f + c) if s >= lead))
    assert len(places) == 1


def plain_matches(text, items):
    words, out = decontam.words_of(text), {}
    shingles = decontam.shingles_of(words)
    for k, item in enumerate(items):
        wanted = decontam.words_of(item)
        weights, n = Counter(decontam.shingles_of(wanted)), min(len(wanted), len(words))
        if not n:
            continue
        windows = [Counter(decontam.shingles_of(words[i : i + n])) for i in range(len(words) - n + 1)]
        best = max(decontam.similarity(w, weights) for w in windows)
        if best >= 0.8:
            out[k] = best
    return out


def test_contaminated_documents(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta", "theta"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(n))

    items = [prose(n) for n in (40, 40, 60, 12, 30, 30)] + ["one two three", None, "", "!!", "dup dup dup dup dup dup dup dup"]
    items.append(items[0])
    rows = [(i, prose(rng.randint(0, 80))) for i in range(30)]
    for k, item in enumerate(items[:6]):
        words = item.split()
        rows.append((100 + k, f"{prose(20)} {item.upper()}!! {prose(9)}"))
        changed = [*words[:-1], "other"]
        rows.append((200 + k, f"{prose(5)} {' '.join(changed)} {prose(5)}"))
        words[len(words) // 2] = "other"
        rows.append((300 + k, " ".join(words)))
        rows.append((400 + k, " ".join(item.split()[: len(words) // 2])))
    rows += [(500, "x one TWO three y"), (501, None), (502, ""), (503, "dup " * 8), (504, "dup " * 30), (100, rows[30][1]), (None, items[0])]
    want = sorted((str(i), k, round(s, 9)) for i, t in rows for k, s in plain_matches(t, items).items())
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (decontam.PASS_BYTES, 300):
        got = decontam.contaminated(frame(spark, rows), table, size).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], round(r["similarity"], 9)) for r in got) == want
        kept = decontam.keep_clean(frame(spark, rows), table, size)
        assert kept.columns == ["doc_id", "text", "source", "fp", "kd", "mask"]
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in rows if not plain_matches(t, items))
    assert {i for i, _, _ in want} >= {str(100 + k) for k in range(6)}
    assert decontam.contaminated(frame(spark, []), table).collect() == []
    assert decontam.contaminated(frame(spark, rows), table.limit(0)).collect() == []


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 20)) for _ in range(40)]
    size = decontam.ItemIndex(texts).by_size[20]
    masks = [np.bitwise_or.reduce(1 << rng.choice(64, rng.integers(0, 40), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in range(400)]
    prints = size.prints[rng.integers(0, 40, 400)] ^ np.array(masks, np.uint64).view(np.uint8).reshape(-1, 8)
    window, item, _ = size.candidates(prints)
    bits = np.bitwise_count(prints[:, None, :] ^ size.prints[None]).sum(axis=2)
    assert {(int(w), int(i)) for w, i in zip(window, item)} == {(int(a), int(size.items[b])) for a, b in np.argwhere(bits <= decontam.RADIUS)}


def test_leaks_of_the_given_tables(spark):
    con = oracle.connect(SF)
    copies = set(con.execute("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))).collect()}
    assert copies and copies <= got
