"""Chat formatting, quality scores, top-k search, shards and the pipeline."""

import zlib

import numpy as np
import pytest

import oracle
from encoscope.llm import chat, quality, queries, sharding, topk
from encoscope.plans import Registered

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, name):
    item = Registered(queries.QUERIES[name], queries.SQL[name])
    assert oracle.difference(spark, name, item, oracle.connect(SF), SF) is None


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, h1 long")


def rendered(spark, rows, **more):
    return {(r["conv_id"], r["part"]): r["rendered"] for r in chat.chat_format(turns(spark, rows)).collect()}


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    rows = [(1, 0, *a), (1, 1, *b), (2, 0, *a), (2, 1, *b), (2, 2, *c), (3, 0, *a), (4, 5, *a), (4, 9, *b), (4, 10, *c), (5, 0, *b)]
    assert sorted(rendered(spark, rows)) == [(2, 0), (5, 0)]  # 4 equals 2 turn by turn, and 2 is the smaller id
    text = "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nbye\n<|end|>\n"
    assert rendered(spark, rows)[(2, 0)] == text


def test_odd_turns(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, 0, "user", ""), (None, 0, "user", "lost"), (1, 0, "user", ""), (3, 0, "user", None)]
    got = rendered(spark, rows)
    assert sorted(got) == [(1, 0), (2, 0), (3, 0)]  # a null text is no empty text
    assert got[(1, 0)] == "<|unknown|>\n\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert rendered(spark, []) == {}


def test_long_conversations_are_given_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    long = [(1, i, "user", f"t{i % 3}") for i in range(600)]
    rows = long + [(2, i, r, t) for _, i, r, t in long[:599]] + [(3, i, r, t) for _, i, r, t in long[1:]] + [(4, 1 << 60, "user", "t0")]
    got = rendered(spark, rows)
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1), (3, 2)]
    assert "".join(got[(1, p)] for p in range(3)) == "".join(f"<|user|>\n{t}\n<|end|>\n" for *_, t in long)


def plain_top(rows, k, every):
    held = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, w in {i: w for i, w in held if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in held if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "query_bytes"), [(256, 8 << 20), (4, 100)])
def test_top_k(spark, monkeypatch, block, query_bytes):
    monkeypatch.setattr(topk.forward_blocks, "__defaults__", (block,))
    monkeypatch.setattr(topk, "QUERY_BYTES", query_bytes)
    rng = np.random.default_rng(1)
    rows = [(i, [round(float(x), 1) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2001, []), (2050, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2003, [float("inf")] * 4), (None, [1.0] * 4), (2100, [0.5, 0.25])]
    rows += [(7, rows[7][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, weights int")
    got = sorted(tuple(r) for r in topk.top_k(table).collect())
    assert got == plain_top(rows, 5, 50)
    assert topk.top_k(table.limit(0)).collect() == []
    assert sorted(tuple(r) for r in topk.top_k(table.where("vec_id in (0, 50, 51)")).collect()) == plain_top([r for r in rows if r[0] in (0, 50, 51)], 5, 50)


def test_bounds_prune_and_large_products_are_exact():
    rng = np.random.default_rng(2)
    blocks = [(np.arange(b * 10, b * 10 + 10), rng.integers(-5, 5, (10, 3)) + 100 * b) for b in range(20)]
    best = topk.BestRows(np.array([-1, -2]), 3)
    scored = topk.search_group(best, np.array([[1, 1, 1], [-1, -1, -1]]), blocks)
    assert scored < 8
    for line, query in enumerate((np.ones(3, int), -np.ones(3, int))):
        plain = sorted((-int(w @ query), int(i)) for ids, weights in blocks for i, w in zip(ids, weights))[:3]
        assert [(-s, i) for s, i in zip(best.scores[line].tolist(), best.ids[line].tolist())] == plain
    big = np.array([[3 << 29, 1]])
    assert topk._product(big, big)[0, 0] == (3 << 29) ** 2 + 1
    with pytest.raises(OverflowError):
        topk._product(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_isotonic():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1, 1, 3, 1])).round(6).tolist() == [0.1, 0.35, 0.35, 0.35, 0.9][:2] + [0.35, 0.9]
    assert quality.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2.0) for i, t in rows], "doc_id long, text string, source string, label int, score double")


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.95


def test_quality_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "fine words here. " * 50), (4, "fine words here. " * 50), (None, "no id"), (6, "x" * 300_000)]
    labels = spark.createDataFrame([(4, 1), (4, 0), (1, None), (2, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.score_documents(documents(spark, rows), known).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got} == {0.5}
    kept = quality.keep_good(documents(spark, rows), labels.limit(0))
    assert kept.schema == documents(spark, rows).schema and kept.count() == len(rows)
    assert quality.score_documents(documents(spark, []), labels).collect() == []


def test_labels_are_no_input(spark):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5], "doc_id long, quality int")
    more = labels.union(spark.createDataFrame([(i, 1) for i in range(60) if not zlib.crc32(str(i).encode()) % 5], "doc_id long, quality int"))
    one, two = (sorted(tuple(r) for r in quality.score_documents(documents(spark, rows), x).collect()) for x in (labels, more))
    assert one == two


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 4), (4, 2), (1, 3)):
        places = sharding.curve(dims, bits)
        cells = sorted(range(len(places)), key=places.__getitem__)
        assert sorted(places) == list(range(1 << dims * bits))
        points = [[c >> bits * d & (1 << bits) - 1 for d in range(dims)] for c in cells]
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def check_shards(rows, got, shards=24):
    def line(i, text):
        raw = (text or "").encode()
        return (str(i), len(raw) + 8, zlib.crc32(raw))

    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(line(i, t) for i, t, *_ in rows)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)}
    assert all(held == list(range(len(held))) for held in slots.values())
    counts = [len(held) for held in slots.values()]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    order = [r["hilbert"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_shards(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, hilbert string"
    rows = [(i, "x" * (i * i % 900), ["en", "fr", None][i % 3], "hot" if i % 3 else f"s{i % 7}", 1, 9, "h") for i in range(500)]
    rows += [(1, None, None, None, None, 9, "h"), (1, None, None, None, None, 9, "h"), (None, "é", "en", "hot", 1, 9, "h"), (7, "", "", "", 0, 9, "h")]
    for some in (rows, rows[:5], []):
        got = sharding.document_shards(spark.createDataFrame(some, schema)).collect()
        check_shards(some, got)
        assert {r["law"] for r in got} <= {"rows"} and {r["grown_shard"] for r in got} <= {None}


def test_shards_of_the_given_table_prune(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    placed = sharding.hilbert_runs(documents, ["source", "lang", "n_chars"], 16, ["doc_id"])
    boxes = placed.groupBy("shard").agg({"n_chars": "max"}).collect()
    spread = placed.selectExpr("max(n_chars) m").first()["m"]
    assert sum(r[1] < spread / 4 for r in boxes) >= 4


def test_strings_with_one_beginning_are_told_apart(spark):
    names = [f"https://example.org/{k:02d}" for k in range(40)]
    rows = [(i, names[i % 40] if i % 3 else "https://hot.org", i) for i in range(1200)] + [(5000, None, 1)]
    table = spark.createDataFrame(rows, "k long, source string, _x long")
    placed = sharding.hilbert_runs(table, ["source"], 8, ["k"])
    shards = {}
    for r in placed.collect():
        shards.setdefault(r["source"], set()).add(r["shard"])
    # names that share a cell with the hot one may lie wherever its rows do
    assert sum(len(s) <= 2 for s in shards.values()) >= 30 and len(set().union(*shards.values())) == 8
    cuts = sharding.string_cuts(table, "source", 16)
    assert cuts == sorted(cuts) and 10 <= len(cuts) <= 16 and set(cuts) <= {*names, "https://hot.org"}
    assert sharding.string_cuts(table.limit(0), "source", 16) == []


def test_written_shards(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"{tmp_path}/shards"
    sharding.write_shards(sharding.hilbert_runs(documents, ["source", "n_chars"], 4, ["doc_id"]), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 4


def test_null_floats_are_lowest(spark):
    rows = [(1, None), (2, float("nan")), (3, -5.0), (4, 2.0)]
    placed = sharding.hilbert_runs(spark.createDataFrame(rows, "k long, v double"), ["v"], 4, ["k"])
    shard = {r["k"]: r["shard"] for r in placed.collect()}
    assert {shard[1], shard[2]} == {0, 1} and shard[3] == 2 and shard[4] == 3
