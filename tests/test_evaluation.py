"""F1, chunk scores, tau, splits, early stopping against plain implementations."""

import random

import pytest
from pyspark.sql import functions as F

from encoscope.functions import lookups, ordered, text
from encoscope.operators import chunks, evaluate, heads, labels, logme, ranking, runs, splits

GOLD, PRED = [0, 0, 1, 1, 2, 2, 2, 0], [0, 1, 1, 1, 2, 0, 2, 0]


def test_f1_golden(spark):
    df = spark.createDataFrame([(GOLD, PRED)], "gold array<int>, pred array<int>")
    pairs = evaluate.confusion(evaluate.label_pairs(df, "gold", "pred"))
    report = evaluate.f1_report(pairs).first()
    assert tuple(report) == pytest.approx((75.0, 75.555556, 75.0), abs=1e-5)
    header = evaluate.f1_report(pairs, compat_header=True).first()
    assert tuple(header) == pytest.approx((77.777778, 81.666667, 77.777778), abs=1e-5)


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([([1, 2], [1])], "gold array<int>, pred array<int>")
    with pytest.raises(Exception, match="differ in length"):
        evaluate.label_pairs(df, "gold", "pred").collect()
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, gold string")
    right = spark.createDataFrame([(1, "a")], "id int, pred string")
    with pytest.raises(Exception, match="differ in length"):
        evaluate.align(left, right, ["id"]).collect()
    assert evaluate.align(left, right, ["id"], strict=False).count() == 2


SENTENCES = [
    ("B-LOC I-LOC O B-PER I-PER O", "B-LOC I-LOC O B-PER O B-LOC"),
    ("I-LOC B-LOC O B-PER", "B-LOC I-LOC O B-LOC"),
    ("O B-PER", "O B-PER"),
]


def sentence_frame(spark, pairs):
    return spark.createDataFrame([(g.split(), p.split()) for g, p in pairs], "gold array<string>, pred array<string>")


def test_chunks_golden(spark):
    counts = chunks.chunk_counts(sentence_frame(spark, SENTENCES))
    s = chunks.chunk_scores(counts).first()
    assert (s["tokens"], s["found"], s["predicted"], s["correct"]) == (12, 6, 6, 2)
    assert (round(s["accuracy"], 2), round(s["precision"], 2), round(s["recall"], 2), round(s["f1"], 2)) == (58.33, 33.33, 33.33, 33.33)
    report = chunks.span_report(counts)
    assert report.columns == ["accuracy:", "precision:", "recall:", "FB1:"]


def spans(tags):
    """Chunks of one sentence as (begin, end, type)."""
    open_at, found = None, []
    parts = [("O", "")] + [(t.split("-", 1) + [""])[:2] for t in tags] + [("O", "")]
    for at in range(1, len(parts)):
        (before, was), (now, kind) = parts[at - 1], parts[at]
        turn = before + now
        switched = was != kind
        if open_at is not None and (turn in chunks.END_PAIRS or before in "[]" or (before != "O" and switched)):
            found.append((open_at[0], at, open_at[1]))
            open_at = None
        if turn in chunks.START_PAIRS or now in "[]" or (now != "O" and switched):
            open_at = (at, kind)
    return found


def by_spans(pairs):
    """Counts from the sets of chunks: a chunk is right when both sides hold it."""
    tokens = ok = found = predicted = correct = 0
    for gold, pred in pairs:
        g, p = gold.split(), pred.split()
        tokens, ok = tokens + len(g), ok + sum(a == b for a, b in zip(g, p))
        gold_spans, pred_spans = spans(g), spans(p)
        found, predicted = found + len(gold_spans), predicted + len(pred_spans)
        correct += len(set(gold_spans) & set(pred_spans))
    return tokens, ok, found, predicted, correct


@pytest.mark.parametrize("prefixes", ["BIO", "BIOE", "[]O"])
def test_chunks_equal_the_sets_of_spans(spark, prefixes):
    rng = random.Random(prefixes)
    tags = [f"{p}-{k}" if p != "O" else "O" for p in prefixes for k in ("X", "Y-Z")]
    pairs = []
    for _ in range(1500):
        n = rng.randint(0, 9)
        gold = [rng.choice(tags) for _ in range(n)]
        pred = [g if rng.random() < 0.6 else rng.choice(tags) for g in gold]
        pairs.append((" ".join(gold), " ".join(pred)))
    df = sentence_frame(spark, pairs).repartition(5)
    counts = chunks.chunk_counts(df)
    sums = counts.agg(*[F.sum(c) for c in ("tokens", "tags_ok", "found", "predicted", "correct")]).first()
    assert tuple(sums) == by_spans(pairs)
    by_type = chunks.chunk_scores_by_type(counts).agg(F.sum("found"), F.sum("correct")).first()
    assert by_type[0] == sums[2] and by_type[1] == sums[4]


def test_chunks_by_key_and_raw(spark):
    df = sentence_frame(spark, SENTENCES).withColumn("run", F.when(F.size("gold") > 4, "long").otherwise("short"))
    scores = {r["run"]: (r["tokens"], r["found"]) for r in chunks.chunk_scores(chunks.chunk_counts(df, keys=["run"]), ["run"]).collect()}
    assert scores == {"long": (6, 2), "short": (6, 4)}
    raw = spark.createDataFrame([(["NN", "-", "NN"], ["NN", "NN", "NN"])], "gold array<string>, pred array<string>")
    s = chunks.chunk_scores(chunks.chunk_counts(raw, raw=True, outside="-")).first()
    assert (s["found"], s["predicted"], s["correct"]) == (2, 3, 2)


def test_sentences_from_tokens(spark):
    rows = spark.createDataFrame([(1, 1, "b", "O"), (1, 0, "a", "B-X")], "sent int, pos int, token string, gold string")
    got = chunks.sentences(rows, ["sent"], tokens="token", gold="gold").first()
    assert (got["tokens"], got["gold"]) == (["a", "b"], ["B-X", "O"])


def tau_pairs(x, y):
    n = len(x)

    def one(first, second):
        order = sorted(range(n), key=lambda i: (-first[i], -second[i]))
        rank = {i: r for r, i in enumerate(order)}
        sign = lambda v: (v > 0) - (v < 0)
        def prod(a, b):
            return sum(
                sign(a[i] - a[j]) * sign(b[i] - b[j]) * (1 / (rank[i] + 1) + 1 / (rank[j] + 1)) for i in range(n) for j in range(i)
            )
        scale = (prod(x, x) * prod(y, y)) ** 0.5
        return prod(x, y) / scale if scale else None

    a, b = one(x, y), one(y, x)
    return None if a is None or b is None else (a + b) / 2


def tau_of(spark, x, y):
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    return ranking.weighted_tau(df, ["g"], "x", "y").first()["tau"]


def test_tau_golden(spark):
    assert tau_of(spark, [12, 2, 1, 12, 2], [1, 4, 7, 1, 0]) == pytest.approx(-0.566949682, abs=1e-8)
    assert tau_of(spark, [3, 1, 2], [2, 1, 3]) == pytest.approx(0.181818182, abs=1e-8)
    assert tau_of(spark, [1, 2, 3, 4], [1, 2, 3, 4]) == pytest.approx(1.0)
    assert tau_of(spark, [1, 2, 3, 4], [-1, -2, -3, -4]) == pytest.approx(-1.0)
    assert tau_of(spark, [1, 1, 1], [1, 2, 3]) is None
    assert tau_of(spark, [1], [1]) is None


def test_tau_equals_the_pair_sum(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for g in range(60):
        n = rng.randint(2, 17)
        x = [rng.randint(0, rng.choice([3, 50])) for _ in range(n)]
        y = [rng.randint(0, rng.choice([3, 50])) for _ in range(n)]
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
        expected[g] = tau_pairs(x, y)
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r["g"]: r["tau"] for r in ranking.weighted_tau(df, ["g"], "x", "y").collect()}
    for g, tau in expected.items():
        assert got[g] == (None if tau is None else pytest.approx(tau, abs=1e-9))


def test_tau_summary_golden(spark):
    df = spark.createDataFrame([("s", "t", 0.5), ("s", "t", -0.2), ("s", "t", 0.8)], "setup string, task string, tau double")
    line = ranking.tau_summary(df).where("level = 'overall'").first()
    assert line["mean"] == pytest.approx(0.320095056, abs=1e-8)
    assert line["fisher_mean"] == pytest.approx(0.447626941, abs=1e-8)
    # 0.5 itself is not above one half
    assert (line["n_nonpositive"], line["n_above_half"], line["n_positive"]) == (1, 1, 2)


@pytest.mark.parametrize("n, sizes", [(1000, (700, 100, 200)), (5, (4, 0, 1)), (1, (1, 0, 0)), (3, (2, 0, 1))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).withColumnRenamed("id", "row")
    got = {r["split"]: r["count"] for r in splits.seeded_split(df, "row", 7).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in splits.SPLITS) == sizes
    again = splits.seeded_split(df.repartition(3), "row", 7)
    assert set(map(tuple, again.collect())) == set(map(tuple, splits.seeded_split(df, "row", 7).collect()))


def test_split_follows_the_shuffle(spark):
    df = spark.range(500).withColumnRenamed("id", "row")
    order = [r["row"] for r in splits.seeded_shuffle(df, "row", 7).orderBy("position").collect()]
    assert sorted(order) == list(range(500)) and order != sorted(order)
    parts = {r["row"]: r["split"] for r in splits.seeded_split(df, "row", 7, (0.5, 0.25, 0.25)).collect()}
    assert [parts[r] for r in order] == ["train"] * 250 + ["dev"] * 125 + ["test"] * 125
    with pytest.raises(ValueError, match="sum up"):
        splits.split_sizes(10, (0.5, 0.1, 0.1))
    with pytest.raises(ValueError, match="three"):
        splits.split_sizes(10, (0.5, 0.5))


def test_early_stop_golden(spark):
    losses = [0.9, 0.7, 0.8, 0.7, 0.75, 0.9, 0.6]
    df = spark.createDataFrame([("r", k + 1, v) for k, v in enumerate(losses)], "run string, epoch int, loss double")
    got = runs.early_stop(df, 3).first()
    assert (got["best_epoch"], got["n_saves"], got["stop_epoch"], got["kept_epoch"], got["stopped_early"]) == (2, 3, 5, 4, True)
    never = runs.early_stop(df, 50).first()
    assert (never["stop_epoch"], never["stopped_early"]) == (7, False)


def test_ordered_blocks(spark):
    rng = random.Random(2)
    ids = sorted(rng.sample(range(10_000), 400))
    rows = [(k % 2, i, rng.random() < 0.1) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "g int, at long, hit boolean")
    index = {r["at"]: r["idx"] for r in ordered.dense_index(df, "at", bits=6).collect()}
    assert index == {i: k for k, i in enumerate(ids)}
    sparse = df.withColumn("at", F.col("at") * 1_000_003 - 10**9)
    assert ordered.block_bits(df, "at") < ordered.block_bits(sparse, "at") < 42
    assert ordered.block_bits(df.limit(0), "at") == 16
    places = [r["idx"] for r in ordered.dense_index(sparse, "at").orderBy("at").collect()]
    assert places == list(range(400))
    count, value, seen, last = {}, {}, {0: 0, 1: 0}, {0: None, 1: None}
    for g, at, hit in rows:
        seen[g] += hit
        last[g] = at if hit else last[g]
        count[at], value[at] = seen[g], last[g]
    got = {r["at"]: r["n"] for r in ordered.running_count(df, F.col("hit"), "at", ["g"], bits=6).collect()}
    assert got == count
    carried = ordered.carry_forward(df, F.when(F.col("hit"), F.col("at")), "at", ["g"], bits=6).collect()
    assert {r["at"]: r["value"] for r in carried} == value


def test_lookup_joins_agree(spark):
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 7}") for i in range(300)]
    big = spark.createDataFrame(rows, "id int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    assert dict(lookups.frequent_keys(big, ["k"], 8))["hot"] >= 4
    for how in ("left", "inner", "left_semi", "left_anti"):
        near = lookups.lookup_join(big, small, "k", how)
        far = lookups.lookup_join(big, small, "k", how, max_rows=1)
        assert sorted(map(str, near.collect())) == sorted(map(str, far.select(near.columns).collect()))


def test_bounds_stop_the_fetch(spark):
    rows = spark.range(0, 2000, 1, 8).select("id", F.array_repeat(F.col("id").cast("double"), 100).alias("v"))
    assert lookups.fetch_bounded(rows, 1999) is None
    assert lookups.fetch_bounded(rows, max_bytes=100_000) is None
    held = lookups.fetch_bounded(rows)
    assert held.num_rows == 2000 and held.column_names == ["id", "v"]
    assert lookups.bounded_rows(rows.where("id < 0")).count() == 0
    evaluated = spark.sparkContext.accumulator(0)

    def counted(batches):
        evaluated.add(1)
        yield from batches

    once = spark.range(0, 80, 1, 8).mapInArrow(counted, "id long")
    assert lookups.bounded_rows(once).count() == 80 and evaluated.value == 8


def test_crowded_ids_are_cut_again(spark):
    ids = spark.range(0, 20_000, 1, 4).union(spark.createDataFrame([(1 << 60,), (-5,)], "id long"))
    cut = ordered.blocked(ids, "id", rows=500)
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert sum(sizes) == 20_002 and max(sizes) <= ordered.OVERFULL * 500
    places = ordered.dense_index(cut.drop("_block"), "id").orderBy("id").collect()
    assert [r["idx"] for r in places] == list(range(20_002))
    with pytest.raises(Exception, match="must be unique"):
        ordered.dense_index(ids.union(ids.where("id = 7")), "id").collect()


def test_align_refuses_repeated_keys(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, gold string")
    two = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, pred string")
    for strict in (True, False):
        with pytest.raises(Exception, match="comes twice in predictions"):
            evaluate.align(one, two, ["id"], strict).collect()


def test_label_maps(spark):
    index = spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_id int")
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (3, ["b"]), (4, ["a", "b"])], "id int, tags array<string>")
    for cap in (10_000, 1):
        original = lookups.literal_map
        labels.literal_map = lambda s, k, v, cap=cap: original(s, k, v, max_rows=cap)
        try:
            got = labels.map_label_arrays(rows, "tags", index, "label", "label_id", ["id"], "ids")
            assert got.columns == ["id", "tags", "ids"]
            assert sorted((r["id"], str(r["ids"])) for r in got.collect()) == [(1, "[0, 1]"), (2, "[]"), (3, "None"), (3, "[1]"), (4, "[0, 1]")]
            for strange, name in ((["z"], "z"), ([None], "NULL")):
                odd = spark.createDataFrame([(1, strange)], rows.schema)
                with pytest.raises(Exception, match=f"unknown label {name}"):
                    labels.map_label_arrays(odd, "tags", index, "label", "label_id", ["id"], "ids").collect()
        finally:
            labels.literal_map = original
    with pytest.raises(Exception, match="unknown label"):
        labels.label_ids(spark.createDataFrame([("z",)], "label string"), index).collect()
    with pytest.raises(ValueError, match="unknown task"):
        labels.for_task(rows, "other")


def test_single_texts_and_pairs(spark):
    single = spark.createDataFrame([("t", 1)], "sentence string, label int")
    pair = spark.createDataFrame([("t", "u", 1)], "q string, s string, label int")
    assert labels.joined_texts(single, "[SEP]").first()["text"] == "t"
    assert labels.joined_texts(pair, "[SEP]").first()["text"] == "t[SEP]u"


def test_run_all_reports_errors(spark, tmp_path):
    grid = runs.grid(spark.createDataFrame([("x",)], "task string"), ["e1", "e2"], ["mean"], ["linear"], [1, 2])

    def execute(row):
        if row["encoder"].endswith("e2"):
            raise RuntimeError("no")
        return row["seed"]

    done = runs.run_all(grid, execute, f"{tmp_path}/registry")
    assert sorted(str(r["error"]) for r in done.collect()) == ["None", "None", "RuntimeError: no", "RuntimeError: no"]
    left = runs.pending(grid, spark.read.parquet(f"{tmp_path}/registry"))
    assert left.count() == 2 and left.where("encoder not like '%e2'").count() == 0
    summary = runs.over_seeds(done.where("error IS NULL"), ["task", "encoder"]).first()
    assert (summary["n_seeds"], summary["mean"]) == (2, 1.5)


def test_head_learns_saves_and_loads(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for k in range(200):
        c = k % 2
        rows.append((k, [rng.gauss(3 if c else -3, 1), rng.gauss(0, 1)], "pos" if c else "neg"))
    df = spark.createDataFrame(rows, "id int, features array<double>, label string")
    index = heads.class_index(df, df)
    for name in ("linear", "mlp"):
        model = heads.train_head(df, index, name, epochs=30)
        path = str(tmp_path / name)
        heads.save_head(model, path)
        scored = heads.score_rows(df, heads.load_head(name, path), index)
        assert scored.agg(F.avg("correct")).first()[0] > 0.95
        assert {r["prediction"] for r in scored.select("prediction").distinct().collect()} == {"pos", "neg"}
    with pytest.raises(ValueError, match="unknown classifier"):
        heads.head("tree")


def test_training_by_epochs_keeps_the_best(spark):
    rng = random.Random(4)
    rows = [([rng.gauss(2 if k % 2 else -2, 2), rng.gauss(0, 1)], "ab"[k % 2]) for k in range(120)]
    df = spark.createDataFrame(rows, "features array<double>, label string")
    train, dev = df.limit(80), df
    index = heads.class_index(train, dev)
    for name in ("linear", "mlp"):
        model, log = heads.train_epochs(train, dev, index, name, epochs=6, patience=2)
        lines = log.orderBy("epoch").collect()
        assert [r["epoch"] for r in lines] == list(range(1, len(lines) + 1))
        kept = heads.score_rows(dev, model, index).agg(F.avg("loss")).first()[0]
        assert kept == pytest.approx(min(r["loss"] for r in lines), abs=1e-9)
        stop = runs.early_stop(log.withColumn("run", F.lit(name)), 2).first()
        assert stop["stop_epoch"] == len(lines)


def test_tag_parts(spark):
    tags = [("B-LOC", "B", "LOC"), ("I-a-b", "I", "a-b"), ("O", "O", ""), ("B-0", "B", ""), ("-x", "", "x")]
    df = spark.createDataFrame(tags, "tag string, prefix string, kind string")
    same = (text.tag_prefix(F.col("tag")) == F.col("prefix")) & (text.tag_type(F.col("tag")) == F.col("kind"))
    assert df.where(~same).count() == 0


def test_leaderboard_top(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.2)], "encoder string, logme double")
    assert [r["encoder"] for r in logme.leaderboard(df, "logme", "encoder", top=2).orderBy("rank").collect()] == ["b", "c"]
