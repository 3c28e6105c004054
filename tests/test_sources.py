"""Readers and sinks: round trips, small written files, and the documented deviations."""

import json

import pytest
from pyspark.sql import functions as F

from encoscope import session
from encoscope.functions import text
from encoscope.operators import embed, leep, ranking, report, treebank
from encoscope.sources import conll, conllu, labelled, rankings, vectors
from encoscope.sources import leep as leep_files

FIXTURE = (
    "# newdoc id = d1\n# sent_id = 1\n"
    "1-2\tdon't\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No\n"
    "1\tdo\tdo\tAUX\t_\tMood=Ind\t3\taux\t_\t_\n"
    "2\tn't\tnot\tPART\t_\t_\t3\tadvmod:neg\t_\t_\n"
    "3\tgo\tgo\tVERB\t_\t_\t0\troot\t_\t_\n"
    "3.1\tgone\tgo\tVERB\t_\t_\t_\t_\t_\t_\n"
    "4\t.\t.\tPUNCT\t_\t_\t3\tpunct\t_\t_"
)


def parsed(spark, *records):
    df = spark.createDataFrame([("f", k, k, r) for k, r in enumerate(records)], "file string, sent long, idx long, record string")
    return conllu.parse_sentences(df)


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_conllu_fixture(spark):
    df = parsed(spark, FIXTURE).cache()
    words = F.col("words")
    assert one(df, treebank.word_forms(words)) == ["do", "n't", "go", "."]
    assert one(df, treebank.heads(words)) == [2, 2, -1, 2]
    assert one(df, treebank.relations(words, include_subtypes=False)) == ["aux", "advmod", "root", "punct"]
    assert one(df, treebank.relations(words))[1] == "advmod:neg"
    assert one(df, treebank.part_of_speech(words)) == ["AUX", "PART", "VERB", "PUNCT"]
    assert one(df, treebank.token_forms(words)) == ["don't", "go", "."]
    assert one(df, treebank.sentence_text(words)) == "don'tgo . "
    assert one(df, conllu.parse_metadata(F.col("comments"))) == {"newdoc id": "d1", "sent_id": "1"}
    assert one(df, treebank.plain_comments(F.col("comments"))) == ["newdoc id = d1", "sent_id = 1"]
    stats = treebank.statistics(df).first()
    assert (stats["sentences"], stats["tokens"], stats["words"]) == (1, 3, 4)
    assert sorted(r["key"] for r in treebank.metadata_keys(df).collect()) == ["newdoc id", "sent_id"]
    assert one(df, conllu.render_sentence(words, F.col("comments"))) == FIXTURE
    resolved = one(df, conllu.render_sentence(words, resolve=True)).split("\n")
    assert [line.split("\t")[0] for line in resolved] == ["1", "2", "3", "4"]


def line(word_id, form="x", feats="_", head="0", misc="_"):
    return "\t".join([word_id, form, "_", "_", "_", feats, head, "dep", "_", misc])


def test_conllu_odd_sentences(spark):
    bad = [line("1") + "\textra", line("a"), line("1", head="q"), "1\tshort"]
    df = parsed(spark, *bad, line("0.1", head="_") + "\n" + line("1"), line("1", "_"))
    assert [r["corrupt"] is not None for r in df.orderBy("sent").collect()] == [True] * 4 + [False] * 2
    good = df.where("corrupt IS NULL").orderBy("sent").collect()
    assert [(w["id"], w["token"], w["first"]) for w in good[0]["words"]] == [("0.1", 0, True), ("1", 1, True)]
    assert (good[1]["words"][0]["form"], good[1]["words"][0]["lemma"]) == ("_", "_")


def test_range_at_the_end_keeps_its_words(spark):
    df = parsed(spark, "\n".join([line("1"), line("2-3", head="_"), line("2"), line("3")]))
    assert [(w["token"], w["first"]) for w in df.first()["words"]] == [(1, True), (2, True), (2, False), (2, False)]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("A=1|B=2", {"A": "1", "B": "2"}),
        ("A=1|broken|B=x=y", {"A": "1", "B": "x=y"}),
        ("A=1|B=2|A=3", {"A": "3", "B": "2"}),
        ("broken|broken", {}),
        ("_", {}),
    ],
)
def test_dictionaries(spark, value, expected):
    assert parsed(spark, line("1", feats=value)).first()["words"][0]["feats"] == expected


def test_comments(spark):
    record = "# a = b = c\n#key value\n# two words here\n# a = last\n#newpar\n" + line("1")
    row = parsed(spark, record).select(
        conllu.parse_metadata(F.col("comments")).alias("m"), conllu.unknown_comments(F.col("comments")).alias("u")
    ).first()
    assert row["m"] == {"a": "last", "key": "value"}
    assert row["u"] == ["two words here", "newpar"]


def test_read_conllu_numbers_in_file_order(spark, tmp_path):
    def record(k):
        return f"# sent_id = {k}\n" + "\n".join(line(str(i + 1), f"w{k}") for i in range(5))

    (tmp_path / "b_x-ud-dev.conllu").write_text("\n\n".join(record(k) for k in range(700)) + "\n\n")
    middle = [record(k) for k in range(700, 1400)]
    middle[10] = "1\tbroken"
    (tmp_path / "a_x-ud-dev.conllu").write_text("\n   \n".join(middle[:50]) + "\n\n\n" + "\n\n".join(middle[50:]))
    (tmp_path / "notes.txt").write_text(record(9))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = conllu.read_conllu(spark, str(tmp_path)).select(
            "file", "sent", "idx", F.element_at(conllu.parse_metadata(F.col("comments")), "sent_id").cast("int").alias("k")
        ).collect()
        assert conllu.rejected(spark, str(tmp_path)).count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    order = [r["k"] for r in sorted(rows, key=lambda r: r["idx"])]
    assert order == [k for k in range(700, 1400) if k != 710] + list(range(700))
    assert sorted(r["idx"] for r in rows) == list(range(1399))
    assert {r["sent"] for r in rows if r["file"].endswith("b_x-ud-dev.conllu")} == set(range(700))


def test_read_crlf(spark, tmp_path):
    (tmp_path / "a.conllu").write_bytes((FIXTURE + "\n\n" + FIXTURE + "\n").replace("\n", "\r\n").encode())
    rows = conllu.read_conllu(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0]["words"][0]["misc"] == {"SpaceAfter": "No"}


def test_read_directory(spark, tmp_path):
    one_dir, two_dir = tmp_path / "UD_Old_French-SRCMF", tmp_path / "UD_English-EWT"
    for folder in (one_dir, two_dir, tmp_path / "other"):
        folder.mkdir()
        (folder / "x.conllu").write_text(FIXTURE + "\n\n")
    (two_dir / "README.md").write_text("# Title\n=== Machine-readable metadata ===\nGenre: blog web\nLicense: a: b\n===\nParallel: no\n")
    sentences, meta = conllu.read_directory(spark, str(tmp_path))
    assert sentences.count() == 2
    got = {r["treebank"]: (r["language"], r["meta"]) for r in meta.collect()}
    own = {"Language": "Old French", "Treebank": "SRCMF"}
    web = {"Language": "English", "Treebank": "EWT", "Genre": "blog web", "Parallel": "no"}
    assert got == {"SRCMF": ("Old French", own), "EWT": ("English", web)}
    kept = conllu.with_meta(sentences, meta).where(treebank.metadata_filter("Language", ["English"]))
    assert {r["treebank"] for r in kept.collect()} == {"EWT"}
    named = conllu.with_meta(sentences, meta)
    assert named.where(treebank.domain_filter(["blog"])).count() == 1
    assert sorted(r["domain"] for r in treebank.domain_set(meta).collect()) == ["", "blog", "web"]
    assert one(spark.range(1), conllu.treebank_name(F.lit("/a/en_ewt-ud-dev.conllu"))) == "en-ewt-dev"


def test_write_conllu(spark, tmp_path):
    conllu.write_conllu(parsed(spark, FIXTURE, FIXTURE), str(tmp_path / "out"))
    back = conllu.read_conllu(spark, str(tmp_path / "out"), glob=None)
    assert back.count() == 2
    assert one(back, conllu.render_sentence(F.col("words"), F.col("comments"))) == FIXTURE


def test_groups_start_unknown(spark):
    records = [line("1"), "# newdoc\n" + line("1"), line("1"), "# newdoc id = x\n# src = ab-12\n" + line("1"), "# src = q\n" + line("1")]
    df = parsed(spark, *records)
    groups = [r["group"] for r in treebank.group_by_comment(df, "newdoc").orderBy("sent").collect()]
    assert groups == ["unknown", "group-0", "group-0", "group-1", "group-1"]
    named = treebank.group_by_metadata(df, "src", r"(?P<val2>[a-z]+)-(?P<val1>\d+)").orderBy("sent")
    assert [r["group"] for r in named.collect()] == ["unknown", "unknown", "unknown", "12ab", "unknown"]


def test_unknown_relations(spark):
    found = spark.createDataFrame([("nsubj:pass",), ("madeup",)], "relation string")
    assert [r["relation"] for r in treebank.unknown_relations(found).collect()] == ["madeup"]
    assert treebank.unknown_relations(found, ["nsubj:pass", "madeup"]).count() == 0
    assert len(treebank.UNIVERSAL_RELATIONS) == 37


def test_clean_forms(spark):
    forms = [("a\u00adb", "a-b"), ("\ufeff\u0092", "[UNK]"), ("x\U000fe4fay\ue402\ufffd", "xy"), (None, "[UNK]")]
    df = spark.createDataFrame(forms, "form string, wanted string")
    assert df.where(text.clean_form(F.col("form")) != F.col("wanted")).count() == 0
    assert one(df.where("form IS NULL"), text.clean_form(F.col("form"), False)) == ""


def test_labelled_round_trip(spark, tmp_path):
    rows = [('say "hi",\nthere', "1"), ("  spaced  ", "0"), ("", "2"), ("back\\slash", "1")]
    path = str(tmp_path / "csv")
    labelled.write_labelled(spark.createDataFrame(rows, "text string, label string"), path)
    assert sorted(map(tuple, labelled.read_labelled(spark, path).collect())) == sorted(rows)
    with pytest.raises(Exception, match="nope"):
        labelled.read_labelled(spark, path, text="nope")
    raw = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*.csv"))
    assert '"say ""hi"",' in raw and raw.startswith('"text","label"')


def test_token_level_is_found(spark, tmp_path):
    df = spark.createDataFrame([(["a"], [3]), (["b", "c"], [1, 2])], "tokens array<string>, labels array<int>")
    path = str(tmp_path / "csv")
    labelled.write_labelled(df, path, "tokens", "labels")
    got = labelled.read_with_level(spark, path)
    assert sorted(r["labels"] for r in got.collect()) == [["1", "2"], ["3"]]


def test_splits_datasets_and_tweets(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / f"{name}.csv").write_text(f'"text","label"\n"{name} text","1"\n')
    both = labelled.read_splits(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"))
    assert sorted(map(tuple, both.collect())) == [("test text", "1", "test"), ("train text", "1", "train")]
    both.write.parquet(str(tmp_path / "saved"))
    assert labelled.read_dataset(spark, str(tmp_path / "saved"), "test").first()["text"] == "test text"
    (tmp_path / "tweets.csv").write_text('id,airline_sentiment,text\n1,negative,"bad\nday"\n2,positive,ok\n')
    tweets = labelled.read_tweets(spark, str(tmp_path / "tweets.csv")).collect()
    assert sorted(map(tuple, tweets)) == [("bad\nday", 0), ("ok", 2)]
    (tmp_path / "odd.csv").write_text("id,airline_sentiment,text\n1,mixed,so so\n")
    with pytest.raises(Exception, match="unknown sentiment mixed"):
        labelled.read_tweets(spark, str(tmp_path / "odd.csv"), multi_line=False).collect()


def test_label_maps_both_layouts(spark, tmp_path):
    for name, indent in (("flat", None), ("indented", 4)):
        (tmp_path / name).write_text(json.dumps({"B": 0, "O": 1}, indent=indent))
        assert sorted(map(tuple, labelled.read_label_map(spark, str(tmp_path / name)).collect())) == [("B", 0), ("O", 1)]


def test_predictions_results_runs_metrics(spark, tmp_path):
    df = spark.createDataFrame([("some text", "pos")], "text string, prediction string")
    path = labelled.write_predictions(df, str(tmp_path), "test")
    assert path.endswith("test-pred.csv") and labelled.read_labelled(spark, path).first()["text"] == "some text"
    result = spark.createDataFrame([("d", "e", "mean", "logme", -0.5)], "dataset string, encoder string, pooling string, metric string, value double")
    for _ in range(2):
        labelled.append_result(result, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2
    assert labelled.result_lines(result).first()["value"] == "e | d | LogME: -0.5"
    run = spark.createDataFrame([("t", "e", "mean", "mlp", 4012)], "task string, encoder string, pooling string, head string, seed int")
    labelled.append_run(run, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).first()["seed"] == 4012
    labelled.write_metrics(result.select("value"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["value"] == -0.5


def test_bio_files(spark, tmp_path):
    (tmp_path / "x.conll").write_text("a\tB-X\nb\tI-X\n\nc\tO\n")
    rows = conll.read_bio(spark, str(tmp_path / "x.conll")).orderBy("idx").collect()
    assert [(r["tokens"], r["tags"]) for r in rows] == [(["a", "b"], ["B-X", "I-X"]), (["c"], ["O"])]
    short = spark.createDataFrame([(["a", "b", "c"], ["O", "O"])], "t array<string>, g array<string>")
    assert one(short, conll.render_bio(F.col("t"), F.col("g"))) == "a\tO\nb\tO"


def test_scoring_files(spark, tmp_path):
    gold, pred = [0, 0, 1, 1, 2, 2, 2, 0], [0, 1, 1, 1, 2, 0, 2, 0]
    for name, values in (("gold", gold), ("pred", pred)):
        lines = "".join(f'"text {k}\n{k}","{v}"\n' for k, v in enumerate(values))
        (tmp_path / f"{name}.csv").write_text('"text","label"\n' + lines)
    got = report.evaluate_files(spark, f"{tmp_path}/gold.csv", f"{tmp_path}/pred.csv").first()
    assert tuple(got) == pytest.approx((75.0, 75.555556, 75.0), abs=1e-5)
    (tmp_path / "gold.conll").write_text("a\tB-X\nb\tI-X\n\nc\tO\n")
    (tmp_path / "pred.conll").write_text("a\tB-X\nb\tO\n\nc\tB-X\n")
    spans = report.evaluate_files(spark, f"{tmp_path}/gold.conll", f"{tmp_path}/pred.conll").first()
    assert spans.asDict() == {"accuracy:": 33.33, "precision:": 0.0, "recall:": 0.0, "FB1:": 0.0}
    (tmp_path / "short.csv").write_text('"text","label"\n"x","1"\n')
    with pytest.raises(Exception, match="differ in length"):
        report.f1_of_files(spark, f"{tmp_path}/gold.csv", f"{tmp_path}/short.csv").collect()
    with pytest.raises(ValueError, match="only two"):
        report.evaluate_files(spark, "a.csv", "b.conll")


def test_vector_files(spark, tmp_path):
    (tmp_path / "ft.vec").write_text("3 2\nUNK 0 0\na 1 2\na 3 4\nb 1 x\nc 1 2 3\n")
    words = vectors.read_encoder(spark, f"fasttext:{tmp_path}/ft.vec")
    got = {r["word"]: r["vec"] for r in words.collect()}
    assert got["a"] == [3.0, 4.0] and set(got) == {"UNK", "a", "b", "c"}
    assert sorted(r["word"] for r in vectors.uneven_vectors(words).collect()) == ["b", "c"]
    (tmp_path / "glove.txt").write_text("UNK 0 0\na 1 2\n")
    assert vectors.read_encoder(spark, f"glove:{tmp_path}/glove.txt").count() == 2
    for spec in ("word2vec:x", "glove"):
        with pytest.raises(ValueError, match="unknown embedding"):
            vectors.read_encoder(spark, spec)


def test_encoder_specs(spark):
    df = spark.createDataFrame([("transformer+cls:bert",)], "spec string")
    assert tuple(one(df, text.parse_encoder_spec(F.col("spec")))) == ("transformer+cls", "bert")
    with pytest.raises(Exception, match="unknown embedding"):
        spark.createDataFrame([("x:y",)], "spec string").select(text.parse_encoder_spec(F.col("spec"))).collect()


def test_recombined_pieces(spark):
    df = spark.createDataFrame(
        [(["un", "##do", "it"], "wordpiece"), (["\u0120un", "do", "\u0120it"], "bpe"), ([], "bpe")], "pieces array<string>, family string"
    )
    got = [r["w"] for r in df.select(text.recombine_pieces(F.col("pieces"), F.col("family")).alias("w")).collect()]
    assert got == [["undo", "it"], ["undo", "it"], []]


def test_leep_files(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("# [A, B]\n# [U, V, W]\n[0.7, 0.2, 0.1] A\nwhat is this\n")
    with pytest.raises(Exception, match="no instance and no label line"):
        leep_files.read_leep(spark, str(tmp_path / "bad.txt"))[0].collect()
    (tmp_path / "l.txt").write_text("# [A, B]\n# [U, V, W]\n[0.7, 0.2, 0.1] A\n[0.1, 0.8, 0.1] B\n")
    rows, targets, sources = leep_files.read_leep(spark, str(tmp_path / "l.txt"))
    assert (targets, sources, rows.count()) == (["A", "B"], ["U", "V", "W"], 2)
    path = str(tmp_path / "out")
    leep_files.write_leep(rows, path, [0, 1], sources)
    with pytest.raises(Exception, match="outside the target labels"):
        leep_files.read_leep(spark, path)[0].collect()
    again, _, _ = (leep_files.write_leep(rows, path + "2", targets, sources), *leep_files.read_leep(spark, path + "2"))[1:]
    assert leep.leep(again).first()["leep"] == pytest.approx(leep.leep(rows).first()["leep"])


def test_ranking_study(spark, tmp_path):
    scores = {"tuned": {"t1": {"model": ["a", "b", "c"], "f1": [3, 2, 1], "logme": [0.3, 0.2, 0.1]}, "t0": {"model": ["a", "b", "c"], "f1": [1, 2, 3], "logme": [3, 2, 1]}}}
    (tmp_path / "gold.json").write_text(json.dumps(scores))
    (tmp_path / "survey.csv").write_text("when,who,q1,q2,q3,q4,q5,q6\nx,p,a,b,c,a,a,c\ny,q,c,b,a,c,b,a\n")
    target = rankings.read_target_rankings(spark, str(tmp_path / "gold.json"))
    assert {(r["task_idx"], r["task"]) for r in target.collect()} == {(0, "t1"), (1, "t0")}
    models = rankings.target_models(target)
    blocks = rankings.read_survey(spark, str(tmp_path / "survey.csv"), models)
    assert ranking.duplicate_choices(blocks, models).count() == 1
    scored = ranking.survey_scores(blocks, models)
    first = {r["model"]: r["score"] for r in scored.where("task_idx = 0").orderBy("participant").collect()[:3]}
    assert sorted(first.values()) == [0, 1, 2]
    survey = scored.join(target.select("task_idx", "task").distinct(), "task_idx")
    taus = ranking.human_taus(target, survey).collect()
    assert {round(r["tau"], 3) for r in taus if r["task"] == "t1"} == {1.0, -1.0}
    logme = ranking.logme_taus(target)
    assert {r["task"]: round(r["tau"], 3) for r in logme.collect()} == {"t1": 1.0, "t0": -1.0}
    wins = ranking.win_rate(ranking.human_taus(target, survey), logme).first()
    assert wins["comparisons"] == 4 and wins["human_wins"] + wins["logme_wins"] <= 4


class _Context:
    applicationId = "app"

    def __init__(self, master, conf):
        self.master, self._conf = master, conf

    def getConf(self):
        return self._conf


class _Session:
    def __init__(self, master, conf):
        self.sparkContext, self.conf = _Context(master, conf), conf


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def test_shared_folder_comes_from_the_session():
    named = _Session("yarn", _Conf({"spark.checkpoint.dir": "hdfs:///shared"}))
    assert session.scratch_path(named, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session("yarn", _Conf()))
    assert session.shared_dir(_Session("local[2]", _Conf())) == session.shared_dir(_Session("local[2]", _Conf()))


def test_incomplete_rankings_are_reported(spark, tmp_path):
    (tmp_path / "survey.csv").write_text("when,who,q1,q2,q3,q4,q5\nx,p,a,b,c,a,b\n")
    blocks = rankings.read_survey(spark, str(tmp_path / "survey.csv"), 3)
    assert [r["task_idx"] for r in ranking.duplicate_choices(blocks, 3).collect()] == [1]
    pool = [("s", k, f"t{k}", m, float(i)) for k in (0, 1) for i, m in enumerate("abc")]
    target = spark.createDataFrame(pool, "setup string, task_idx int, task string, model string, f1 double")
    survey = ranking.survey_scores(blocks, 3).join(target.select("task_idx", "task").distinct(), "task_idx")
    assert {r["task"]: r["n_missing"] for r in ranking.human_taus(target, survey).collect()} == {"t0": 0, "t1": 1}
    assert {r["task"]: r["n_missing"] for r in ranking.majority_taus(target, survey).collect()} == {"t0": 0, "t1": 1}


def test_embed_texts_calls_the_factory_once_per_worker(spark):
    def counted():
        import os
        import random

        build = [float(os.getpid()), random.random()]
        return lambda texts: [build for _ in texts]

    many = spark.range(0, 400, 1, 40).select("id", F.lit("x").alias("text"))
    built = [tuple(r["features"]) for r in embed.embed_texts(many, counted).collect()]
    # however many tasks a worker process serves, it builds the model once
    assert len(built) == 400 and len(set(built)) == len({process for process, _ in built})

    def factory():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "ab"), (2, "")], "id int, text string")
    assert {r["id"]: r["features"] for r in embed.embed_texts(df, factory).collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_surveys_of_many_tasks_go_out_and_come_back(spark, tmp_path):
    # 21,000 cells in a line: more than a CSV reader takes as columns
    tasks = spark.range(7_000).select(F.format_string("t%05d", "id").alias("task"), "id")
    names = F.array(F.lit('m "1"'), F.lit("m,2\nx"), F.lit("m3"))
    ranking_of = lambda p: F.when(F.pmod(F.col("id") + p, F.lit(3)) != 0, F.slice(names, F.pmod(F.col("id"), F.lit(3)) + 1, 2))
    blocks = tasks.withColumn("participant", F.explode(F.array(F.lit("p"), F.lit("q")))).withColumn("ranking", ranking_of(F.length("participant")))
    path = str(tmp_path / "survey")
    rankings.write_survey(blocks.where("ranking IS NOT NULL OR participant = 'p'"), path, 3)
    back = rankings.read_survey(spark, path, 3)
    assert (back.count(), back.select("participant").distinct().count()) == (14_000, 2)
    want = blocks.selectExpr("id AS task_idx", "posexplode(ranking) AS (at, model)").where("model IS NOT NULL")
    got = back.selectExpr("task_idx", "posexplode(ranking) AS (at, model)").where("model IS NOT NULL")
    key = lambda df: sorted((r["task_idx"], r["at"], r["model"]) for r in df.collect())
    assert key(got) == key(want)


def test_short_and_quoted_survey_lines(spark, tmp_path):
    (tmp_path / "survey.csv").write_text('\ufeffwhen,"who\nare you",q1,q2,q3\r\n\r\nx,p,a,"b ""2"", c"\r\ny,q,,b,a,surplus\r\n')
    blocks = rankings.read_survey(spark, str(tmp_path / "survey.csv"), 2).orderBy("participant", "task_idx").collect()
    assert [(r["task_idx"], r["ranking"]) for r in blocks] == [(0, ["a", 'b "2", c']), (1, [None]), (0, [None, "b"]), (1, ["a"])]
    assert len({r["participant"] for r in blocks}) == 2
