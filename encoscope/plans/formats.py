"""Queries of the smaller sources and sinks: each writes a given table in a format and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.text import clean_form, parse_encoder_spec, whitespace_tokens
from encoscope.functions.vectors import array_sum
from encoscope.operators import labels, ranking, runs, treebank
from encoscope.plans import query, table
from encoscope.plans.data import sql_tokens
from encoscope.plans.embedding import SQL_VOCABULARY, vocabulary
from encoscope.plans.studies import POOL_SIZE, SQL_GRID, SQL_HUMAN, SQL_LOGME, run_grid, survey, target_scores
from encoscope.plans.treebanks import SQL_FILES, conllu_records
from encoscope.session import scratch_path
from encoscope.sources import conllu, labelled, rankings, vectors


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


@query(
    "split_csv_files",
    """SELECT md5(text) AS digest, quality::VARCHAR AS label, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split
FROM documents JOIN labels USING (doc_id)""",
)
def split_csv_files(spark, sf_dir):
    """Train and test files read as one frame."""
    rows = labelled_documents(spark, sf_dir)
    paths = {name: scratch_path(spark, name) for name in ("train", "test")}
    labelled.write_labelled(rows.where("doc_id % 3 <> 0"), paths["train"], "text", "quality")
    labelled.write_labelled(rows.where("doc_id % 3 = 0"), paths["test"], "text", "quality")
    back = labelled.read_splits(spark, paths["train"], paths["test"])
    return back.select(F.md5("text").alias("digest"), "label", "split")


@query(
    "dataset_split",
    "SELECT CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, md5(text) AS digest, lang AS label FROM documents",
)
def dataset_split(spark, sf_dir):
    """Each split of a saved dataset, by its text and label columns."""
    path = scratch_path(spark, "dataset")
    split = F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train")
    table(spark, sf_dir, "documents").withColumn("split", split).write.parquet(path)
    parts = [labelled.read_dataset(spark, path, name, "text", "lang").select(F.lit(name).alias("split"), F.md5("text").alias("digest"), "label") for name in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query(
    "text_label_columns",
    "SELECT conv_id, turn, md5(text) AS digest, role AS label FROM conversations",
)
def text_label_columns(spark, sf_dir):
    """Text and label picked by name."""
    rows = labels.select_text_label(table(spark, sf_dir, "conversations"), "text", "role", ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.md5("text").alias("digest"), "label")


@query(
    "tweet_files",
    "SELECT md5(text) AS digest, (doc_id % 3)::INT AS label FROM documents",
)
def tweet_files(spark, sf_dir):
    """Texts with a sentiment name, read with its id."""
    path = scratch_path(spark, "tweets")
    names = F.array(*map(F.lit, sorted(labels.SENTIMENT_IDS, key=labels.SENTIMENT_IDS.get)))
    rows = table(spark, sf_dir, "documents").withColumn("mood", F.get(names, (F.col("doc_id") % 3).cast("int")))
    labelled.write_labelled(rows, path, "text", "mood")
    back = labelled.read_tweets(spark, path, "text", "label")
    return back.select(F.md5("text").alias("digest"), "label")


@query(
    "prediction_files",
    "SELECT md5(text) AS digest, length(text)::BIGINT AS n_chars, lang AS label FROM documents",
)
def prediction_files(spark, sf_dir):
    """Predictions in the file that the scorer looks for."""
    folder = scratch_path(spark, "predictions")
    path = labelled.write_predictions(table(spark, sf_dir, "documents"), folder, "documents-test", "text", "lang")
    back = labelled.read_labelled(spark, path)
    return back.select(F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), "label")


@query(
    "result_files",
    """WITH scores AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) / 1000.0::DOUBLE AS value FROM lineitem GROUP BY 1, 2)
SELECT status || ' | ' || flag || ' | LogME: ' || value::VARCHAR AS value FROM scores""",
)
def result_files(spark, sf_dir):
    """Result rows appended one set after the other, printed as lines."""
    path = scratch_path(spark, "results")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").count()
    rows = counts.select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linestatus").alias("encoder"),
        F.lit("mean").alias("pooling"),
        F.lit("logme").alias("metric"),
        (F.col("count") / 1000.0).alias("value"),
    )
    for flags in (["A", "N"], ["R"]):
        labelled.append_result(rows.where(F.col("dataset").isin(flags)), path)
    return labelled.result_lines(spark.read.parquet(path))


@query(
    "metric_files",
    "SELECT count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT lang)::BIGINT AS n_langs FROM documents",
)
def metric_files(spark, sf_dir):
    """A row of metrics as JSON."""
    path = scratch_path(spark, "metrics")
    docs = table(spark, sf_dir, "documents")
    found = docs.agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.countDistinct("lang").alias("n_langs"))
    labelled.write_metrics(found, path)
    return spark.read.schema("n long, n_chars long, n_langs long").json(path)


@query(
    "run_registry_files",
    f"WITH {SQL_GRID} SELECT task, encoder, pooling, head, seed::INT AS seed FROM grid WHERE NOT (seed IN (4012, 8857) AND pooling = 'mean')",
)
def run_registry_files(spark, sf_dir):
    """Runs that are left once finished ones were appended to the registry."""
    path = scratch_path(spark, "registry")
    grid = run_grid(spark, sf_dir)
    for seed in (4012, 8857):
        labelled.append_run(grid.where((F.col("seed") == seed) & (F.col("pooling") == "mean")), path)
    return runs.pending(grid, spark.read.parquet(path))


@query(
    "fasttext_files",
    f"""WITH {SQL_VOCABULARY}
SELECT word, len(vec)::INT AS width, round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 5) + 0.0 AS total FROM vocab""",
)
def fasttext_files(spark, sf_dir):
    """Word vectors with a line that gives their number and width on top."""
    path = scratch_path(spark, "fasttext")
    words = vocabulary(spark, sf_dir)
    size = words.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).select(F.concat_ws(" ", "n", "width").alias("value"))
    lines = words.select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))
    size.coalesce(1).union(lines).write.text(path)
    back = vectors.read_encoder(spark, f"fasttext:{path}")
    return back.select("word", F.size("vec").alias("width"), F.round(array_sum(F.col("vec")), 5).alias("total"))


# Characters that a word form loses, put into the tokens by place.
STRANGE = ("\u0092", "\u0097", "\U000fe4fa", "\ue402", "\ufeff", "\ufffd")


@query(
    "clean_forms",
    f"""WITH toks AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token, generate_subscripts({sql_tokens('text')}, 1) - 1 AS pos FROM documents)
SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(CASE WHEN pos % 7 = 6 THEN '[UNK]' ELSE token || '-' END, ' ' ORDER BY pos)) AS digest
FROM toks GROUP BY 1""",
)
def clean_forms(spark, sf_dir):
    """Word forms with a soft hyphen at the end and strange characters around; some hold nothing else."""
    strange = F.array(*map(F.lit, STRANGE))
    around = lambda t, i: F.concat(F.get(strange, i % len(STRANGE)), t, F.lit("\u00ad"), F.get(strange, (i + 1) % len(STRANGE)))
    dirty = lambda t, i: F.when(i % 7 == 6, F.get(strange, i % len(STRANGE))).otherwise(around(t, i))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(whitespace_tokens(F.col("text")), dirty).alias("forms"))
    clean = docs.select("doc_id", F.transform("forms", lambda f: clean_form(f)).alias("forms")).where(F.size("forms") > 0)
    return clean.select("doc_id", F.size("forms").cast("long").alias("n"), F.md5(F.array_join("forms", " ")).alias("digest"))


@query(
    "encoder_specs",
    """SELECT doc_id, list_extract(['fasttext', 'glove', 'transformer', 'transformer+cls'], (doc_id % 4 + 1)::INT) AS kind, source AS name FROM documents""",
)
def encoder_specs(spark, sf_dir):
    """Specifications put together from the documents and taken apart."""
    kinds = F.array(*map(F.lit, ("fasttext", "glove", "transformer", "transformer+cls")))
    spec = F.concat(F.get(kinds, (F.col("doc_id") % 4).cast("int")), F.lit(":"), "source")
    rows = table(spark, sf_dir, "documents").select("doc_id", parse_encoder_spec(spec).alias("s"))
    return rows.select("doc_id", "s.kind", "s.name")


FOLDERS = {"en_assistant-ud-test.conllu": "UD_English-Assistant", "en_system-ud-dev.conllu": "UD_Old_English-System", "fr_user-ud-train.conllu": "UD_French-User"}


@query(
    "conllu_directory",
    f"""WITH {SQL_FILES},
named AS (
  SELECT conv_id, turn, CASE file WHEN 'en_assistant-ud-test.conllu' THEN 'English' WHEN 'en_system-ud-dev.conllu' THEN 'Old English' ELSE 'Frankish' END AS language,
         CASE file WHEN 'en_assistant-ud-test.conllu' THEN 'Assistant' WHEN 'en_system-ud-dev.conllu' THEN 'System' ELSE 'User' END AS treebank FROM roles
)
SELECT language, treebank, CASE WHEN language = 'Frankish' THEN 'spoken' ELSE '' END AS genre, language = 'English' AS included,
       language <> 'English' AS excluded, count(*)::BIGINT AS sentences FROM named GROUP BY 1, 2""",
)
def conllu_directory(spark, sf_dir):
    """Treebank folders, one with a README that overrules its folder name, filtered by language."""
    path = scratch_path(spark, "treebanks")
    rows = conllu_records(spark, sf_dir)
    for file, folder in FOLDERS.items():
        kept = rows.where(F.col("file") == file).select("record")
        kept.write.mode("append").option("lineSep", "\n\n").text(f"{path}/{folder}")
    readme = "=== Machine-readable metadata ===\nGenre: spoken\nLanguage: Frankish\n==="
    # a compressed part file can be told from the treebank files by its name
    head = rows.where(F.col("file") == "fr_user-ud-train.conllu").limit(1).select(F.lit(readme).alias("value"))
    head.write.mode("append").option("compression", "gzip").text(f"{path}/{FOLDERS['fr_user-ud-train.conllu']}")
    sentences, meta = conllu.read_directory(spark, path, glob="part-*.txt", readme="part-*.txt.gz")
    named = conllu.with_meta(sentences, meta).select(
        "language",
        "treebank",
        F.coalesce(F.try_element_at("meta", F.lit("Genre")), F.lit("")).alias("genre"),
        treebank.metadata_filter("Language", ["English"]).alias("included"),
        treebank.metadata_filter("Language", ["English"], "exclude").alias("excluded"),
    )
    return named.groupBy(*named.columns).agg(F.count("*").alias("sentences"))


def study_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Target scores and survey scores, written as the study's JSON and CSV and read back.

    Every setup lists all tasks in one order, so that a survey block and a task have one index. A
    participant's line holds a block of cells for each task, with blanks for models not ranked.
    """
    target = target_scores(spark, sf_dir)
    tasks = target.select("task").distinct()
    listed = F.array_sort(F.collect_list(F.struct("model", "f1", "logme")))
    cells = target.groupBy("setup", "task").agg(listed.alias("rows"))
    setups = [r["setup"] for r in target.select("setup").distinct().collect()]  # a handful of training setups
    whole = tasks.withColumn("setup", F.explode(F.array(*map(F.lit, setups)))).join(cells, ["setup", "task"], "left")
    empty = F.array().cast(cells.schema["rows"].dataType)
    scores = F.coalesce("rows", empty)
    entry = F.struct(
        F.col("task").cast("string").alias("name"),
        F.struct(
            F.transform(scores, lambda r: r["model"].cast("string")).alias("model"),
            F.transform(scores, lambda r: r["f1"].cast("double")).alias("f1"),
            F.transform(scores, lambda r: r["logme"].cast("double")).alias("logme"),
        ).alias("scores"),
    )
    by_setup = whole.groupBy("setup").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tasks"))
    json = by_setup.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("setup", "tasks")))).alias("value"))
    json_path, csv_path = scratch_path(spark, "target"), scratch_path(spark, "survey")
    json.write.text(json_path)

    votes = survey(spark, sf_dir).select("participant", "task", F.struct(-F.col("score"), F.col("model").cast("string").alias("model")).alias("vote"))
    ranked = votes.groupBy("participant", "task").agg(F.array_sort(F.collect_list("vote")).alias("votes"))
    rankings.write_survey(ranked.select("participant", "task", F.col("votes.model").alias("ranking")), csv_path, POOL_SIZE)
    read = rankings.read_target_rankings(spark, json_path)
    return read, ranking.survey_scores(rankings.read_survey(spark, csv_path, POOL_SIZE), POOL_SIZE)


@query(
    "ranking_study_files",
    f"""WITH {SQL_HUMAN},
pool AS (SELECT setup, task, count(*) AS pool FROM target GROUP BY 1, 2)
SELECT setup, task::VARCHAR AS task, n_models::BIGINT AS n_models, (pool - n_models)::BIGINT AS n_missing, round(tau, 6) + 0.0 AS tau
FROM human JOIN pool USING (setup, task)""",
)
def ranking_study_files(spark, sf_dir):
    """Taus of all participants of a study that was read from its files."""
    target, votes = study_files(spark, sf_dir)
    return ranking.human_taus(target, votes).select("setup", "task", "n_models", "n_missing", F.round("tau", 6).alias("tau"))


@query(
    "logme_tau_summary",
    f"""WITH {SQL_HUMAN}, {SQL_LOGME}, exact AS (SELECT setup, task, round(tau, 9) + 0.0 AS tau FROM logme_tau)
SELECT CASE WHEN grouping(setup) = 1 THEN 'overall' ELSE 'setup' END AS level, setup, round(atanh(avg(tanh(tau))), 5) + 0.0 AS mean,
       round(tanh(avg(atanh(least(greatest(tau, -0.999999999), 0.999999999)))), 5) + 0.0 AS fisher_mean, count_if(tau > 0)::BIGINT AS n_positive
FROM exact GROUP BY GROUPING SETS ((setup), ())""",
)
def logme_tau_summary(spark, sf_dir):
    """Summary lines of the transferability score, per setup and overall."""
    taus = ranking.logme_taus(target_scores(spark, sf_dir)).withColumn("tau", F.round("tau", 9))
    # a perfect order has no finite inverse
    inside = F.least(F.greatest("tau", F.lit(-0.999999999)), F.lit(0.999999999))
    fisher = ranking.tau_summary(taus.withColumn("tau", inside)).where("level <> 'task'").select("level", "setup", F.round("fisher_mean", 5).alias("fisher_mean"))
    lines = ranking.tau_summary(taus).where("level <> 'task'").select("level", "setup", F.round("mean", 5).alias("mean"), "n_positive")
    same = (lines["level"] == fisher["level"]) & lines["setup"].eqNullSafe(fisher["setup"])
    return lines.join(fisher, same).select(lines["level"], lines["setup"], "mean", "fisher_mean", "n_positive")
