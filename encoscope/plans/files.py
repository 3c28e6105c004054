"""File queries: tables written in each text format under the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from encoscope.functions.vectors import array_sum
from encoscope.operators import leep, splits
from encoscope.plans import query, table
from encoscope.plans.data import SQL_TAGS, source_index, tagged_sentences
from encoscope.plans.embedding import SQL_THETA, SQL_VOCABULARY, theta_rows, vocabulary
from encoscope.plans.treebanks import SQL_RESOLVED, conllu_records
from encoscope.session import scratch_path
from encoscope.sources import conll, conllu, labelled, vectors
from encoscope.sources import leep as leep_files


@query(
    "csv_files",
    "SELECT md5(text) AS digest, length(text)::BIGINT AS n_chars, quality::VARCHAR AS label FROM documents JOIN labels USING (doc_id)",
)
def csv_files(spark, sf_dir):
    """Labelled CSV with line breaks and quotes inside the texts."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    path = scratch_path(spark, "labelled")
    labelled.write_labelled(docs, path, "text", "quality")
    rows = labelled.read_labelled(spark, path)
    return rows.select(F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), "label")


@query(
    "token_csv_files",
    f"""WITH {SQL_TAGS}
SELECT md5(string_agg(token, ' ' ORDER BY pos)) AS text, md5(string_agg(gold, ' ' ORDER BY pos)) AS labels, count(*)::BIGINT AS n
FROM tags GROUP BY conv_id, turn""",
)
def token_csv_files(spark, sf_dir):
    """Token-level CSV whose label level is found on reading."""
    path = scratch_path(spark, "tokens")
    rows = tagged_sentences(spark, sf_dir).where(F.size("tokens") > 0)
    labelled.write_labelled(rows, path, "tokens", "gold")
    back = labelled.read_with_level(spark, path)
    return back.select(
        F.md5("text").alias("text"), F.md5(F.array_join("labels", " ")).alias("labels"), F.size("labels").cast("long").alias("n")
    )


@query(
    "split_files",
    """WITH ranked AS (
  SELECT lang, text, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':4012'), doc_id) AS rn, count(*) OVER () AS n FROM documents),
parts AS (
  SELECT lang, text, CASE WHEN rn <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
                    WHEN rn <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'dev' ELSE 'test' END AS split FROM ranked)
SELECT split, lang AS label, md5(text) AS digest FROM parts""",
)
def split_files(spark, sf_dir):
    """Three split parts written as CSV folders, each read by its split."""
    docs = splits.seeded_split(table(spark, sf_dir, "documents"), "doc_id", 4012)
    path = scratch_path(spark, "splits")
    labelled.write_labelled(docs, path, "text", "lang", split="split")
    rows = labelled.read_csv(spark, path)
    return rows.select("split", "label", F.md5("text").alias("digest"))


@query(
    "conll_files",
    f"""WITH {SQL_TAGS}
SELECT md5(string_agg(token || chr(9) || gold, chr(10) ORDER BY pos)) AS digest, count(*)::BIGINT AS n_tokens FROM tags GROUP BY conv_id, turn""",
)
def conll_files(spark, sf_dir):
    """Token-per-line files."""
    path = scratch_path(spark, "conll")
    conll.write_bio(tagged_sentences(spark, sf_dir).where(F.size("tokens") > 0), path, "tokens", "gold")
    rows = conll.read_bio(spark, path)
    return rows.select(
        F.md5(conll.render_bio(F.col("tokens"), F.col("tags"))).alias("digest"), F.size("tokens").cast("long").alias("n_tokens")
    )


@query(
    "conllu_files",
    f"""WITH {SQL_RESOLVED}
SELECT resolved AS digest, n::BIGINT AS words, (SELECT count(*) - 1 FROM resolved)::BIGINT AS last_idx FROM resolved""",
)
def conllu_files(spark, sf_dir):
    """Treebank files written by the text sink, read and numbered."""
    path = scratch_path(spark, "conllu")
    conllu_records(spark, sf_dir).select("record").write.option("lineSep", "\n\n").text(path)
    rows = conllu.read_conllu(spark, path, glob=None)
    heads = F.size(F.filter("words", lambda w: w["head"].isNotNull())).cast("long")
    text = F.md5(conllu.render_sentence(F.col("words"), resolve=True))
    last = rows.agg(F.max("idx")).first()[0]
    return rows.select(text.alias("digest"), heads.alias("words"), F.lit(last).cast("long").alias("last_idx"))


@query(
    "vector_files",
    f"""WITH {SQL_VOCABULARY}
SELECT word, len(vec)::INT AS width, round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 5) + 0.0 AS total FROM vocab""",
)
def vector_files(spark, sf_dir):
    """Word vectors written as lines and read as a headerless file."""
    path = scratch_path(spark, "vectors")
    vectors.write_vectors(vocabulary(spark, sf_dir), path)
    rows = vectors.read_encoder(spark, f"glove:{path}")
    return rows.select("word", F.size("vec").alias("width"), F.round(array_sum(F.col("vec")), 5).alias("total"))


@query(
    "leep_files",
    f"""WITH {SQL_THETA}, eep AS (SELECT vec_id, sum(t.p * c.p) AS e FROM theta t JOIN cond c ON c.y = t.y AND c.z = t.z GROUP BY 1)
SELECT round(avg(ln(e)), 8) AS leep, 3 AS targets, 5 AS sources FROM eep""",
)
def leep_file_query(spark, sf_dir):
    """Source probabilities written with their label header, read back and scored."""
    path = scratch_path(spark, "leep")
    leep_files.write_leep(theta_rows(spark, sf_dir), path, ["0", "1", "2"], [f"s{k}" for k in range(5)])
    rows, targets, sources = leep_files.read_leep(spark, path)
    score = leep.leep(rows).select(F.round("leep", 8).alias("leep"))
    return score.withColumns({"targets": F.lit(len(targets)), "sources": F.lit(len(sources))})


@query(
    "label_map_files",
    "SELECT source AS label, (row_number() OVER (ORDER BY source) - 1)::INT AS label_id FROM (SELECT DISTINCT source FROM documents) AS d",
)
def label_map_files(spark, sf_dir):
    """Label map written as JSON and inverted on reading."""


    path = scratch_path(spark, "labels")
    labelled.write_label_map(source_index(spark, sf_dir), path)
    return labelled.read_label_map(spark, path)
