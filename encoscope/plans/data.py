"""Dataset queries: label levels, flattening, maps, splits, pairs and format conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.text import split_spaces, whitespace_tokens
from encoscope.operators import labels, splits
from encoscope.plans import query, table, texts
from encoscope.sources.conll import parse_bio, render_bio

# The white space class of ``functions.text`` in SQL spelling.
SQL_SPACE = r"[\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# The seven encoders of the published study.
ENCODERS = (
    "bert-base-uncased",
    "roberta-base",
    "distilbert-base-uncased",
    "emilyalsentzer/Bio_ClinicalBERT",
    "dmis-lab/biobert-v1.1",
    "cardiffnlp/twitter-roberta-base",
    "allenai/scibert_scivocab_uncased",
)

EVENT_IDS = {"click": 0, "view": 1, "purchase": 2, "signup": 3}
TAG_IDS = {"B-LONG": 0, "B-SHORT": 1, "I-LONG": 2, "I-SHORT": 3, "O": 4}


def sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SQL_SPACE}'), lambda x: x <> '')"


def tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as tagged sentences: capitalised tokens form chunks of two types.

    ``pred`` is ``gold`` with about one tag in seven changed.
    """
    rows = texts(spark, sf_dir, "conversations").select(
        "conv_id", "turn", whitespace_tokens(F.col("text")).alias("tokens")
    )
    kind = lambda t: F.when(~t.rlike("^[A-Z]"), "").when(F.length(t) >= 6, "LONG").otherwise("SHORT")
    rows = rows.withColumn("_kinds", F.transform("tokens", kind))
    rows = rows.withColumn("_before", F.concat(F.array(F.lit("")), F.slice("_kinds", 1, F.greatest(F.size("_kinds") - 1, F.lit(0)))))
    gold = F.zip_with(
        "_kinds",
        F.slice("_before", 1, F.size("_kinds")),
        lambda k, b: F.when(k == "", "O").when(k == b, F.concat(F.lit("I-"), k)).otherwise(F.concat(F.lit("B-"), k)),
    )
    rows = rows.withColumn("gold", gold)
    changed = lambda i: F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7 + i, F.lit(7)) == 0
    pred = F.transform("gold", lambda g, i: F.when(~changed(i), g).when(g == "O", "B-SHORT").otherwise("O"))
    return rows.withColumn("pred", pred).drop("_kinds", "_before")


def fold_sql(parts: int, part: int, vec: str = "embedding", value: str = "x::DOUBLE") -> str:
    """Sum of every ``parts``-th value of a vector."""
    kept = f"list_filter({vec}, lambda x, i: (i - 1) % {parts} = {part})"
    return f"list_sum(list_transform({kept}, lambda x: {value}))"


SQL_TOKENS = f"""
sents AS (SELECT conv_id, turn, {sql_tokens('text')} AS toks FROM conversations),
toks AS (SELECT conv_id, turn, i - 1 AS pos, toks[i] AS token FROM sents, unnest(range(1, len(toks) + 1)) AS r(i))"""

SQL_TAGS = f"""{SQL_TOKENS},
kinds AS (
  SELECT *, CASE WHEN NOT regexp_matches(token, '^[A-Z]') THEN '' WHEN length(token) >= 6 THEN 'LONG' ELSE 'SHORT' END AS kind
  FROM toks
),
golds AS (
  SELECT *, CASE WHEN kind = '' THEN 'O'
                 WHEN kind = lag(kind, 1, '') OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 'I-' || kind
                 ELSE 'B-' || kind END AS gold
  FROM kinds
),
tags AS (
  SELECT *, CASE WHEN (conv_id * 31 + turn * 7 + pos) % 7 <> 0 THEN gold WHEN gold = 'O' THEN 'B-SHORT' ELSE 'O' END AS pred
  FROM golds
)"""


def tag_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAG_IDS.items()), "label string, label_id int")


SQL_TAG_MAP = "tag_map AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in TAG_IDS.items()) + ") AS t(label, label_id))"


def token_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged sentences in the layout of a token-classification CSV."""
    rows = labels.map_label_arrays(
        tagged_sentences(spark, sf_dir), "gold", tag_map(spark), "label", "label_id", ["conv_id", "turn"], "ids"
    )
    return rows.select(
        "conv_id",
        "turn",
        F.array_join("tokens", " ").alias("text"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("label"),
    )


@query(
    "label_level",
    f"""WITH {SQL_TAGS},
lines AS (
  SELECT 'conversations' AS dataset, string_agg(gold, ' ' ORDER BY pos) AS label FROM tags GROUP BY conv_id, turn
  UNION ALL SELECT 'labels', quality::VARCHAR FROM labels
)
SELECT dataset, CASE WHEN bool_or(contains(label, ' ')) THEN 'token' ELSE 'sequence' END AS level FROM lines GROUP BY 1""",
)
def label_level(spark, sf_dir):
    """Level found in a token dataset and in a sequence dataset."""
    token = labels.label_level(token_csv(spark, sf_dir)).withColumn("dataset", F.lit("conversations"))
    sequence = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("label"))
    return token.unionByName(labels.label_level(sequence).withColumn("dataset", F.lit("labels"))).select("dataset", "level")


@query(
    "flatten_labels",
    f"""WITH {SQL_TAGS}, {SQL_TAG_MAP}
SELECT conv_id, turn, pos::BIGINT AS pos, token, label_id AS label FROM tags JOIN tag_map ON label = gold""",
)
def flatten_labels(spark, sf_dir):
    rows = labels.for_task(token_csv(spark, sf_dir), "token_classification")
    return labels.flatten_labels(rows, ["conv_id", "turn"], "tokens", "labels")


@query(
    "whitespace_tokens",
    f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, length(array_to_string(t, ''))::BIGINT AS n_letters,
       md5(array_to_string(t, ' ')) AS joined FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) AS d""",
)
def whitespace_tokens_query(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", whitespace_tokens(F.col("text")).alias("t"))
    return docs.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.length(F.array_join("t", "")).cast("long").alias("n_letters"),
        F.md5(F.array_join("t", " ")).alias("joined"),
    )


@query(
    "split_tokens",
    """SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n_tokens,
       len(list_filter(string_split(text, ' '), lambda x: x = ''))::BIGINT AS n_empty FROM documents""",
)
def split_tokens(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", split_spaces(F.col("text")).alias("t"))
    return docs.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.filter("t", lambda x: x == "")).cast("long").alias("n_empty"),
    )


@query(
    "dataset_counts",
    f"WITH {SQL_TOKENS} SELECT (SELECT count(*) FROM sents)::BIGINT AS inputs, (SELECT count(*) FROM toks)::BIGINT AS labels",
)
def dataset_counts(spark, sf_dir):
    return labels.dataset_counts(tagged_sentences(spark, sf_dir), "gold")


@query(
    "label_index",
    f"WITH {SQL_TAGS} SELECT gold AS label, (row_number() OVER (ORDER BY gold) - 1)::INT AS label_id FROM (SELECT DISTINCT gold FROM tags) AS d",
)
def label_index(spark, sf_dir):
    long = labels.flatten_labels(tagged_sentences(spark, sf_dir), ["conv_id"], "tokens", "gold")
    return labels.label_index(long)


def source_index(spark, sf_dir):
    return labels.label_index(table(spark, sf_dir, "documents").select(F.col("source").alias("label")))


SQL_SOURCE_INDEX = "idx AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INT AS label_id FROM (SELECT DISTINCT source FROM documents) AS d)"


@query(
    "label_map_join",
    f"WITH {SQL_SOURCE_INDEX} SELECT doc_id, source AS label, label_id FROM documents JOIN idx USING (source)",
)
def label_map_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return labels.label_ids(docs, source_index(spark, sf_dir)).select("doc_id", "label", "label_id")


@query(
    "label_id_lookup",
    f"""WITH {SQL_SOURCE_INDEX}
SELECT doc_id, (doc_id * 7 % 20)::INT AS predicted, idx.source AS label
FROM documents LEFT JOIN idx ON label_id = doc_id * 7 % 20""",
)
def label_id_lookup(spark, sf_dir):
    """Predicted ids (made from the document id) back to label names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod(F.col("doc_id") * 7, F.lit(20)).cast("int").alias("predicted"))
    return labels.label_names(docs, source_index(spark, sf_dir), "predicted").select("doc_id", "predicted", "label")


@query(
    "length_check",
    f"""SELECT conv_id, turn, len(a)::BIGINT AS n_text, len(b)::BIGINT AS n_labels
FROM (SELECT conv_id, turn, string_split(text, ' ') AS a, {sql_tokens('text')} AS b FROM conversations) AS t WHERE len(a) <> len(b)""",
)
def length_check(spark, sf_dir):
    """Turns whose single-space split disagrees with their white space tokens."""
    rows = texts(spark, sf_dir, "conversations").select(
        "conv_id", "turn", split_spaces(F.col("text")).alias("a"), whitespace_tokens(F.col("text")).alias("b")
    )
    return labels.length_mismatches(rows, "a", "b").select(
        "conv_id", "turn", F.size("a").cast("long").alias("n_text"), F.size("b").cast("long").alias("n_labels")
    )


@query(
    "seeded_shuffle",
    "SELECT doc_id, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':4012'), doc_id) - 1)::BIGINT AS position FROM documents",
)
def seeded_shuffle(spark, sf_dir):
    return splits.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4012)


SQL_SPLIT = """
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':4012'), doc_id) AS rn, count(*) OVER () AS n FROM {source})
SELECT doc_id, CASE WHEN rn <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
                    WHEN rn <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'dev' ELSE 'test' END AS split
FROM ranked"""


@query("seeded_split", "WITH " + SQL_SPLIT.format(source="documents"))
def seeded_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.seeded_split(docs, "doc_id", 4012).select("doc_id", "split")


@query(
    "concat_splits",
    "WITH parts AS (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE lang <> 'en'), "
    + SQL_SPLIT.format(source="parts"),
)
def concat_splits(spark, sf_dir):
    """A given train part and test part put together, then split anew."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = docs.where("lang = 'en'").unionByName(docs.where("lang <> 'en'"))
    return splits.seeded_split(both, "doc_id", 4012).select("doc_id", "split")


def _words(spark, sf_dir, name):
    words = F.explode_outer(whitespace_tokens(F.col("text"))).alias("label")
    return texts(spark, sf_dir, name).select(words).where("label IS NOT NULL")


SQL_WORDS = f"""
bench AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS label FROM benchmark),
conv AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS label FROM conversations)"""


@query("unseen_labels", f"WITH {SQL_WORDS} SELECT label FROM conv WHERE label NOT IN (SELECT label FROM bench)")
def unseen_labels(spark, sf_dir):
    """Words of the conversations that the benchmark texts do not hold."""
    return labels.unseen_labels(_words(spark, sf_dir, "benchmark"), _words(spark, sf_dir, "conversations"))


@query("label_union", f"WITH {SQL_WORDS} SELECT label FROM conv UNION SELECT label FROM bench")
def label_union(spark, sf_dir):
    return labels.label_union(_words(spark, sf_dir, "benchmark"), _words(spark, sf_dir, "conversations"))


@query(
    "pair_concat",
    """SELECT conv_id, turn, encoder, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (
  SELECT a.conv_id, a.turn, e.encoder,
         a.text || CASE WHEN e.encoder IN ('roberta-base', 'cardiffnlp/twitter-roberta-base') THEN '</s>' ELSE '[SEP]' END || b.text AS t
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1,
       (VALUES """
    + ", ".join(f"('{e}')" for e in ENCODERS)
    + ") AS e(encoder)) AS p",
)
def pair_concat(spark, sf_dir):
    """Consecutive turns as sentence pairs, for each encoder with its family's separator."""
    turns = texts(spark, sf_dir, "conversations")
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text2"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("text1")).join(nexts, ["conv_id", "turn"])
    listed = F.array(*[F.lit(e) for e in ENCODERS])
    columns = pairs.select("text1", "text2", F.col("conv_id").alias("label"), "turn", F.explode(listed).alias("encoder"))
    joined = labels.joined_texts(columns, labels.encoder_separator(F.col("encoder")))
    return joined.select(
        F.col("label").alias("conv_id"), "turn", "encoder", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


@query(
    "label_constant_map",
    "SELECT event_id, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_IDS.items())
    + " END::INT AS label FROM events",
)
def label_constant_map(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", labels.map_constants(F.col("event_type"), EVENT_IDS).alias("label"))


@query(
    "conll_to_string",
    f"""WITH {SQL_TAGS}, {SQL_TAG_MAP}
SELECT conv_id, turn, string_agg(token, ' ' ORDER BY pos) AS text, string_agg(label_id::VARCHAR, ' ' ORDER BY pos) AS label
FROM tags JOIN tag_map ON label = gold GROUP BY 1, 2""",
)
def conll_to_string(spark, sf_dir):
    """Sentences rendered as token lines, parsed back, and written as text and label ids."""
    sents = tagged_sentences(spark, sf_dir).where(F.size("tokens") > 0)
    records = sents.select("conv_id", "turn", render_bio(F.col("tokens"), F.col("gold")).alias("record"))
    parsed = records.select("conv_id", "turn", parse_bio(F.col("record")).alias("w"))
    arrays = parsed.select("conv_id", "turn", F.col("w.token").alias("tokens"), F.col("w.tag").alias("tags"))
    ids = labels.map_label_arrays(arrays, "tags", tag_map(spark), "label", "label_id", ["conv_id", "turn"], "ids")
    return ids.select(
        "conv_id",
        "turn",
        F.array_join("tokens", " ").alias("text"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("label"),
    )


@query(
    "string_to_conll",
    f"""WITH {SQL_TAGS}
SELECT conv_id, turn, string_agg(token || chr(9) || gold, chr(10) ORDER BY pos) AS record FROM tags GROUP BY 1, 2""",
)
def string_to_conll(spark, sf_dir):
    rows = labels.for_task(token_csv(spark, sf_dir).where("text <> ''"), "token_classification")
    tags = labels.map_label_arrays(rows, "labels", tag_map(spark), "label_id", "label", ["conv_id", "turn"], "tags")
    return tags.select("conv_id", "turn", render_bio(F.col("tokens"), F.col("tags")).alias("record"))
