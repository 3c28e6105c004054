"""Treebank queries on CoNLL-U text that Spark derives from the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.text import whitespace_tokens
from encoscope.functions.vectors import fold
from encoscope.operators import labels, treebank
from encoscope.plans import query, table, texts
from encoscope.plans.data import SQL_TOKENS, fold_sql
from encoscope.sources import conllu

# Genre and language of the three files that the roles stand for.
FILE_META = {
    "en_assistant-ud-test.conllu": {"Language": "English", "Treebank": "Assistant", "Genre": "web reviews"},
    "en_system-ud-dev.conllu": {"Language": "English", "Treebank": "System", "Genre": "legal"},
    "fr_user-ud-train.conllu": {"Language": "French", "Treebank": "User", "Genre": "spoken web"},
}
ROLE_FILES = {"assistant": "en_assistant-ud-test.conllu", "system": "en_system-ud-dev.conllu", "user": "fr_user-ud-train.conllu"}


def conllu_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CoNLL-U record per turn. A long first token is a range of two words; some turns end in an
    empty node; long tokens carry features, tokens with a final stop have no blank after them."""
    rows = texts(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", whitespace_tokens(F.col("text")).alias("tokens")
    ).where(F.size("tokens") > 0)
    files = F.create_map(*[F.lit(x) for pair in ROLE_FILES.items() for x in pair])
    # wider than any turn number, so that the pair of ids becomes one in the same order
    span = table(spark, sf_dir, "conversations").agg(F.coalesce(F.max("turn") + 1, F.lit(1))).first()[0]
    rows = rows.select(
        F.element_at(files, F.col("role")).alias("file"),
        (F.col("conv_id") * span + F.col("turn")).alias("ord"),
        "conv_id",
        "turn",
        "role",
        "tokens",
        F.when(F.length(F.get("tokens", F.lit(0))) >= 6, 1).otherwise(0).alias("_shift"),
    )
    newdoc = F.when((F.col("turn") <= 1) & (F.col("conv_id") % 3 != 0), F.concat(F.lit("# newdoc id = c"), "conv_id"))
    odd = F.when(F.col("turn") == 2, F.lit("# an odd remark"))
    comments = F.array_compact(
        F.array(newdoc, F.concat(F.lit("# sent_id = s-"), "conv_id", F.lit("-"), "turn"), F.concat(F.lit("# speaker "), "role"), odd)
    )
    feats = lambda t: F.when(F.length(t) >= 6, "Number=Plur|Case=Nom").otherwise("_")
    misc = lambda t: F.when(t.rlike("[.]$"), "SpaceAfter=No").otherwise("_")
    upos = lambda t: F.when(t.rlike("^[A-Z]"), "PROPN").otherwise("X")

    def line(word_id, form, head, relation, plain=True, token=None):
        token = form if token is None else token
        tags = [upos(token), F.lit("_"), feats(token)] if plain else [F.lit("_")] * 3
        return F.concat_ws("\t", word_id, form, F.lower(form), *tags, head, relation, F.lit("_"), misc(token))

    def lines(t, i):
        rel = F.when(t.rlike("^[A-Z]"), "nsubj:cap").otherwise("dep")
        at = i + 1 + F.col("_shift")
        single = F.array(line(at.cast("string"), t, (at - 1).cast("string"), F.when(at == 1, "root").otherwise(rel)))
        half = F.floor(F.length(t) / 2).cast("int")
        parts = F.array(
            line(F.lit("1-2"), t, F.lit("_"), F.lit("_"), plain=False),
            line(F.lit("1"), F.substr(t, F.lit(1), half), F.lit("0"), F.lit("root")),
            line(F.lit("2"), F.substr(t, half + 1), F.lit("1"), F.lit("dep")),
        )
        return F.when((i == 0) & (F.col("_shift") == 1), parts).otherwise(single)

    last = (F.size("tokens") + F.col("_shift")).cast("string")
    empty = F.array(F.concat_ws("\t", F.concat(last, F.lit(".1")), F.lit("gap"), *[F.lit("_")] * 8))
    none = F.array().cast("array<string>")
    body = F.concat(F.flatten(F.transform("tokens", lines)), F.when(F.col("turn") % 2 == 0, empty).otherwise(none))
    return rows.select("file", "ord", "conv_id", "turn", F.array_join(F.concat(comments, body), "\n").alias("record"))


def sentences(spark, sf_dir, maps: bool = False) -> DataFrame:
    return conllu.parse_sentences(conllu_records(spark, sf_dir), maps=maps).drop("record", "corrupt")


def meta_rows(spark) -> DataFrame:
    return spark.createDataFrame([(f, m) for f, m in FILE_META.items()], "file string, meta map<string,string>")


SQL_FILES = f"""{SQL_TOKENS},
roles AS (
  SELECT s.conv_id, s.turn, (s.conv_id, s.turn) AS ord, c.role, s.toks, (length(toks[1]) >= 6)::INT AS shift,
         CASE c.role WHEN 'assistant' THEN 'en_assistant-ud-test.conllu' WHEN 'system' THEN 'en_system-ud-dev.conllu'
                     ELSE 'fr_user-ud-train.conllu' END AS file
  FROM sents s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn WHERE len(s.toks) > 0
),
words AS (
  SELECT t.conv_id, t.turn, t.pos + 1 + shift AS id, token AS form, token, pos
  FROM toks t JOIN roles r ON r.conv_id = t.conv_id AND r.turn = t.turn WHERE NOT (pos = 0 AND shift = 1)
  UNION ALL SELECT conv_id, turn, 1, substr(toks[1], 1, (length(toks[1]) // 2)::BIGINT), toks[1], 0 FROM roles WHERE shift = 1
  UNION ALL SELECT conv_id, turn, 2, substr(toks[1], (length(toks[1]) // 2 + 1)::BIGINT), toks[1], 0 FROM roles WHERE shift = 1
),
parsed AS (
  SELECT w.conv_id, w.turn, id, w.form, id - 2 AS head,
         CASE WHEN regexp_matches(form, '^[A-Z]') THEN 'PROPN' ELSE 'X' END AS upos,
         CASE WHEN id = 1 THEN 'root' WHEN shift = 1 AND id = 2 THEN 'dep'
              WHEN regexp_matches(form, '^[A-Z]') THEN 'nsubj:cap' ELSE 'dep' END AS deprel
  FROM words w JOIN roles r ON r.conv_id = w.conv_id AND r.turn = w.turn
)"""

SQL_INDEX = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) - 1 AS sent, row_number() OVER (ORDER BY file, ord) - 1 AS idx FROM roles
)"""


@query(
    "conllu_words",
    f"WITH {SQL_FILES} SELECT conv_id, turn, (id - 1)::INT AS pos, form, upos, head::INT AS head, split_part(deprel, ':', 1) AS relation FROM parsed",
)
def conllu_words(spark, sf_dir):
    """Forms, tags, heads and relations of the words of every sentence."""
    words = F.col("words")
    columns = F.arrays_zip(
        treebank.word_forms(words).alias("form"),
        treebank.part_of_speech(words).alias("upos"),
        treebank.heads(words).alias("head"),
        treebank.relations(words, include_subtypes=False).alias("relation"),
    )
    return sentences(spark, sf_dir).select("conv_id", "turn", F.posexplode_outer(columns).alias("pos", "w")).where("pos IS NOT NULL").select(
        "conv_id", "turn", "pos", "w.form", "w.upos", "w.head", "w.relation"
    )


@query(
    "conllu_text",
    f"""WITH {SQL_FILES}
SELECT r.conv_id, r.turn, count(*)::BIGINT AS n_tokens,
       md5(string_agg(token || CASE WHEN ends_with(token, '.') THEN '' ELSE ' ' END, '' ORDER BY pos)) AS digest
FROM roles r JOIN toks t ON t.conv_id = r.conv_id AND t.turn = r.turn GROUP BY 1, 2""",
)
def conllu_text(spark, sf_dir):
    """Surface tokens and running text."""
    words = F.col("words")
    return sentences(spark, sf_dir, maps=True).select(
        "conv_id",
        "turn",
        F.size(treebank.token_forms(words)).cast("long").alias("n_tokens"),
        F.md5(treebank.sentence_text(words)).alias("digest"),
    )


@query(
    "conllu_stats",
    f"""WITH {SQL_FILES},
per_sentence AS (SELECT conv_id, turn, count(*) AS n FROM parsed GROUP BY 1, 2)
SELECT file, count(*)::BIGINT AS sentences, sum(len(toks))::BIGINT AS tokens, sum(n)::BIGINT AS words
FROM roles r JOIN per_sentence p ON p.conv_id = r.conv_id AND p.turn = r.turn GROUP BY 1""",
)
def conllu_stats(spark, sf_dir):
    return treebank.statistics(sentences(spark, sf_dir))


@query(
    "conllu_metadata_keys",
    f"""WITH {SQL_FILES}
SELECT DISTINCT file, unnest(['sent_id', 'speaker']) AS key FROM roles
UNION SELECT file, 'newdoc id' FROM roles WHERE turn <= 1 AND conv_id % 3 <> 0
UNION SELECT file, 'unknown' FROM roles WHERE turn = 2""",
)
def conllu_metadata_keys(spark, sf_dir):
    return treebank.metadata_keys(sentences(spark, sf_dir))


@query(
    "conllu_metadata",
    f"""WITH {SQL_FILES}
SELECT conv_id, turn, CASE WHEN turn <= 1 AND conv_id % 3 <> 0 THEN 'c' || conv_id END AS newdoc, 's-' || conv_id || '-' || turn AS sent_id,
       role AS speaker, CASE WHEN turn = 2 THEN 'an odd remark' ELSE '' END AS remarks FROM roles""",
)
def conllu_metadata(spark, sf_dir):
    meta = conllu.parse_metadata(F.col("comments"))
    rows = sentences(spark, sf_dir).select("conv_id", "turn", "comments", meta.alias("m"))
    return rows.select(
        "conv_id",
        "turn",
        F.try_element_at("m", F.lit("newdoc id")).alias("newdoc"),
        F.try_element_at("m", F.lit("sent_id")).alias("sent_id"),
        F.try_element_at("m", F.lit("speaker")).alias("speaker"),
        F.array_join(conllu.unknown_comments(F.col("comments")), "; ").alias("remarks"),
    )


@query("corpus_index", f"WITH {SQL_FILES}, {SQL_INDEX} SELECT conv_id, turn, file, sent::BIGINT AS sent, idx::BIGINT AS idx FROM placed")
def corpus_index(spark, sf_dir):
    return treebank.corpus_index(conllu_records(spark, sf_dir), "ord").select("conv_id", "turn", "file", "sent", "idx")


@query(
    "corpus_runs",
    f"""WITH {SQL_FILES}, {SQL_INDEX},
langs AS (SELECT *, CASE WHEN starts_with(file, 'en') THEN 'English' ELSE 'French' END AS language FROM placed),
marked AS (SELECT *, CASE WHEN language IS DISTINCT FROM lag(language) OVER (ORDER BY idx) THEN 1 ELSE 0 END AS changed FROM langs),
numbered AS (SELECT *, sum(changed) OVER (ORDER BY idx) - 1 AS run FROM marked)
SELECT run::BIGINT AS run, language, count(*)::BIGINT AS sentences, min(idx)::BIGINT AS first_idx, max(idx)::BIGINT AS last_idx
FROM numbered GROUP BY 1, 2""",
)
def corpus_runs(spark, sf_dir):
    """Contiguous runs of sentences of one language."""
    rows = treebank.corpus_index(conllu_records(spark, sf_dir), "ord").drop("record")
    named = conllu.with_meta(rows, meta_rows(spark)).withColumn("language", F.element_at("meta", "Language"))
    numbered = treebank.runs_by(named, "language")
    return numbered.groupBy("run", "language").agg(
        F.count("*").alias("sentences"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


@query(
    "sentences_by_treebank",
    f"""WITH {SQL_FILES}, {SQL_INDEX}
SELECT replace(replace(replace(file, '.conllu', ''), '-ud-', '-'), '_', '-') AS treebank, count(*)::BIGINT AS sentences,
       min(idx)::BIGINT AS first_idx, max(idx)::BIGINT AS last_idx FROM placed GROUP BY 1""",
)
def sentences_by_treebank(spark, sf_dir):
    rows = treebank.corpus_index(conllu_records(spark, sf_dir), "ord")
    return treebank.sentences_by(rows.withColumn("treebank", conllu.treebank_name(F.col("file"))), "treebank")


@query(
    "conllu_doc_groups",
    f"""WITH {SQL_FILES}, {SQL_INDEX},
counted AS (SELECT *, sum((turn <= 1 AND conv_id % 3 <> 0)::INT) OVER (PARTITION BY file ORDER BY sent) AS n FROM placed)
SELECT conv_id, turn, CASE WHEN n > 0 THEN 'group-' || (n - 1)::BIGINT ELSE 'unknown' END AS "group" FROM counted""",
)
def conllu_doc_groups(spark, sf_dir):
    return treebank.group_by_comment(sentences(spark, sf_dir), "newdoc", sent="ord").select("conv_id", "turn", "group")


@query(
    "conllu_meta_groups",
    f"""WITH {SQL_FILES}, {SQL_INDEX},
carried AS (
  SELECT *, last_value(CASE WHEN turn <= 1 AND conv_id % 3 <> 0 THEN conv_id END IGNORE NULLS)
    OVER (PARTITION BY file ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc FROM placed
)
SELECT conv_id, turn, coalesce('c' || doc, 'unknown') AS whole, coalesce(left(doc::VARCHAR, 1), 'unknown') AS first_digit FROM carried""",
)
def conllu_meta_groups(spark, sf_dir):
    """Groups by the last document id, and by a part of it that a pattern picks."""
    rows = sentences(spark, sf_dir).select("file", "ord", "conv_id", "turn", "comments")
    whole = treebank.group_by_metadata(rows, "newdoc id", sent="ord")
    digit = treebank.group_of_value(F.col("group"), r"c(?P<val1>\d)")
    return whole.select("conv_id", "turn", F.col("group").alias("whole"), digit.alias("first_digit"))


@query(
    "conllu_filter",
    f"""WITH {SQL_FILES}, {SQL_INDEX}
SELECT conv_id, turn, idx::BIGINT AS idx, file <> 'en_system-ud-dev.conllu' AS in_web,
       file = 'en_system-ud-dev.conllu' AS not_web, file = 'fr_user-ud-train.conllu' AS exact_spoken_web,
       starts_with(file, 'en') AS english, starts_with(file, 'en') OR file = 'fr_user-ud-train.conllu' AS any_of_two,
       starts_with(file, 'en') AND file <> 'en_system-ud-dev.conllu' AS all_of_two,
       idx IN (SELECT doc_id FROM documents WHERE lang = 'en') AS listed FROM placed""",
)
def conllu_filter(spark, sf_dir):
    """Every filter as a kept-flag; the corpus index stays as it is."""
    rows = treebank.corpus_index(conllu_records(spark, sf_dir), "ord").drop("record")
    named = conllu.with_meta(rows, meta_rows(spark))
    web = treebank.domain_filter(["web"])
    spoken = treebank.domain_filter(["web", "spoken"], "exact")
    english = treebank.metadata_filter("Language", ["English"])
    flags = named.withColumns(
        {
            "in_web": web,
            "not_web": treebank.domain_filter(["web"], "exclude"),
            "exact_spoken_web": spoken,
            "english": english,
            "any_of_two": treebank.any_of(english, spoken),
            "all_of_two": treebank.all_of(english, web),
        }
    )
    english_docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    kept = treebank.index_filter(flags, english_docs).withColumnRenamed("kept", "listed")
    return kept.select(
        "conv_id", "turn", "idx", "in_web", "not_web", "exact_spoken_web", "english", "any_of_two", "all_of_two", "listed"
    )


@query(
    "conllu_distribution_filter",
    f"""WITH {SQL_FILES}, {SQL_INDEX},
dist AS (
  SELECT vec_id, CASE WHEN a >= greatest(b, c) THEN 'web' WHEN b >= c THEN 'legal' ELSE 'spoken' END AS domain
  FROM (SELECT vec_id, {fold_sql(3, 0)} AS a, {fold_sql(3, 1)} AS b, {fold_sql(3, 2)} AS c FROM embeddings) AS folded
)
SELECT conv_id, turn, coalesce(domain IN ('web', 'spoken'), false) AS kept FROM placed LEFT JOIN dist ON vec_id = idx""",
)
def conllu_distribution_filter(spark, sf_dir):
    """Sentences kept by the most probable domain of a distribution per corpus index (every third dimension summed)."""
    rows = treebank.corpus_index(conllu_records(spark, sf_dir), "ord").drop("record")
    dist = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), fold(F.col("embedding"), 3).alias("dist"))
    return treebank.distribution_filter(rows, dist, ["web", "legal", "spoken"], ["web", "spoken"]).select("conv_id", "turn", "kept")


@query(
    "conllu_relations",
    f"""WITH {SQL_FILES}
SELECT DISTINCT deprel AS relation, split_part(deprel, ':', 1) IN ('root', 'dep', 'nsubj') AS known FROM parsed""",
)
def conllu_relations(spark, sf_dir):
    found = treebank.relation_set(sentences(spark, sf_dir), include_subtypes=True)
    unknown = treebank.unknown_relations(found).withColumn("known", F.lit(False))
    return found.join(unknown, "relation", "left").withColumn("known", F.coalesce("known", F.lit(True)))


@query(
    "conllu_domains",
    f"""WITH {SQL_FILES}
SELECT DISTINCT unnest(CASE WHEN file = 'en_system-ud-dev.conllu' THEN ['legal'] WHEN file = 'fr_user-ud-train.conllu'
       THEN ['spoken', 'web'] ELSE ['reviews', 'web'] END) AS domain FROM roles""",
)
def conllu_domains(spark, sf_dir):
    files = conllu_records(spark, sf_dir).select("file").distinct()
    return treebank.domain_set(files.join(meta_rows(spark), "file"))


@query(
    "conllu_dataset",
    f"""WITH {SQL_FILES},
rels AS (SELECT *, split_part(deprel, ':', 1) AS rel FROM parsed),
idx AS (SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS label_id FROM (SELECT DISTINCT rel FROM rels) AS d)
SELECT conv_id, turn, string_agg(form, ' ' ORDER BY id) AS text, string_agg(label_id::VARCHAR, ' ' ORDER BY id) AS label
FROM rels JOIN idx USING (rel) GROUP BY 1, 2""",
)
def conllu_dataset(spark, sf_dir):
    """Treebank as a token dataset: words and relation ids."""
    rows = sentences(spark, sf_dir)
    index = labels.label_index(treebank.relation_set(rows), "relation").withColumnRenamed("relation", "label")
    return treebank.relation_dataset(rows, index, ["conv_id", "turn"])


SQL_RESOLVED = f"""{SQL_FILES},
lines AS (
  SELECT p.conv_id, p.turn, p.id, concat_ws(chr(9), p.id, p.form, lower(p.form), upos, '_',
         CASE WHEN length(p.form) >= 6 THEN 'Case=Nom|Number=Plur' ELSE '_' END, p.id - 1, deprel, '_',
         CASE WHEN ends_with(p.form, '.') THEN 'SpaceAfter=No' ELSE '_' END) AS line FROM parsed p
),
resolved AS (SELECT conv_id, turn, md5(string_agg(line, chr(10) ORDER BY id)) AS resolved, count(*) AS n FROM lines GROUP BY 1, 2)"""


@query("conllu_render", f"WITH {SQL_RESOLVED} SELECT conv_id, turn, resolved FROM resolved")
def conllu_render(spark, sf_dir):
    """Sentences written with multiword tokens resolved and dictionaries in key order."""
    text = conllu.render_sentence(F.col("words"), resolve=True)
    return sentences(spark, sf_dir, maps=True).select("conv_id", "turn", F.md5(text).alias("resolved"))


@query(
    "conllu_round_trip",
    f"WITH {SQL_RESOLVED} SELECT conv_id, turn, true AS same, resolved FROM resolved",
)
def conllu_round_trip(spark, sf_dir):
    """Writing a parsed sentence, parsing and writing it again gives the same text."""
    first = sentences(spark, sf_dir, maps=True).select("conv_id", "turn", conllu.render_sentence(F.col("words"), F.col("comments")).alias("record"))
    again = conllu.parse_sentences(first)
    same = conllu.render_sentence(F.col("words"), F.col("comments")) == F.col("record")
    resolved = F.md5(conllu.render_sentence(F.col("words"), resolve=True))
    return again.select("conv_id", "turn", same.alias("same"), resolved.alias("resolved"))
