"""Embedding queries: static vectors, pooling, subwords, user models, LEEP."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.text import recombine_pieces, whitespace_tokens
from encoscope.functions.vectors import array_sum, fold
from encoscope.operators import embed, leep
from encoscope.plans import query, table, texts
from encoscope.plans.data import SQL_TOKENS, sql_tokens

PIECE = 3
BUCKETS = 16


def _hashed(word) -> F.Column:
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")


def word_vectors(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """Each word of ``words`` with the embedding its hash points at."""
    rows = table(spark, sf_dir, "embeddings")
    count = rows.count()
    ids = words.withColumn("vec_id", F.pmod(_hashed(F.col("word")), F.lit(count)))
    return ids.join(rows.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("word", "vec")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark texts, and the unknown word."""
    texts = table(spark, sf_dir, "benchmark").select(F.explode(whitespace_tokens(F.col("text"))).alias("word")).distinct()
    unknown = spark.createDataFrame([(embed.UNKNOWN_WORD,)], "word string")
    return word_vectors(spark, sf_dir, texts.union(unknown))


SQL_VOCABULARY = f"""
words AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS word FROM benchmark UNION SELECT 'UNK'),
vocab_ids AS MATERIALIZED (SELECT word, ('0x' || left(md5(word), 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM words),
vocab AS MATERIALIZED (SELECT word, embedding AS vec FROM vocab_ids JOIN embeddings USING (vec_id))"""

SQL_TOKEN_VECTORS = f"""{SQL_TOKENS}, {SQL_VOCABULARY},
vectors AS MATERIALIZED (
  SELECT t.conv_id, t.turn, t.pos, t.token, v.word IS NOT NULL AS known, coalesce(v.vec, u.vec) AS vec
  FROM toks t LEFT JOIN vocab v ON v.word = t.token, (SELECT vec FROM vocab WHERE word = 'UNK') AS u
)"""


def conversation_tokens(spark, sf_dir):
    return texts(spark, sf_dir, "conversations").select("conv_id", "turn", whitespace_tokens(F.col("text")).alias("tokens"))


@query(
    "token_vectors",
    f"""WITH {SQL_TOKEN_VECTORS}
SELECT conv_id, turn, pos::INT AS pos, known, round(vec[1]::DOUBLE, 6) AS v_first, round(vec[len(vec)]::DOUBLE, 6) AS v_last,
       round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 6) + 0.0 AS v_sum FROM vectors""",
)
def token_vectors(spark, sf_dir):
    rows = embed.token_rows(conversation_tokens(spark, sf_dir), ["conv_id", "turn"])
    vectors = embed.static_vectors(rows, vocabulary(spark, sf_dir))
    return vectors.select(
        "conv_id",
        "turn",
        "pos",
        "known",
        F.round(F.element_at("vec", 1).cast("double"), 6).alias("v_first"),
        F.round(F.element_at("vec", -1).cast("double"), 6).alias("v_last"),
        F.round(array_sum(F.col("vec").cast("array<double>")), 6).alias("v_sum"),
    )


def _pooled(df):
    return df.select(
        "conv_id",
        "turn",
        F.round(F.element_at("features", 1), 6).alias("v_first"),
        F.round(F.element_at("features", -1), 6).alias("v_last"),
        F.round(array_sum(F.col("features")), 6).alias("v_sum"),
    )


@query(
    "mean_pool_static",
    f"""WITH {SQL_TOKEN_VECTORS},
dims AS (SELECT conv_id, turn, d, avg(vec[d]::DOUBLE) AS v FROM vectors, unnest(range(1, len(vec) + 1)) AS r(d) GROUP BY 1, 2, 3)
SELECT conv_id, turn, round(arg_min(v, d), 6) + 0.0 AS v_first, round(arg_max(v, d), 6) + 0.0 AS v_last, round(sum(v), 6) + 0.0 AS v_sum
FROM dims GROUP BY 1, 2""",
)
def mean_pool_static(spark, sf_dir):
    return _pooled(embed.pooled_static(conversation_tokens(spark, sf_dir), ["conv_id", "turn"], vocabulary(spark, sf_dir), "mean"))


@query(
    "first_pool_static",
    f"""WITH {SQL_TOKEN_VECTORS}
SELECT conv_id, turn, round(vec[1]::DOUBLE, 6) AS v_first, round(vec[len(vec)]::DOUBLE, 6) AS v_last,
       round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 6) + 0.0 AS v_sum FROM vectors WHERE pos = 0""",
)
def first_pool_static(spark, sf_dir):
    return _pooled(embed.pooled_static(conversation_tokens(spark, sf_dir), ["conv_id", "turn"], vocabulary(spark, sf_dir), "first"))


def piece_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens cut into pieces of three characters, one special piece in front of each turn."""
    tokens = conversation_tokens(spark, sf_dir)
    cut = lambda w, t: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(t) - 1) / PIECE).cast("int")),
        lambda k: F.struct(
            w.alias("word"),
            F.substr(t, k * PIECE + 1, F.lit(PIECE)).alias("text"),
            (k * PIECE).alias("off_start"),
            F.least(k * PIECE + PIECE, F.length(t)).alias("off_end"),
            F.lit(False).alias("is_special"),
        ),
    )
    special = F.struct(
        F.lit(-1).alias("word"), F.lit("[CLS]").alias("text"), F.lit(0).alias("off_start"), F.lit(0).alias("off_end"), F.lit(True).alias("is_special")
    )
    pieces = F.concat(F.array(special), F.flatten(F.transform("tokens", lambda t, w: cut(w, t))))
    return tokens.select("conv_id", "turn", F.posexplode(pieces).alias("piece", "p")).select(
        "conv_id", "turn", "piece", "p.text", "p.off_start", "p.off_end", "p.is_special"
    )


def piece_inventory(spark, sf_dir, pieces):
    """A vector for each piece that comes."""
    return word_vectors(spark, sf_dir, pieces.select(F.col("text").alias("word")).distinct()).withColumnRenamed("word", "text")


SQL_PIECES = f"""{SQL_TOKENS},
pieces AS (
  SELECT conv_id, turn, pos, k, substr(token, (k * {PIECE} + 1)::BIGINT, {PIECE}) AS text
  FROM toks, unnest(range(0, (length(token) - 1) // {PIECE} + 1)) AS r(k)
),
ids AS (
  SELECT text, ('0x' || left(md5(text), 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT DISTINCT text FROM pieces) AS t
),
inventory AS (
  SELECT text, embedding[1]::DOUBLE AS x, embedding[len(embedding)]::DOUBLE AS y,
         list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM ids JOIN embeddings USING (vec_id)
),
with_vec AS (SELECT p.*, x, y, s FROM pieces p JOIN inventory i ON i.text = p.text)"""


@query(
    "subword_word_index",
    f"""WITH {SQL_PIECES}
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, k)::INT AS piece, text, pos::INT AS word FROM pieces""",
)
def subword_word_index(spark, sf_dir):
    return embed.word_index(piece_rows(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "piece", "text", "word")


@query(
    "subword_to_word_mean",
    f"""WITH {SQL_PIECES}
SELECT conv_id, turn, pos::INT AS pos, count(*)::BIGINT AS n_pieces, round(avg(x), 6) + 0.0 AS v_first,
       round(avg(y), 6) + 0.0 AS v_last, round(avg(s), 5) + 0.0 AS v_sum FROM with_vec GROUP BY 1, 2, 3
UNION ALL
SELECT conv_id, turn, -1, 1, round(e.embedding[1]::DOUBLE, 6), round(e.embedding[len(e.embedding)]::DOUBLE, 6),
       round(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)), 5) + 0.0
FROM conversations JOIN embeddings e ON vec_id = ('0x' || left(md5('[CLS]'), 8))::BIGINT % (SELECT count(*) FROM embeddings)""",
)
def subword_to_word_mean(spark, sf_dir):
    """Word vectors from piece vectors, with the special piece kept in front."""
    pieces = piece_rows(spark, sf_dir)
    words = embed.words_from_lookup(pieces, ["conv_id", "turn"], piece_inventory(spark, sf_dir, pieces), cls=True)
    return words.select(
        "conv_id",
        "turn",
        "pos",
        "n_pieces",
        F.round(F.element_at("vec", 1), 6).alias("v_first"),
        F.round(F.element_at("vec", -1), 6).alias("v_last"),
        F.round(array_sum(F.col("vec")), 5).alias("v_sum"),
    )


@query(
    "subword_recombine",
    f"""WITH {SQL_TOKENS}, families AS (SELECT unnest(['wordpiece', 'bpe']) AS family)
SELECT conv_id, turn, family, count(*)::BIGINT AS n_words, md5(string_agg(token, ' ' ORDER BY pos)) AS joined
FROM toks, families GROUP BY 1, 2, 3""",
)
def subword_recombine(spark, sf_dir):
    """Marked pieces of both tokenizer families put together into words again."""
    rows = conversation_tokens(spark, sf_dir).where(F.size("tokens") > 0)
    rows = rows.withColumn("family", F.explode(F.array(F.lit("wordpiece"), F.lit("bpe"))))
    mark = lambda k: F.when(
        F.col("family") == "bpe", F.when(k == 0, "\u0120").otherwise("")
    ).otherwise(F.when(k == 0, "").otherwise("##"))
    cut = lambda t: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(t) - 1) / PIECE).cast("int")),
        lambda k: F.concat(mark(k), F.substr(t, k * PIECE + 1, F.lit(PIECE))),
    )
    pieces = rows.select("conv_id", "turn", "family", F.flatten(F.transform("tokens", cut)).alias("pieces"))
    words = pieces.select("conv_id", "turn", "family", recombine_pieces(F.col("pieces"), F.col("family")).alias("w"))
    return words.select(
        "conv_id", "turn", "family", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("joined")
    )


def hashing_encoder():
    """A toy model: token counts in sixteen hash buckets. What it remembers is bounded."""
    known: dict[str, int] = {}

    def encode(texts):
        out = np.zeros((len(texts), BUCKETS))
        for row, tokens in enumerate(texts):
            for token in tokens:
                bucket = known.get(token)
                if bucket is None:
                    if len(known) >= 100_000:
                        known.clear()
                    bucket = known[token] = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % BUCKETS
                out[row, bucket] += 1
        return out

    return encode


def padded_encoder():
    """The same toy model over one padded matrix of token hashes a batch, as sequence models take them."""
    import numpy

    def bucket(token: str) -> int:
        return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % BUCKETS

    def encode(texts):
        longest = max(map(len, texts))
        cells = numpy.full((len(texts), longest), BUCKETS)
        for row, tokens in enumerate(texts):
            cells[row, : len(tokens)] = [bucket(t) for t in tokens]
        return numpy.stack([numpy.bincount(row, minlength=BUCKETS + 1)[:BUCKETS] for row in cells]).astype(float)

    return encode


@query(
    "embed_length_batches",
    f"""WITH words AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents),
counts AS (SELECT doc_id, ('0x' || left(md5(token), 8))::BIGINT % {BUCKETS} AS bucket, count(*) AS n FROM words GROUP BY 1, 2)
SELECT d.doc_id, r.bucket::INT AS bucket, coalesce(n, 0)::DOUBLE AS value
FROM documents d CROSS JOIN unnest(range(0, {BUCKETS})) AS r(bucket) LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.bucket = r.bucket""",
)
def embed_length_batches(spark, sf_dir):
    """Vectors of a model that pads, in batches of like length."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", whitespace_tokens(F.col("text")).alias("tokens"))
    vectors = embed.embed_texts(docs, padded_encoder, "tokens", cells=1 << 15)
    return vectors.select("doc_id", F.posexplode("features").alias("bucket", "value"))


@query(
    "embed_callable",
    f"""WITH words AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents),
counts AS (SELECT doc_id, ('0x' || left(md5(token), 8))::BIGINT % {BUCKETS} AS bucket, count(*) AS n FROM words GROUP BY 1, 2)
SELECT d.doc_id, r.bucket::INT AS bucket, coalesce(n, 0)::DOUBLE AS value
FROM documents d CROSS JOIN unnest(range(0, {BUCKETS})) AS r(bucket) LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.bucket = r.bucket""",
)
def embed_callable(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", whitespace_tokens(F.col("text")).alias("tokens"))
    vectors = embed.embed_texts(docs, hashing_encoder, "tokens")
    return vectors.select("doc_id", F.posexplode("features").alias("bucket", "value"))


def theta_rows(spark, sf_dir):
    """Source distribution over five classes from the sizes of all dimensions, three target classes."""
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", fold(sizes, 5).alias("a"), F.pmod("label", F.lit(3)).cast("string").alias("gold")
    )
    rows = rows.withColumn("_sum", array_sum(F.col("a")))
    return rows.select("vec_id", "gold", F.transform("a", lambda x: x / F.col("_sum")).alias("theta"))


SQL_THETA = """
abs5 AS (SELECT vec_id, (label % 3)::VARCHAR AS y, (i - 1) % 5 AS z, sum(abs(embedding[i]::DOUBLE)) AS a
         FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i) GROUP BY 1, 2, 3),
theta AS (SELECT vec_id, y, z, a / sum(a) OVER (PARTITION BY vec_id) AS p FROM abs5),
joint AS (SELECT y, z, sum(p) / (SELECT count(*) FROM embeddings) AS p FROM theta GROUP BY 1, 2),
cond AS (SELECT y, z, p / sum(p) OVER (PARTITION BY z) AS p FROM joint)"""


@query("leep_joint", f"WITH {SQL_THETA} SELECT y, z::INT AS z, round(p, 8) AS p FROM joint")
def leep_joint(spark, sf_dir):
    return leep.joint(theta_rows(spark, sf_dir)).select("y", "z", F.round("p", 8).alias("p"))


@query("leep_conditional", f"WITH {SQL_THETA} SELECT y, z::INT AS z, round(p, 8) AS p FROM cond")
def leep_conditional(spark, sf_dir):
    table_ = leep.conditional(leep.joint(theta_rows(spark, sf_dir)))
    return table_.select("y", "z", F.round("p", 8).alias("p"))


@query(
    "leep_paper",
    f"""WITH {SQL_THETA}, eep AS (SELECT vec_id, sum(t.p * c.p) AS e FROM theta t JOIN cond c ON c.y = t.y AND c.z = t.z GROUP BY 1)
SELECT round(avg(ln(e)), 8) AS leep FROM eep""",
)
def leep_paper(spark, sf_dir):
    return leep.leep(theta_rows(spark, sf_dir)).select(F.round("leep", 8).alias("leep"))


@query(
    "leep_by_target",
    f"""WITH {SQL_THETA},
means AS (SELECT z, sum(p) AS mean FROM joint GROUP BY 1),
marginals AS (SELECT y, sum(p) AS marginal FROM joint GROUP BY 1),
eep AS (SELECT t.p * mean / marginal AS e FROM theta t JOIN means m ON m.z = t.z JOIN marginals g ON g.y = t.y WHERE t.z = t.y::INT)
SELECT round(avg(ln(e)), 8) AS leep FROM eep""",
)
def leep_by_target(spark, sf_dir):
    targets = leep.label_positions(spark, ["0", "1", "2"], "y")
    return leep.leep(theta_rows(spark, sf_dir), form="by_target", targets=targets).select(F.round("leep", 8).alias("leep"))
