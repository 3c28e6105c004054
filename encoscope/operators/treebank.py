"""Treebank operators on parsed sentences: views of words, filters, groups, statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.functions.lookups import lookup_join
from encoscope.functions.ordered import carry_forward, dense_index, running_count
from encoscope.functions.text import clean_form, strip_subtype
from encoscope.operators.labels import map_label_arrays
from encoscope.sources.conll import file_starts
from encoscope.sources.conllu import META_BLANK, META_EQUALS, parse_metadata

UNKNOWN_GROUP = "unknown"

# The universal dependency relations without subtypes.
UNIVERSAL_RELATIONS = (
    "acl", "advcl", "advmod", "amod", "appos", "aux", "case", "cc",
    "ccomp", "clf", "compound", "conj", "cop", "csubj", "dep", "det",
    "discourse", "dislocated", "expl", "fixed", "flat", "goeswith", "iobj", "list",
    "mark", "nmod", "nsubj", "nummod", "obj", "obl", "orphan", "parataxis",
    "punct", "reparandum", "root", "vocative", "xcomp",
)


def dependency_words(words: Column) -> Column:
    """Words with a dependency head; ranges and empty nodes have none."""
    return F.filter(words, lambda w: w["head"].isNotNull())


def surface_words(words: Column) -> Column:
    """The first word of every surface token."""
    return F.filter(words, lambda w: w["first"])


def word_forms(words: Column) -> Column:
    return F.transform(dependency_words(words), lambda w: clean_form(w["form"]))


def token_forms(words: Column) -> Column:
    return F.transform(surface_words(words), lambda w: clean_form(w["form"]))


def heads(words: Column, offset: int = -1) -> Column:
    return F.transform(dependency_words(words), lambda w: w["head"] + offset)


def relations(words: Column, include_subtypes: bool = True) -> Column:
    return F.transform(
        dependency_words(words), lambda w: w["deprel"] if include_subtypes else strip_subtype(w["deprel"])
    )


def part_of_speech(words: Column) -> Column:
    return F.transform(dependency_words(words), lambda w: w["upos"])


def plain_comments(comments: Column) -> Column:
    return F.transform(comments, lambda c: F.trim(F.substr(c, F.lit(2))))


def sentence_text(words: Column) -> Column:
    """Forms with a blank after each, unless ``SpaceAfter=No``."""
    blank = lambda w: F.when(F.try_element_at(w["misc"], F.lit("SpaceAfter")) == "No", "").otherwise(" ")
    return F.array_join(F.transform(surface_words(words), lambda w: F.concat(clean_form(w["form"]), blank(w))), "")


def relation_set(df: DataFrame, include_subtypes: bool = False) -> DataFrame:
    """Distinct relations over all sentences (each sentence gives its own distinct ones first)."""
    own = F.array_distinct(relations(F.col("words"), include_subtypes))
    return df.select(F.explode_outer(own).alias("relation")).where("relation IS NOT NULL").distinct()


def domains(genre: Column) -> Column:
    """Sorted domains of a treebank's Genre entry."""
    return F.array_sort(F.array_distinct(F.split(F.coalesce(genre, F.lit("")), " ", -1)))


def domain_set(meta: DataFrame) -> DataFrame:
    return meta.select(F.explode(domains(F.try_element_at("meta", F.lit("Genre")))).alias("domain")).distinct()


def unknown_relations(found: DataFrame, known: Sequence[str] = tuple(UNIVERSAL_RELATIONS)) -> DataFrame:
    """Relations outside an inventory; give one with subtypes to check those as well."""
    typed = any(":" in r for r in known)
    name = F.col("relation") if typed else strip_subtype(F.col("relation"))
    return found.where(~name.isin(*known))


def corpus_index(df: DataFrame, order: str, file: str = "file", out: str = "idx") -> DataFrame:
    """Position of each sentence in its file (``sent``) and in the corpus, files in name order.

    ``order`` is a unique integer column that gives the order inside a file.
    """
    numbered = dense_index(df, order, [file], out="sent")
    sizes = df.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("size"))
    starts = file_starts(sizes).withColumnRenamed("file", file)
    joined = lookup_join(numbered, starts, file, "inner", spread_by=[order])
    return joined.withColumn(out, (F.col("sent") + F.col("file_start")).cast("long")).drop("file_start")


def statistics(df: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Sentences, tokens and words per treebank file."""
    rows = df.select(
        *keys, F.size(surface_words(F.col("words"))).alias("_t"), F.size(dependency_words(F.col("words"))).alias("_w")
    )
    return rows.groupBy(*keys).agg(
        F.count("*").alias("sentences"), F.sum("_t").alias("tokens"), F.sum("_w").alias("words")
    )


def metadata_keys(df: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Distinct metadata keys of each file, one row per key; ``unknown`` for other comments."""
    named = F.concat(
        F.map_keys(parse_metadata(F.col("comments"))),
        F.when(F.exists("comments", _unknown), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>")),
    )
    return df.select(*keys, F.explode_outer(named).alias("key")).where("key IS NOT NULL").distinct()


def _unknown(c: Column) -> Column:
    return ~(c.rlike(META_EQUALS) | c.rlike(META_BLANK))


# --- filters: boolean columns over a sentence and its metadata ---


def any_of(*filters: Column) -> Column:
    return reduce(Column.__or__, filters, F.lit(False))


def all_of(*filters: Column) -> Column:
    return reduce(Column.__and__, filters, F.lit(True))


def metadata_filter(field: str, values: Sequence[str], mode: str = "include", meta: str = "meta") -> Column:
    """Treebanks whose metadata field is (not) one of ``values``."""
    hit = F.coalesce(F.try_element_at(meta, F.lit(field)).isin(*values), F.lit(False))
    return _mode(mode, include=hit, exclude=~hit)


def domain_filter(wanted: Sequence[str], mode: str = "include", genre: Column | None = None, meta: str = "meta") -> Column:
    """Treebanks whose domains meet, avoid or equal the wanted ones."""
    have = domains(F.try_element_at(meta, F.lit("Genre")) if genre is None else genre)
    want = F.array(*[F.lit(d) for d in sorted(set(wanted))])
    hit = F.arrays_overlap(have, want)
    return _mode(mode, include=hit, exclude=~hit, exact=have == want)


def domain_of_distribution(names: Sequence[str], distribution: Column) -> Column:
    """Most probable domain of a sentence, the first one on ties."""
    known = F.coalesce(distribution, F.array().cast("array<double>"))
    best = F.coalesce(F.array_position(known, F.array_max(known)).cast("int"), F.lit(0))
    return F.get(F.array(*[F.lit(n) for n in names]), best - 1)


def _mode(mode: str, **choices: Column) -> Column:
    if mode not in choices:
        raise ValueError(f"unknown mode {mode!r}; expected one of {sorted(choices)}")
    return choices[mode]


def with_kept(df: DataFrame, condition: Column) -> DataFrame:
    """Mark sentences that pass; the others keep their corpus index."""
    return df.withColumn("kept", F.coalesce(condition, F.lit(False)))


def index_filter(df: DataFrame, indices: DataFrame, idx: str = "idx") -> DataFrame:
    """Mark sentences whose corpus index is listed in ``indices``."""
    listed = indices.select(F.col(indices.columns[0]).alias(idx)).distinct().withColumn("_hit", F.lit(True))
    return df.join(listed, idx, "left").withColumn("kept", F.coalesce("_hit", F.lit(False))).drop("_hit")


def distribution_filter(
    df: DataFrame, distribution: DataFrame, names: Sequence[str], wanted: Sequence[str], mode: str = "include", idx: str = "idx"
) -> DataFrame:
    """Mark sentences by the most probable domain of a distribution ``(idx, dist)``."""
    joined = df.join(distribution.select(idx, "dist"), idx, "left")
    picked = domain_of_distribution(names, F.col("dist"))
    return with_kept(joined, domain_filter(wanted, mode, genre=picked)).drop("dist")


# --- groups: sentence order within a file (any unique integer column), carried forward in blocks ---


def group_by_comment(df: DataFrame, pattern: str, file: str = "file", sent: str = "sent") -> DataFrame:
    """``group``: ``group-n`` from each sentence with a matching comment on, ``unknown`` before."""
    hit = F.exists(plain_comments(F.col("comments")), lambda c: c.rlike(f"^(?:{pattern})"))
    counted = running_count(df, hit, sent, [file], out="_n")
    name = F.concat(F.lit("group-"), (F.col("_n") - 1).cast("string"))
    return counted.withColumn("group", F.when(F.col("_n") > 0, name).otherwise(UNKNOWN_GROUP)).drop("_n")


def group_by_metadata(
    df: DataFrame, key: str, value_regex: str = "", file: str = "file", sent: str = "sent"
) -> DataFrame:
    """``group``: the last seen value of a metadata key, ``unknown`` before the first one.

    With ``value_regex`` the group is made of its named groups ``val*`` in name order, ``unknown`` for
    values that do not match.
    """
    value = F.try_element_at(parse_metadata(F.col("comments")), F.lit(key))
    carried = carry_forward(df, value, sent, [file], out="group")
    group = group_of_value(F.col("group"), value_regex) if value_regex else F.col("group")
    return carried.withColumn("group", F.coalesce(group, F.lit(UNKNOWN_GROUP)))


def group_of_value(value: Column, value_regex: str) -> Column:
    """The named groups ``val*`` of a metadata value in name order; ``unknown`` if it does not match."""
    java = "^(?:" + value_regex.replace("(?P<", "(?<") + ")"
    places = re.compile(value_regex).groupindex
    parts = [F.regexp_extract(value, java, places[n]) for n in sorted(places) if n.startswith("val")]
    return F.when(value.isNotNull(), F.when(value.rlike(java), F.concat(*parts)).otherwise(UNKNOWN_GROUP))


def sentences_by(df: DataFrame, key: str) -> DataFrame:
    """Sentence counts and corpus range per language, treebank or file."""
    return df.groupBy(key).agg(
        F.count("*").alias("sentences"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


def runs_by(df: DataFrame, key: str, idx: str = "idx") -> DataFrame:
    """Contiguous runs of equal ``key`` in corpus order, as ``run`` numbers from 0.

    The key depends on the file, so runs are found on the few file rows and joined back.
    """
    files = df.groupBy("file", key).agg(F.min(idx).alias("_at"))
    order = Window.orderBy("_at")
    changed = F.when(F.lag(key).over(order).eqNullSafe(F.col(key)), 0).otherwise(1)
    marked = files.withColumn("_changed", changed)
    numbered = marked.withColumn("run", (F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    return lookup_join(df, numbered.select("file", "run"), "file", "left", spread_by=[idx])


def relation_dataset(df: DataFrame, index: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Word forms and relation ids of each sentence as ``(text, label)`` strings."""
    rows = df.select(
        *row_id, word_forms(F.col("words")).alias("tokens"), relations(F.col("words"), include_subtypes=False).alias("_rel")
    )
    mapped = map_label_arrays(rows, "_rel", index, "label", "label_id", row_id, "_ids")
    return mapped.select(
        *row_id,
        F.array_join("tokens", " ").alias("text"),
        F.array_join(F.col("_ids").cast("array<string>"), " ").alias("label"),
    )
