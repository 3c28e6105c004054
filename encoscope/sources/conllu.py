"""CoNLL-U treebanks: reading files and directories, parsing, writing.

Parsing is column work on the text of one sentence, so it runs inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.lookups import lookup_join
from encoscope.functions.text import let
from encoscope.sources.conll import number_records, read_records

# The ten fields of a word line, in file order.
FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")

# Shapes of a comment with metadata.
META_EQUALS = r"(?dU)^# ?(.+?) ?= ?(.+)"
META_BLANK = r"(?dU)^# ?([^\s]+?)\s([^\s]+)$"

# A dictionary text in which some key comes twice.
REPEATED_KEY = r"(?:^|\|)([^=|]*)(?:=[^|]*)?(?:\|.*)?\|\1(?:=|\||$)"

# Fixed value: name of a treebank folder.
TREEBANK_FOLDER = r"^UD_(.+)-(.+)"

# Fixed value: start of the key-value block of a treebank README.
README_BLOCK = r"(?s)[-=]+ Machine[-\s]readable metadata(.+)"


def _last_wins(entries: Column) -> Column:
    """Key-value structs to a map in key order; a repeated key keeps its last value."""
    placed = F.array_sort(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("place"), e["value"].alias("value")))
    )

    def distinct(rows: Column) -> Column:
        nothing = F.lit(None).cast("struct<key:string,place:int,value:string>")
        newest = F.zip_with(
            rows, F.concat(F.array(nothing), rows), lambda a, b: F.when(b.isNull() | (a["key"] != b["key"]), a)
        )
        kept = F.filter(newest, lambda a: a.isNotNull())
        return F.map_from_entries(F.transform(kept, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value"))))

    return let(placed, distinct)


def parse_pairs(text: Column) -> Column:
    """``a=1|b=2`` to a map; items without ``=`` are left out, values may hold ``=``.

    The built-in parser refuses repeated keys, so only texts that have some go the longer way.
    """
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    usual = F.map_filter(F.str_to_map(text, F.lit(r"\|"), F.lit("=")), lambda k, v: v.isNotNull())
    items = F.filter(F.split(text, r"\|", -1), lambda s: F.instr(s, "=") > 0)
    pairs = F.transform(
        items,
        lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.substr(s, F.instr(s, "=") + 1).alias("value")),
    )
    return F.when(text.isNull(), nothing).when(text.rlike(REPEATED_KEY), _last_wins(pairs)).otherwise(usual)


# Fields that hold dictionaries.
MAP_FIELDS = ("feats", "misc")


def _word(f: Column, maps: bool) -> Column:
    raw = {name: F.get(f, F.lit(k)) for k, name in enumerate(FIELDS)}
    value = {name: F.nullif(raw[name], F.lit("_")) for name in FIELDS}
    kind = F.when(F.instr(raw["id"], "-") > 0, "range").when(F.instr(raw["id"], ".") > 0, "empty").otherwise("word")
    dictionaries = {name: parse_pairs(value[name]) for name in MAP_FIELDS} if maps else {}
    parts = [
        raw["id"].alias("id"),
        kind.alias("kind"),
        F.substring_index(F.substring_index(raw["id"], "-", 1), ".", 1).try_cast("int").alias("start"),
        F.substring_index(F.substring_index(raw["id"], "-", -1), ".", 1).try_cast("int").alias("end"),
        raw["form"].alias("form"),
        F.when(raw["form"] == "_", "_").otherwise(value["lemma"]).alias("lemma"),
        value["upos"].alias("upos"),
        value["xpos"].alias("xpos"),
        value["head"].try_cast("int").alias("head"),
        value["deprel"].alias("deprel"),
        value["deps"].alias("deps"),
    ]
    return F.struct(*parts, *[column.alias(name) for name, column in dictionaries.items()])


# A word line that parses: ten fields, an id of a known shape, a number or nothing as head.
WORD_LINE = r"^(?:\d+|\d+-\d+|\d+\.\d+)\t(?:[^\t]*\t){5}(?:_|[+-]?\d+)(?:\t[^\t]*){3}$"


def parse_sentences(records: DataFrame, record: str = "record", maps: bool = True) -> DataFrame:
    """Add ``comments``, ``words``, and ``corrupt`` (the record text where it does not parse).

    Each word carries ``token``, the id of the surface token it belongs to, and ``first``, true for the
    word that gives the token its form: a range covers the words in it, an empty node belongs to the
    word it follows. Without ``maps`` the dictionaries of words (``feats``, ``misc``) are left out, which
    saves most of the parsing where only forms, tags and heads are wanted.
    """
    fields = [n for n in FIELDS[1:] if maps or n not in MAP_FIELDS]
    lines = F.filter(F.transform(F.split(record, r"\r?\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    out = records.withColumn("_lines", lines)
    out = out.withColumn("comments", F.filter("_lines", lambda x: F.startswith(x, F.lit("#"))))
    out = out.withColumn("_words", F.filter("_lines", lambda x: ~F.startswith(x, F.lit("#"))))
    out = out.withColumn("_ok", ~F.exists("_words", lambda x: ~x.rlike(WORD_LINE)))
    nothing = F.array().cast("array<string>")
    usable = F.when(F.col("_ok"), F.col("_words")).otherwise(nothing)
    out = out.withColumn("_plain", F.transform(usable, lambda x: let(F.split(x, "\t", -1), lambda f: _word(f, maps))))

    def token_of(w: Column, ranges: Column) -> Column:
        covering = F.filter(ranges, lambda r: (r["start"] <= w["start"]) & (w["start"] <= r["end"]))
        return F.coalesce(F.get(covering, F.lit(0))["start"], w["start"])

    ranges = F.filter("_plain", lambda w: w["kind"] == "range")
    out = out.withColumn("_tokens", let(ranges, lambda r: F.transform("_plain", lambda w: token_of(w, r))))
    before = F.concat(F.array(F.lit(-1)), F.slice("_tokens", 1, F.greatest(F.size("_tokens") - 1, F.lit(0))))
    marks = F.arrays_zip(F.col("_tokens").alias("token"), F.slice(before, 1, F.size("_tokens")).alias("before"))
    words = F.zip_with(
        "_plain",
        marks,
        lambda w, m: F.struct(
            *[w[n].alias(n) for n in ("id", "kind", "start", "end", *fields)],
            m["token"].alias("token"),
            (m["token"] != m["before"]).alias("first"),
        ),
    )
    return (
        out.withColumn("words", words)
        .withColumn("corrupt", F.when(~F.col("_ok"), F.col(record)))
        .drop("_lines", "_words", "_ok", "_plain", "_tokens")
    )


def parse_metadata(comments: Column) -> Column:
    """Comments to a map of metadata: ``# key = value``, else ``# key value``; the last one wins."""

    def entry(c: Column) -> Column:
        equals = c.rlike(META_EQUALS)
        key = F.when(equals, F.regexp_extract(c, META_EQUALS, 1)).otherwise(F.regexp_extract(c, META_BLANK, 1))
        value = F.when(equals, F.regexp_extract(c, META_EQUALS, 2)).otherwise(F.regexp_extract(c, META_BLANK, 2))
        return F.struct(key.alias("key"), value.alias("value"))

    known = F.filter(comments, lambda c: c.rlike(META_EQUALS) | c.rlike(META_BLANK))
    return _last_wins(F.transform(known, entry))


def unknown_comments(comments: Column) -> Column:
    """Comments that hold no metadata, without their mark."""
    other = F.filter(comments, lambda c: ~(c.rlike(META_EQUALS) | c.rlike(META_BLANK)))
    return F.transform(other, lambda c: F.trim(F.substr(c, F.lit(2))))


def read_conllu(spark: SparkSession, path: str, glob: str | None = "*.conllu", line_sep: str | None = None) -> DataFrame:
    """Sentences of CoNLL-U files: ``(file, sent, idx, comments, words)``.

    Sentences that do not parse are skipped and take no number; ``rejected`` lists them.
    """
    parsed = parse_sentences(read_records(spark, path, glob, line_sep))
    return number_records(parsed.where("corrupt IS NULL").drop("record", "corrupt"))


def rejected(spark: SparkSession, path: str, glob: str | None = "*.conllu", line_sep: str | None = None) -> DataFrame:
    """Sentences that do not parse, with their file."""
    parsed = parse_sentences(read_records(spark, path, glob, line_sep))
    return parsed.where("corrupt IS NOT NULL").select("file", "corrupt")


def treebank_name(file: Column) -> Column:
    """``en-ewt-dev`` of ``.../en_ewt-ud-dev.conllu``."""
    base = F.regexp_replace(F.substring_index(file, "/", -1), r"\.conllu$", "")
    return F.translate(F.replace(base, F.lit("-ud-"), F.lit("-")), "_", "-")


def directory_meta(file: Column) -> Column:
    """Language and treebank name of a ``UD_Language-Name`` folder; NULL for other folders."""
    folder = F.element_at(F.split(file, "/", -1), -2)
    language = F.replace(F.regexp_extract(folder, TREEBANK_FOLDER, 1), F.lit("_"), F.lit(" "))
    name = F.regexp_extract(folder, TREEBANK_FOLDER, 2)
    return F.when(name != "", F.struct(language.alias("language"), name.alias("treebank")))


def parse_readme(text: Column) -> Column:
    """The ``key: value`` lines of a README's machine-readable block, as a map."""
    block = F.regexp_extract(text, README_BLOCK, 1)
    lines = F.transform(F.split(block, r"\r?\n", -1), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: ~F.startswith(x, F.lit("===")) & (F.size(F.split(x, ": ", -1)) == 2))
    return _last_wins(
        F.transform(
            kept,
            lambda x: F.struct(F.get(F.split(x, ": ", -1), F.lit(0)).alias("key"), F.get(F.split(x, ": ", -1), F.lit(1)).alias("value")),
        )
    )


def read_directory(
    spark: SparkSession, path: str, line_sep: str | None = None, glob: str = "*.conllu", readme: str = "README*"
) -> tuple[DataFrame, DataFrame]:
    """A folder of ``UD_Language-Name`` folders: sentences and the metadata of each file.

    Metadata (``file, language, treebank, meta``) come from folder names and READMEs. ``meta`` holds
    ``Language`` and ``Treebank`` of the folder name and the keys of the README, which win; READMEs are
    a few kilobytes per treebank.
    """
    sentences = read_conllu(spark, f"{path}/UD_*-*", glob, line_sep)
    readmes = spark.read.option("pathGlobFilter", readme).text(f"{path}/UD_*-*", wholetext=True)
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    meta = readmes.select(folder(F.col("_metadata.file_path")).alias("folder"), parse_readme(F.col("value")).alias("meta"))
    # the listing reads no file content
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{path}/UD_*-*")
    files = listed.select(F.col("_metadata.file_path").alias("file")).withColumn("folder", folder(F.col("file")))
    named = files.withColumn("_d", directory_meta(F.col("file"))).where("_d IS NOT NULL")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.create_map(F.lit("Language"), F.col("_d.language"), F.lit("Treebank"), F.col("_d.treebank"))
    joined = named.join(meta, "folder", "left").withColumn("_given", F.coalesce("meta", empty))
    rest = F.map_filter(own, lambda k, v: ~F.map_contains_key("_given", k))
    joined = joined.select("file", F.map_concat("_given", rest).alias("meta"))
    return sentences, joined.select(
        "file", F.element_at("meta", "Language").alias("language"), F.element_at("meta", "Treebank").alias("treebank"), "meta"
    )


def with_meta(sentences: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach the metadata of its file to every sentence."""
    return lookup_join(sentences, meta, "file", "left", spread_by=["idx"])


def _pairs_text(m: Column) -> Column:
    entries = F.array_sort(F.map_entries(m))
    return F.nullif(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"), F.lit(""))


def render_word(w: Column) -> Column:
    """One word line; missing values become ``_``, dictionaries are written in key order."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("_"))
    return F.concat_ws(
        "\t",
        w["id"],
        *[blank(w[n]) for n in ("form", "lemma", "upos", "xpos")],
        blank(_pairs_text(w["feats"])),
        *[blank(w[n]) for n in ("head", "deprel", "deps")],
        blank(_pairs_text(w["misc"])),
    )


def resolved_words(words: Column) -> Column:
    """Words that remain once multiword tokens give way to their parts and empty nodes are left out."""
    return F.filter(words, lambda w: (w["kind"] == "word") & w["head"].isNotNull())


def render_sentence(words: Column, comments: Column | None = None, resolve: bool = False) -> Column:
    """The text of one sentence, without the blank line after it."""
    kept = resolved_words(words) if resolve else words
    lines = F.transform(kept, render_word)
    return F.array_join(lines if comments is None else F.concat(comments, lines), "\n")


def write_conllu(
    df: DataFrame, path: str, comments: bool = True, resolve: bool = False, mode: str = "errorifexists"
) -> None:
    text = render_sentence(F.col("words"), F.col("comments") if comments else None, resolve)
    df.select(text.alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)
