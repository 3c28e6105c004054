"""Column expressions over text and tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.split() counts as white space.
WHITESPACE = r"[\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# Characters dropped from word forms (the soft hyphen becomes a plain one).
SOFT_HYPHEN = "\u00ad"
DROPPED_CHARACTERS = "\u0092\u0097\U000fe4fa\ue402\ufeff\ufffd"
UNKNOWN_FORM = "[UNK]"

# Kinds of embedding source an encoder spec may name.
ENCODER_KINDS = ("fasttext", "glove", "transformer", "transformer+cls")

# Marker of a continued piece (WordPiece) and of a word start (byte-level BPE).
CONTINUATION_MARK = "##"
WORD_START_MARK = "\u0120"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` refers to it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_spaces(text: Column) -> Column:
    """Split on single spaces, keeping empty tokens."""
    return F.split(text, " ", -1)


def whitespace_tokens(text: Column) -> Column:
    """Split on runs of white space, without empty tokens."""
    return F.filter(F.split(text, WHITESPACE, -1), lambda t: t != "")


def int_labels(label: Column) -> Column:
    """Space-separated integers to an array; a non-integer is an error, as with ``int()``."""
    return F.transform(split_spaces(label), lambda x: x.cast("int"))


def tag_prefix(tag: Column) -> Column:
    """``B`` of ``B-LOC``; the whole tag where there is no hyphen."""
    return F.when(F.instr(tag, "-") > 0, F.substring_index(tag, "-", 1)).otherwise(tag)


def tag_type(tag: Column) -> Column:
    """``LOC`` of ``B-LOC`` (types may hold hyphens); empty where missing, or where it is ``0``."""
    kind = F.when(F.instr(tag, "-") > 0, F.substr(tag, F.instr(tag, "-") + 1))
    return F.when(kind.isNull() | (kind == "0"), F.lit("")).otherwise(kind)


def clean_form(form: Column, empty_as_unknown: bool = True) -> Column:
    """Sanitised word form."""
    plain = F.translate(
        F.coalesce(form, F.lit("")), SOFT_HYPHEN + DROPPED_CHARACTERS, "-"
    )
    if not empty_as_unknown:
        return plain
    return F.when(plain == "", F.lit(UNKNOWN_FORM)).otherwise(plain)


def strip_subtype(relation: Column) -> Column:
    return F.substring_index(relation, ":", 1)


def recombine_pieces(pieces: Column, family: Column) -> Column:
    """Subword strings back to words.

    ``bpe`` starts a word at each marked piece; any other family continues a word at ``##``.
    A unit separator stands between pieces, so blanks inside a piece survive.
    """
    glued = F.array_join(pieces, "\u001f")
    wordpiece = F.split(F.replace(glued, F.lit("\u001f" + CONTINUATION_MARK), F.lit("")), "\u001f", -1)
    flat = F.array_join(pieces, "")
    bpe = F.split(
        F.when(F.startswith(flat, F.lit(WORD_START_MARK)), F.substr(flat, F.lit(2))).otherwise(flat),
        WORD_START_MARK,
        -1,
    )
    words = F.when(family == "bpe", bpe).otherwise(wordpiece)
    return F.when(F.size(pieces) == 0, F.array().cast("array<string>")).otherwise(words)


def parse_encoder_spec(spec: Column) -> Column:
    """``kind:name`` to struct(kind, name); an unknown kind is an error."""
    kind = F.substring_index(spec, ":", 1)
    name = F.get(F.split(spec, ":", -1), F.lit(1))
    good = kind.isin(*ENCODER_KINDS) & name.isNotNull()
    return F.when(good, F.struct(kind.alias("kind"), name.alias("name"))).otherwise(
        F.raise_error(F.concat(F.lit("unknown embedding specification "), spec)).cast(
            "struct<kind:string,name:string>"
        )
    )
