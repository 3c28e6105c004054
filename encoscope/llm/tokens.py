"""Token ids of whole texts with the ``tokenizers`` library, through a cache of word chunks.

A byte-level tokenizer splits a text into pieces before it merges. Some cuts are certain: one white
space character between two others starts a piece. Texts are cut there, and the ids of a chunk are asked
for once in each worker. Chunks of letters and punctuation go straight to the library's model; all other
chunks go through its whole pipeline.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Two white space characters in a row, or one at the end: not every cut is certain there.
UNEVEN = re.compile(f"[{SPACES}](?:[{SPACES}]|\\Z)")
CHUNK = re.compile(f"[{SPACES}]?[^{SPACES}]+|[{SPACES}]+?(?=[{SPACES}][^{SPACES}])|[{SPACES}]+")
# Letters of Basic Latin and Latin-1, then punctuation without the apostrophe: two pieces at most.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")
CACHE = 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def chunks(text: str) -> list[str]:
    """A text cut at certain places; joined, the chunks are the text."""
    return CHUNK.findall(text)


class Memo(dict):
    """A cache of two generations of ``limit`` entries: what was not asked for in a whole generation goes."""

    def __init__(self, make, prefix: str = "", limit: int = CACHE):
        super().__init__()
        self.make, self.prefix, self.limit, self.older = make, prefix, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            # a chunk that begins with a line break has no space in front
            value = self.make(key if key[:1] == "\n" else self.prefix + key)
        self[key] = value
        return value


class ChunkCache:
    """Values of the chunks of a text, where ``make(chunk)`` gives the value of one chunk.

    ``joined`` are the tokenizer's own strings that may reach over a cut; texts that hold one are not cut.
    """

    def __init__(self, make, joined: tuple[str, ...], white_matters: bool):
        self.bare, self.spaced = Memo(make), Memo(make, " ")
        self.make, self.white_matters = make, white_matters
        self.joined = re.compile("|".join(map(re.escape, joined))) if joined else None

    def values(self, text: str) -> Iterator:
        if not text:
            return iter(())
        if self.joined is not None and self.joined.search(text):
            return iter((self.make(text),))
        if not self.white_matters:
            return map(self.bare.__getitem__, text.replace("\n", " ").split(" "))
        if UNEVEN.search(text):
            return map(self.bare.__getitem__, chunks(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return iter((self.bare[first], *map(self.spaced.__getitem__, rest)))


class Encoder:
    """Ids of texts as arrays of ``dtype``, as ``Tokenizer.encode`` gives them without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        # pieces of plain chunks may go to the model only in the two known pipelines
        split = parts["pre_tokenizer"] or {}
        self.lower = split.get("type") == "Sequence"
        self.known = parts["model"]["type"] == "BPE" and (self.lower or (split.get("type") == "ByteLevel" and not split.get("add_prefix_space")))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.code = "H" if self.dtype == "<u2" else "I"
        # words and marks come in many combinations, so their ids are kept apart from those of chunks
        self.words, self.marks = Memo(self._piece), Memo(self._piece, limit=10_000)
        self.cache = ChunkCache(self._chunk, tuple(t["content"] for t in parts["added_tokens"]), not self.lower)

    def _piece(self, piece: str) -> bytes:
        letters = piece.replace(" ", self.letters[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        lead = chunk[:1] if chunk[:1] == " " else ""
        plain = PLAIN.fullmatch(chunk, len(lead)) if self.known else None
        if plain is None:
            return array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        word, marks = plain.groups()
        if self.lower:
            lead, word = "", word.lower()
        if not word:  # a blank in front goes with the marks then
            return self.marks[lead + marks] if lead or marks else b""
        return self.words[lead + word] + self.marks[marks] if marks else self.words[lead + word]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.cache.values(text or "")), dtype=self.dtype)

    def learn(self, memo: Memo, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks through ``memo``; those of plain new ones are put together here."""
        older, prefix, known, words, marks, tokenize = memo.older, memo.prefix, self.known, self.words, self.marks, self.model.tokenize
        plain, code, table, lower = PLAIN.fullmatch, self.code, self.letters, self.lower
        blank = "" if lower else table[32] if prefix else ""
        out = list(map(memo.get, chunks))
        for place, found in enumerate(out):
            if found is not None:
                continue
            chunk = chunks[place]
            found = older.get(chunk)
            cut = plain(chunk) if found is None and known and chunk else None
            if cut is not None and cut[1]:
                word, mark = cut.groups()
                word = word.lower() if lower else word
                key = prefix + word if not lower else word
                found = words.get(key)
                if found is None:
                    letters = word if word.isascii() else word.encode().decode("latin-1").translate(table)
                    found = array(code, [t.id for t in tokenize(blank + letters)]).tobytes()
                    if len(words) < words.limit:
                        words[key] = found
                if mark:
                    found += marks[mark]
            if found is None:
                out[place] = memo[chunk]
                continue
            if len(memo) >= memo.limit:
                memo.older = dict(memo)
                memo.clear()
            out[place] = memo[chunk] = found
        return out

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column. Its distinct chunks are looked up once, and ids are gathered by chunk."""
        cache, listed = self.cache, texts.to_pylist()
        even = np.array([bool(t) and not UNEVEN.search(t) and not (cache.joined and cache.joined.search(t)) for t in listed], bool)
        out = [None if e else self.encode(t) for t, e in zip(listed, even)]
        if not even.any():
            return out
        mark = " \n" if cache.white_matters else " "
        parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(even)), "\n", mark), " ")
        flat, begin = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        coded = flat.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        if cache.white_matters:  # the first chunk of a text has no blank in front
            values = self.learn(cache.spaced, words) + list(map(cache.bare.__getitem__, flat.take(pa.array(begin)).to_pylist()))
            codes[begin] = len(words) + np.arange(len(begin))
        else:
            values = self.learn(cache.bare, words)
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
        first = np.cumsum(sizes) - sizes
        many = sizes[codes]
        ends = np.cumsum(many)
        ids = np.frombuffer(b"".join(values), self.dtype)[np.repeat(first[codes] - (ends - many), many) + np.arange(ends[-1])]
        stops = np.append(begin[1:], len(codes))
        cuts = np.concatenate([[0], ends])[stops]
        for place, part in zip(np.flatnonzero(even).tolist(), np.split(ids, cuts[:-1])):
            out[place] = part
        return out
