"""Token counts of whole texts with a whole-token shortcut.

The tokenizer file's pre-tokens never cross white space, so a text's tokens are
the concatenation of its white-space separated words' tokens.  Offline, every
vocabulary string is encoded alone; those that give exactly their own id are the
whole tokens.  A word is split into pre-tokens; a whole token counts directly,
and only the rest goes through the library's merges.  Words are looked up in a
bounded cache first.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings inside a text are handled by the library (its default); words with
characters outside ``PLAIN`` are encoded by the library as they are, so that
Unicode versions of Python and of the library cannot differ; repeated rows are
counted one by one.
"""

from __future__ import annotations

import re
import unicodedata
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_batches

# fixed values: the pre-token pattern of the tokenizer file
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: characters on which Python and the library agree in case, class and composition (tested)
PLAIN = re.compile("[!-~\xa1-ɏΑ-ΡΣ-Ωα-ωА-я‐-‧‰-⁞"
                   "₠-₹ぁ-ゔァ-ヺ一-龥]+")
#: a text of letters, digits, ASCII blanks and marks, where no comma or full stop follows a mark, may be
#: lower-cased as a whole and have these split off at word ends
SIMPLE = re.compile("(?:[0-9A-Za-z\t-\r \xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e\u0391-\u03a1\u03a3-\u03a9"
                    "\u03b1-\u03c9\u0410-\u044f]++|[!-/:-@\\[-`{-~\u2010-\u2027](?![.,]))*+")
#: the same for ASCII texts, byte by byte: c control, m mark, . full stop or comma, x anything else
ASCII_CLASS = bytes(ord("x") if chr(b).isalnum() or b in (9, 10, 11, 12, 13, 32) or b > 126 else ord("c") if b < 32 else
                    ord(".") if chr(b) in ".," else ord("m") for b in range(256))
#: the marks of simple texts
MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), *range(0x2010, 0x2028)]))
ODD_SPACE = re.compile("[\x1c-\x1f]")
CACHED_WORDS = 400_000
LONGEST_CACHED = 64
PART_CHARS = 12_000_000
END_ID = 2


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_letters() -> dict[int, str]:
    """The byte alphabet's own rule: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def whole_tokens(path: str) -> dict[str, int]:
    """The offline proof: strings that the library encodes alone as one token."""
    tok = load(path)
    to_byte = {c: b for b, c in byte_letters().items()}
    found = {}
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        stem = piece.removesuffix("</w>")
        if stem == piece or not all(c in to_byte for c in stem):
            continue
        try:
            found[bytes(to_byte[c] for c in stem).decode()] = i
        except UnicodeDecodeError:
            continue
    strings = list(found)
    alone = tok.encode_batch(strings, add_special_tokens=False)
    return {s: found[s] for s, e in zip(strings, alone, strict=True) if e.ids == [found[s]]}


def proof(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = whole_tokens(path)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())],
                                                 ["string", "id"])

    return run


def proved(spark: SparkSession, path: str):
    """The whole tokens as a broadcast dictionary (at most the vocabulary). One task proves them, so that
    the library and its caches never fill the driver."""
    rows = map_batches(spark.range(0, 1, 1, 1), proof(path), "string string, id int").toLocalIterator()
    return spark.sparkContext.broadcast({r["string"]: r["id"] for r in rows})


class Words(dict):
    """word -> made(ids of the word), filled on first sight; small enough for a Python worker."""

    def __init__(self, tok, whole: dict[str, int], made: Callable[[list[int]], object], kind: pa.DataType):
        super().__init__()
        self.tok, self.whole, self.made, self.kind, self.pre = tok, whole, made, kind, {}
        self.merge, self.letters = tok.model.tokenize, "".join(byte_letters()[b] for b in range(256))

    def spelt(self, p: str) -> str:
        """The UTF-8 bytes of ``p`` in the byte alphabet."""
        return charmap_decode(p.encode(), "strict", self.letters)[0]

    def merged(self, p: str) -> list[int]:
        """The ids of a pre-token that is no whole token, by the library's merges."""
        if (ids := self.pre.get(p)) is None:
            ids = [t.id for t in self.merge(self.spelt(p))]
            if len(p) <= LONGEST_CACHED:
                if len(self.pre) > CACHED_WORDS // 16:
                    self.pre.clear()
                self.pre[p] = ids
        return ids

    def ids(self, word: str) -> list[int]:
        if word.isalpha() and word.isascii():  # one pre-token, its own byte letters
            word = word.lower()
            return [one] if (one := self.whole.get(word)) is not None else [t.id for t in self.merge(word)]
        if "<|" in word or not PLAIN.fullmatch(word):
            return self.tok.encode(word, add_special_tokens=False).ids
        if not word.isascii():  # one sigma: the library lower-cases each character by itself
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        word = word.lower()
        out: list[int] = []
        for p in PRE_TOKEN.findall(word):
            if (one := self.whole.get(p)) is not None:
                out.append(one)
            else:
                out += self.merged(p)
        return out

    def __missing__(self, word: str):
        value = self.made(self.ids(word))
        if len(word) <= LONGEST_CACHED:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def letter_ids(self, word: str) -> list[int]:
        """The ids of lower-cased, composed letters: one pre-token."""
        if (one := self.whole.get(word)) is not None:
            return [one]
        return [t.id for t in self.merge(word if word.isascii() else self.spelt(word))]

    def simple_ids(self, word: str) -> list[int]:
        """The ids of a word of a simple, lower-cased text: letters, and marks after them, are a pre-token each."""
        if word.isalpha():
            return self.letter_ids(word)
        stem = word.rstrip(MARKS)
        if not stem.isalpha():
            return self.ids(word)
        marks = word[len(stem):]
        return self.letter_ids(stem) + (self.merged(marks) if (one := self.whole.get(marks)) is None else [one])

    def simple_values(self, words: list[str], times: np.ndarray) -> list:
        """The values of distinct words of simple texts, which stand ``times`` times there.  A word that stands
        there once is not kept: most such words never come back and would only fill the worker."""
        found = list(map(self.get, words))
        if len(self) > CACHED_WORDS:
            self.clear()
        made, ids, often = self.made, self.simple_ids, (times > 1).tolist()
        for i, v in enumerate(found):
            if v is None:
                word = words[i]
                found[i] = v = made(ids(word))
                if often[i] and len(word) <= LONGEST_CACHED:
                    self[word] = v
        return found

    def of_text(self, text: str) -> Iterable:
        """The words' values, in order; their ids are those of the whole text."""
        if ODD_SPACE.search(text):  # Python splits at these, the library does not
            return [self.made(self.tok.encode(text, add_special_tokens=False).ids)]
        return map(self.__getitem__, text.split())

    def of_texts(self, texts: list[str]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Parts of the texts, in order: the words' values and where each text's begin and end.

        Simple texts are split and their distinct words found by Arrow; only
        distinct words are looked up.
        """
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < PART_CHARS):
                size += len(texts[stop])
                stop += 1
            part = texts[at:stop]
            plain = [t.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ") if simple(t) else None for t in part]
            words = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
            flat = words.flatten().dictionary_encode()
            times = np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary))
            values = pa.array(self.simple_values(flat.dictionary.to_numpy(zero_copy_only=False).tolist(), times), self.kind)
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(words).to_pylist())])
            found = values.take(flat.indices)
            if None in plain:
                rows = [found[ends[i]:ends[i + 1]] if t is not None else pa.array(self.of_text(part[i]), self.kind)
                        for i, t in enumerate(plain)]
                ends = np.cumsum([0, *map(len, rows)])
                found = pa.concat_arrays(rows)
            yield found, ends
            at = stop


def simple(text: str) -> bool:
    if not text.isascii():
        return SIMPLE.fullmatch(text) is not None and "Σ" not in text and "<|" not in text
    classes = text.encode().translate(ASCII_CLASS)
    return b"m." not in classes and b".." not in classes and b"c" not in classes and "<|" not in text and "\x7f" not in text


def words_of(path: str, whole: dict[str, int], made: Callable[[list[int]], object], kind: pa.DataType) -> Words:
    """One cache for each worker process, tokenizer and kind of value."""
    return kept(("words", path, str(kind)), lambda: Words(load(path), whole, made, kind))


def counter(path: str, whole, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path, whole.value, len, pa.int64())
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n: list[int] = []
            for found, ends in words.of_texts(texts):
                sums = np.append(0, np.cumsum(found.to_numpy()))
                n += (sums[ends[1:]] - sums[ends[:-1]]).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, n_tokens, over_limit. No shuffle."""
    whole = proved(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    out = map_batches(rows, counter(path, whole, limit),
                          f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", caches=True)
    return out.withColumnRenamed("id", key)
