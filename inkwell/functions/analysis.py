"""Text analysis as Spark expressions: folding, words, stop words, terms."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .lexicon import STOP_WORDS, WORD
from .stemmer import stem


def fold(text: str) -> str:
    """Compatibility decomposition without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@cache
def _folding() -> tuple[str, str, dict[str, str], str]:
    """Characters to translate, to what (marks beyond its length go), characters that become several, and a pattern for the latter.

    Only characters that fold to something with ASCII matter, since words are ASCII.  Symbols of several characters from U+2200 on
    (circled and squared ones) are left alone, which is the one difference from ``fold``.
    """
    one, gone, several = {}, [], {}
    for c in map(chr, range(0x80, min(sys.maxunicode + 1, 0x20000))):
        if unicodedata.combining(c):
            gone.append(c)
            continue
        to = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if to != c and any(x < "\x80" for x in to):
            if len(to) == 1:
                one[c] = to
            elif "\xa0" <= c < "\u2200" and len(to) < 4 or "\ufb00" <= c <= "\ufb06":
                several[c] = to
    return "".join([*one, *gone]), "".join(one.values()), several, "[" + "".join(several) + "]"


def folded(text: Column) -> Column:
    """``fold`` as an expression.  Characters that become several are replaced only in texts that have any."""
    source, target, several, pattern = _folding()
    parts = F.map_from_arrays(*(F.split(F.lit("\t".join(x)), "\t") for x in (several, several.values())))
    wide = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(parts[c], c)), "")
    return F.lower(F.translate(F.when(text.rlike(pattern), wide).otherwise(text), source, target))


@cache
def _folds() -> dict[str, str]:
    """What ``folded`` makes of single characters, without those it leaves alone."""
    source, target, several, _ = _folding()
    return dict(zip(source, target, strict=False)) | dict.fromkeys(source[len(target) :], "") | several


def folded_text(text: str) -> str:
    """What ``folded`` makes of one text."""
    if not text.isascii():
        to = _folds()
        text = re.sub("[^\x00-\x7f]", lambda m: to.get(m[0], m[0]), text)
    return text.lower()


def stripped(text: Column) -> Column:
    """Without white space at either end; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))


def raw_words(text: Column) -> Column:
    """All words, stop words too, in order."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return word.isin(*sorted(STOP_WORDS | {w.replace("'", "’") for w in STOP_WORDS}))


def is_indexed(word: Column) -> Column:
    """Words that get into the index: no stop words, and single characters only if digits."""
    return ((F.length(word) > 1) | word.between("0", "9")) & ~is_stop_word(word)


SKIPPED = frozenset(STOP_WORDS | {w.replace("'", "’") for w in STOP_WORDS} | set("abcdefghijklmnopqrstuvwxyz"))
"""The words that ``is_indexed`` tells to leave out."""


# --- texts in tasks ---------------------------------------------------------------------------------------------------

PART_BYTES = 1 << 22
"""Bytes of text that a task analyses at once; a longer text is one piece."""


def in_parts(batches: Iterator[pa.RecordBatch], *texts: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts, in the columns of these numbers, have about PART_BYTES."""
    for b in batches:
        size = sum(pc.fill_null(pc.binary_length(b.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in texts)
        part = (np.cumsum(size) - size) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False) if y > x)


def numbered_words(texts: list[list[str]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each word of texts, the distinct words by number, and where each text's words begin, in order."""
    words = pa.array([w for found in texts for w in found], pa.string()).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.cumsum([0, *map(len, texts)])


def folded_texts(column: pa.Array) -> list[str]:
    return [folded_text(t) if t else "" for t in column.to_pylist()]


def words_in(column: pa.Array) -> list[list[str]]:
    """All words of each text, stop words too, in order."""
    return list(map(re.compile(WORD).findall, folded_texts(column)))


def count_indexed(column: pa.Array) -> list[int]:
    """How many words of each text get into the index."""
    find, skipped = re.compile(WORD).findall, SKIPPED.__contains__
    return [len(found) - sum(map(skipped, found)) for found in (find(folded_text(t)) if t else () for t in column.to_pylist())]


@F.arrow_udf(IntegerType())
def n_indexed(column: pa.Array) -> pa.Array:
    """``count_indexed`` as an expression."""
    return pa.array(count_indexed(column), pa.int32())


STEMS = 500_000
"""Words that a task remembers at most before it starts afresh."""


_STEMMED: dict[str, str] = {}


def stems_of(words: list[str]) -> list[str]:
    """Stems of words; a Python process remembers those it has met."""
    if len(_STEMMED) > STEMS:
        _STEMMED.clear()
    for w in words:
        if w not in _STEMMED:
            _STEMMED[w] = stem(w)
    return [_STEMMED[w] for w in words]


@F.pandas_udf(StringType())
def stem_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of words; a task remembers those it has met."""
    known: dict[str, str] = {}
    for words in parts:
        if len(known) > STEMS:
            known.clear()
        new = set(words.dropna().unique()) - known.keys()
        known.update((w, stem(w)) for w in new)
        yield words.map(known, na_action="ignore")


def with_terms(rows: DataFrame, surface: str = "surface", stemmed: bool = True) -> DataFrame:
    """Add ``term``.  Each distinct word is stemmed once and joined back; the words are dealt evenly, however few bytes they are."""
    if not stemmed:
        return rows.withColumn("term", F.col(surface))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stems = rows.select(surface).distinct().repartition(parts).withColumn("term", stem_words(surface))
    return rows.join(stems, surface)


class Token(NamedTuple):
    """A word kept for the index; start and end are in the original text."""

    surface: str
    term: str
    position: int
    start: int
    end: int


def tokens(text: str, stemmed: bool = True) -> list[Token]:
    """Indexed words of one short text such as a query.  Offsets are those of the original even where folding changes lengths."""
    at, out = [], []
    for k, c in enumerate(text):
        at += [k] * len(fold(c))
    at.append(len(text))
    for position, m in enumerate(re.finditer(WORD, "".join(map(fold, text)))):
        w = m.group()
        if w.replace("’", "'") not in STOP_WORDS and (len(w) > 1 or w.isdigit()):
            end = at[m.end() - 1] + 1
            while end < len(text) and unicodedata.combining(text[end]):
                end += 1
            out.append(Token(w, stem(w) if stemmed else w, position, at[m.start()], end))
    return out


def words_of(text: str) -> list[str]:
    """All words of one short text, stop words too."""
    return re.findall(WORD, fold(text))
