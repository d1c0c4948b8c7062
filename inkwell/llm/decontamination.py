"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items, scanning each text once.

Normalised text is lower-cased words (letters, digits and non-ASCII characters) with one space around each.  An item's windows
are its runs of ``window`` consecutive words, or the whole item if it is shorter.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, carried, frugal, once_per_worker, row_of
from .wordscan import ALNUM_WORDS, Chunk, Hasher, chunks, words

WINDOW = 10
AUTOMATON_WORDS = 500_000
"""Benchmark words in one automaton at most, which then takes about 100 MB.  A larger benchmark is dealt into several, each a further
pass over the texts."""
HASHES = Hasher(0xBE4C)
DIGITS = 64
"""A word's number is written in so many different characters, with other ones for each place, so that matches are whole words."""
SEEDS = 1 << 14
"""Seeds that are extended at once."""


class Matcher:
    """One automaton over benchmark items whose words are numbered.

    Its patterns are the items' aligned blocks of ``size // 2`` words, and whole items of fewer than ``size``.  Each window of
    ``size`` words holds such a block, so every window is found where a block is: the match is extended on either side, word by
    word, and counts if it reaches ``size`` words.  Blocks take a tenth of the memory of all windows.
    """

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.size, self.block = size, size // 2
        self.names = sorted({i for i, _ in items})
        code = {i: k for k, i in enumerate(self.names)}
        hashes, rows, owner = [np.zeros(0, np.uint64)], [0], []
        for c in chunks(pa.array([t for _, t in items], pa.large_string())):
            w = words(c, ALNUM_WORDS)
            hashes.append(HASHES.words(w.data, w.starts, w.ends))
            rows += (w.rows[1:] + rows[-1]).tolist()
            owner += [code[items[k][0]] for k in range(c.first, c.last)]
        flat = np.concatenate(hashes)
        self.known = np.unique(flat)
        self.places = 1
        while DIGITS**self.places <= len(self.known):
            self.places += 1
        # items end to end, with unknown words on either side of each, which match nothing
        gap = size
        pad = np.arange(len(owner)) * gap + gap
        rows = np.array(rows, np.int64)
        n = np.diff(rows)
        self.item = np.full(len(flat) + gap * (len(owner) + 1), -1, np.int64)
        self.owner = np.full(len(self.item), -1, np.int64)
        at = np.arange(len(flat)) + np.repeat(pad, n)
        self.item[at], self.owner[at] = np.searchsorted(self.known, flat), np.repeat(np.array(owner, np.int64), n)
        first = rows[:-1] + pad
        patterns: dict[str, list[tuple[int, int]]] = {}
        for start, count in zip(first.tolist(), n.tolist(), strict=True):
            if 0 < count < size:
                blocks = [(start, count)]
            else:
                blocks = [(k, self.block) for k in range(start, start + count - self.block + 1, self.block)]
            for k, length in blocks:
                patterns.setdefault(self._written(self.item[k : k + length]), []).append((k, length if count < size else 0))
        self.automaton = ahocorasick.Automaton()
        self.found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k, (text, where) in enumerate(patterns.items()):
            self.automaton.add_word(text, k)
            self.found.append((len(text) // self.places, *np.array(where, np.int64).T))
        if patterns:
            self.automaton.make_automaton()

    def _written(self, numbers: np.ndarray) -> str:
        """Numbers as text, each of ``places`` characters; -1 is blank."""
        out = np.full((len(numbers), self.places), 32, np.uint32)
        good = numbers >= 0
        for p in range(self.places):
            out[good, p] = numbers[good] // DIGITS**p % DIGITS + 256 + DIGITS * p
        return out.tobytes().decode("utf-32-le")

    def scan(self, chunk: Chunk) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each row of the chunk: its number of words, the word ranges hit (merged, in order) and the items found."""
        w = words(chunk, ALNUM_WORDS)
        n = np.diff(w.rows)
        if not self.found or not len(w.starts):
            yield from ((k, [], set()) for k in n.tolist())
            return
        hashes = HASHES.words(w.data, w.starts, w.ends)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        number = np.where(self.known[at] == hashes, at, -1)
        # rows end to end with gaps of blanks, so that no match runs from one into the next
        gap = self.size
        shift = np.repeat(np.arange(len(n)) * gap + gap, n)
        text = np.full(len(number) + gap * (len(n) + 1), -1, np.int64)
        text[np.arange(len(number)) + shift] = number
        matches = [(end, k) for end, k in self.automaton.iter(self._written(text))]
        cover, owners = np.zeros(len(text) + 1, np.int64), {}
        row_at = w.rows[:-1] + np.arange(len(n)) * gap + gap
        for lo in range(0, len(matches), SEEDS):
            part = matches[lo : lo + SEEDS]
            count = np.array([len(self.found[k][1]) for _, k in part])
            for some in np.array_split(np.arange(len(part)), max(1, -(-int(count.sum()) // (SEEDS * 16)))):
                if len(some):
                    self._extend([part[k] for k in some.tolist()], text, row_at, cover, owners)
        hit = np.cumsum(cover[:-1]) > 0
        for r in range(len(n)):
            if r not in owners:
                yield int(n[r]), [], set()
                continue
            own = hit[row_at[r] : row_at[r] + n[r]]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            yield int(n[r]), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), {self.names[k] for k in owners[r]}

    def _extend(self, seeds: list[tuple[int, int]], text: np.ndarray, row_at: np.ndarray, cover: np.ndarray, owners: dict[int, set[int]]) -> None:
        """Extend matches (end in characters, pattern) on both sides; note the words of those that are long enough, and their items."""
        size, reach = self.size, self.size - self.block
        length = np.concatenate([np.full(len(self.found[k][1]), self.found[k][0]) for _, k in seeds])
        place = np.concatenate([self.found[k][1] for _, k in seeds])
        whole = np.concatenate([self.found[k][2] for _, k in seeds]) > 0
        end = np.repeat(np.array([e // self.places + 1 for e, _ in seeds]), [len(self.found[k][1]) for _, k in seeds])
        start = end - length
        left, right, on_left, on_right = (np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), ~whole, ~whole)
        for k in range(1, reach + 1):
            a = text[start - k]
            on_left = on_left & (a >= 0) & (a == self.item[place - k])
            left += on_left
            b = text[end + k - 1]
            on_right = on_right & (b >= 0) & (b == self.item[place + length + k - 1])
            right += on_right
        good = whole | (left + length + right >= size)
        first, last = (start - left)[good], (end + right)[good]
        np.add.at(cover, first, 1)
        np.add.at(cover, last, -1)
        row = np.searchsorted(row_at, first, side="right") - 1
        for r, k in np.unique(np.column_stack([row, self.owner[place[good]]]), axis=0).tolist():
            owners.setdefault(r, set()).add(k)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _pass(items: list[tuple[str, str | None]], size: int, text_at: int, kept: int, again: bool):
    """Batches have the text at ``text_at`` and, if ``again``, what earlier passes found; the first ``kept`` columns stay."""
    key = ("matcher", size, hashlib.sha256(repr(items).encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = once_per_worker(key, lambda: Matcher(items, size))
        for b in batches:
            n_words, spans, found = [], [], []
            for chunk in chunks(b.column(text_at)):
                for n, hit, got in matcher.scan(chunk):
                    n_words.append(n)
                    spans.append(hit)
                    found.append(got)
            if again:
                for k, (old, had) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)):
                    if old:
                        spans[k] = _merge(sorted([*spans[k], *((x["first"], x["last"]) for x in old)]))
                        found[k] = found[k] | set(had)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:kept],
                    pa.array(n_words, pa.int64()),
                    pa.array([[{"first": x, "last": y} for x, y in s] for s in spans], SPANS),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ],
                names=[*b.schema.names[:kept], "n_words", "spans", "items"],
            )

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where word ranges lie in the original text, in code points."""
    chunk = next(chunks(pa.array([text])))
    w = words(chunk, ALNUM_WORDS)
    points = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))
    return [(int(points[w.source_starts[a]]), int(points[w.source_ends[z - 1]])) for a, z in spans]


def find_contamination(docs: DataFrame, items: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, limit: int = AUTOMATON_WORDS) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of the columns ``carry``), n_words, spans (word ranges [first, last) hit)
    and items (those with windows in the text: ids as strings, sorted).

    Carried columns are in a struct of their own, so no name clashes.  A null text has no words, a null item no windows, and an
    item with a null id none either.  Repeated items count once under their id; repeated documents give repeated rows.  An empty
    benchmark hits nothing; empty documents give an empty table.  ``character_spans`` maps word ranges to the original text.

    The benchmark's size is measured first.  Up to ``limit`` words of it go to the tasks in one automaton; a larger one is dealt
    into automata of about that size by a hash of the item, each a pass over the texts, with results written in between.
    """
    named = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = named.agg(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    parts = max(1, -(-total // limit))
    rows, names, text_at = carried(docs, carry, text_col)
    fields = list(rows.schema)
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    made = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))]
    work = Workspace(docs.sparkSession, "decontamination") if parts > 1 else None
    for k in range(parts):
        part = named if parts == 1 else named.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        more = k < parts - 1
        kept = len(fields) if more else len(names)
        rows = rows.mapInArrow(frugal(_pass([tuple(r) for r in part.collect()], size, text_at, kept, k > 0)), T.StructType([*fields[:kept], *made]))
        if more:
            rows = work.keep(rows, f"pass-{k}")
    return rows.select(row_of(carry, names), "n_words", "spans", "items")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_contamination``'s rows, which carry doc_id."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
