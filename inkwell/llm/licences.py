"""Licence scans: TF-IDF cosine of a text's lines to licence templates, then inheritance from the nearest ancestor directory.

Every line is compared, wherever it stands, so headers, footers and whole licence files are all found.  Lines of more than
``LINE`` words are compared in overlapping windows.  Besides, each template is compared with every window of its own length, across
lines too, so a notice inside a paragraph is found.  A directory's licence is what its licence files say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, spread_join
from .wordscan import ALNUM_WORDS, Hasher, chunks, edges

HASHES = Hasher(0x11CE)
LINE, WINDOW, STRIDE = 40, 32, 16
THRESHOLD = 0.6
RARE_OF = 10_000
"""Words outside the templates weigh as if in none of this many documents, or of all if they are fewer."""
FILE_SHARE = 0.5
"""A text of which at least this share of words stands in licence lines is a licence file."""
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"

# Short notices by identifier, as they are commonly worded.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
}


def _split(text: str) -> list[str]:
    chunk = next(chunks(pa.array([text])))
    data, starts, ends, _ = edges(chunk, ALNUM_WORDS)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Vocabulary:
    """The templates' words and, once document counts are known, their weights."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        notices = [(name, _split(t)) for name, texts in templates.items() for t in texts]
        self.names = [n for n, _ in notices]
        self.terms = sorted({w for _, ws in notices for w in ws})
        at = {w: k for k, w in enumerate(self.terms)}
        self.counts = np.zeros((len(notices), len(self.terms)))
        for k, (_, ws) in enumerate(notices):
            np.add.at(self.counts[k], [at[w] for w in ws], 1)
        data = np.frombuffer(" ".join(self.terms).encode(), np.uint8)
        sizes = np.array([len(w.encode()) for w in self.terms])
        ends = np.cumsum(sizes + 1) - 1
        hashes = HASHES.words(data, ends - sizes, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each word hash, or -1."""
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, self.order[k], -1)

    def weigh(self, n: int, df: np.ndarray) -> None:
        self.idf = np.log((n + 1) / (df + 1)) + 1
        self.rare = np.log(min(n, RARE_OF) + 1) + 1  # of a word that is in no template
        weights = self.counts * self.idf
        self.unit = weights / np.linalg.norm(weights, axis=1, keepdims=True)
        self.sizes = self.counts.sum(axis=1).astype(np.int64)


def _terms(chunk, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, starts, ends, rows = edges(chunk, ALNUM_WORDS)
    return vocabulary.find(HASHES.words(data, starts, ends)) if len(starts) else np.zeros(0, np.int64), starts, rows


def document_counts(texts: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """In how many of the texts each term is."""
    df = np.zeros(len(vocabulary.terms), np.int64)
    for chunk in chunks(texts):
        term, _, rows = _terms(chunk, vocabulary)
        hit = np.flatnonzero(term >= 0)
        row = np.searchsorted(rows, hit, side="right")
        np.add.at(df, np.unique(row * len(df) + term[hit]) % len(df), 1)
    return df


def _own_windows(term: np.ndarray, rows: np.ndarray, v: Vocabulary, threshold: float) -> np.ndarray:
    """The windows (begin, end) of a template's own length within a text whose cosine to it may reach the threshold.

    The dot product is a sum over a window's words, and the squared norm at least the sum of their squared weights.
    """
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    hit = term >= 0
    weight = np.append(v.idf, v.rare)[term]
    norms = np.concatenate(([0], np.cumsum(weight**2)))
    found = [np.zeros((0, 2), np.int64)]
    for k, size in enumerate(v.sizes.tolist()):
        if size > len(term):
            continue
        dots = np.concatenate(([0], np.cumsum(np.where(hit, np.append(v.idf * v.unit[k], 0)[term], 0))))
        dot = dots[size:] - dots[:-size]
        near = np.flatnonzero((dot > 0) & (dot**2 >= (threshold - 1e-6) ** 2 * (norms[size:] - norms[:-size])))
        near = near[row[near] == row[near + size - 1]]
        found.append(np.column_stack([near, near + size]))
    return np.unique(np.concatenate(found), axis=0)


def scan(texts: pa.Array, v: Vocabulary, threshold: float = THRESHOLD) -> Iterator[tuple[str | None, float, float]]:
    """For each text: the best-matching licence (the first template if equal), its cosine, and the share of words in licence lines."""
    for chunk in chunks(texts):
        term, starts, rows = _terms(chunk, v)
        n = len(rows) - 1
        breaks = np.flatnonzero(chunk.data == 10)
        first = np.unique(np.concatenate([np.searchsorted(starts, breaks), rows]))
        first, last = first[:-1], first[1:]
        long = last - first > LINE
        spans = [np.column_stack([first[~long], last[~long]])]
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            begin = np.arange(a, max(b - WINDOW + STRIDE, a + 1), STRIDE)
            spans.append(np.column_stack([begin, np.minimum(begin + WINDOW, b)]))
        lines = np.concatenate(spans)
        own = _own_windows(term, rows, v, threshold)
        spans = np.concatenate([lines, own])
        whole = np.arange(len(spans)) < len(lines)
        known = np.concatenate(([0], np.cumsum(term >= 0)))
        some = known[spans[:, 1]] > known[spans[:, 0]]
        spans, whole = spans[some], whole[some]
        best, score, words = np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
        if len(spans):
            size = spans[:, 1] - spans[:, 0]
            of = np.repeat(np.arange(len(spans)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(spans[:, 0], size)
            t = term[at]
            tf = np.bincount(of[t >= 0] * len(v.terms) + t[t >= 0], minlength=len(spans) * len(v.terms)).reshape(len(spans), -1) if len(spans) * len(v.terms) < 1 << 24 else None
            if tf is None:
                tf = np.zeros((len(spans), len(v.terms)), np.float32)
                np.add.at(tf, (of[t >= 0], t[t >= 0]), 1)
            weights = tf * v.idf
            norm = np.sqrt((weights**2).sum(axis=1) + (size - tf.sum(axis=1)) * v.rare**2)
            cosine = (weights @ v.unit.T) / norm[:, None]
            top = cosine.argmax(axis=1)
            value = np.round(cosine[np.arange(len(spans)), top], 9)
            row = np.searchsorted(rows, spans[:, 0], side="right") - 1
            taken = [set() for _ in range(n)]
            hits = np.flatnonzero(value >= threshold)
            for k in hits[np.lexsort((hits, -value[hits], ~whole[hits]))].tolist():
                r, span = row[k], (int(spans[k, 0]), int(spans[k, 1]))
                if whole[k]:
                    words[r].append(span)
                elif taken[r].isdisjoint(range(*span)):  # of windows that overlap the best counts
                    taken[r].update(range(*span))
                    words[r].append(span)
                if value[k] > score[r] or (value[k] == score[r] and top[k] < best[r]):
                    best[r], score[r] = top[k], value[k]
        for r in range(n):
            covered = len({w for a, b in words[r] for w in range(a, b)})
            yield (v.names[best[r]] if best[r] >= 0 else None), float(score[r]), covered / max(int(rows[r + 1] - rows[r]), 1)


def scan_licences(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, path, own (the licence its text states or null), score (its cosine), is_file (whether the
    text is a licence file by name or content), licence (its own, else that of the nearest directory above with a licence file)
    and origin ('text', the directory it comes from, or null).

    A directory with several licence files has the licence most of them state, the first by name if equal.  A null path has no
    directory; null and empty texts state no licence.  Repeated rows count as often as they come; no other column is read; an
    empty table gives an empty result.  Document counts of the templates' words are taken over all rows; words outside the
    templates weigh as if in no document.
    """
    work = Workspace(docs.sparkSession, "licences")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, df, n = Vocabulary(), 0, 0
        for b in batches:
            df, n = df + document_counts(b.column(0), v), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate(([n], df)))], names=["term", "n"])

    counted = {r.term: r.n for r in rows.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    size = len(Vocabulary().terms)  # as many rows as the templates have words, and one
    n, df = counted.get(-1, 0), np.array([counted.get(k, 0) for k in range(size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary()
        v.weigh(n, df)
        for b in batches:
            own, score, share = zip(*scan(b.column(2), v, threshold), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(own, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], names=schema.names)

    made = [T.StructField("own", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType())]
    schema = T.StructType([*list(rows.schema)[:-1], *made])
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    is_file = F.col("own").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.coalesce(name.rlike(FILE_NAME), F.lit(False)))
    found = rows.mapInArrow(run, schema).withColumn("is_file", is_file)
    found = work.keep(found.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "found")

    votes = found.where("is_file AND path IS NOT NULL").groupBy("dir", "own").agg(F.count("*").alias("n"))
    said = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("v")).select(F.col("dir").alias("up"), F.col("v.own").alias("given"))
    dirs = work.keep(found.where("path IS NOT NULL").groupBy("dir").agg(F.count("*").alias("n")), "dirs")
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    above = dirs.select("dir", F.explode(F.filter(ups, lambda u: (u["depth"] == 0) | (u["up"] != ""))).alias("u")).select("dir", "u.depth", "u.up")
    nearest = above.join(said, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("g")).select("dir", "g.up", "g.given")

    both = spread_join(found, work.keep(dirs.join(nearest, "dir", "left"), "nearest"), ["dir"], "left")  # no path: no dir
    origin = F.when(F.col("own").isNotNull(), F.lit("text")).when(F.col("given").isNotNull(), F.col("up"))
    return both.select(F.col("id").alias("doc_id"), "path", "own", "score", "is_file", F.coalesce("own", "given").alias("licence"), origin.alias("origin"))
