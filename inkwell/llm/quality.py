"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path have shown so far.

A logistic classifier on surface measures gives each document a probability of being good.  Their sums by path and by host are
shrunk: a path towards its host, a host towards the corpus, the more the fewer documents it has.  How strongly is estimated from
the spread between sites.  The prior odds of a document's path then correct the classifier's odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, spread_join
from .wordscan import LOWER_WORDS, Hasher, chunks, edges

TRAIN_DOCS = 4000
"""Labelled documents of either class that are fitted on at most, chosen by a hash of the id."""
HASHES = Hasher(0x0A11)
MEASURES = 12


def measures(texts: pa.Array) -> np.ndarray:
    """For each text: logs of its bytes and words, mean word length, shares of letters, capitals, digits, marks, rare marks and bars,
    line breaks per word, the share of words that are new in the text, and the share of its most common word."""
    kinds = np.zeros((256, 6), bool)
    for k, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*@^~<>{}[]\\/=+_`", b"|")):
        kinds[np.frombuffer(members, np.uint8), k] = True
    kinds[0x80:, 0] = True
    out = []
    for chunk in chunks(texts):
        data, starts, ends, rows = edges(chunk, LOWER_WORDS)
        n_words, n_bytes = np.diff(rows), np.diff(chunk.offsets)
        size = np.maximum(n_bytes, 1)
        m = np.zeros((len(n_words), MEASURES))
        m[:, 0], m[:, 1] = np.log1p(n_bytes), np.log1p(n_words)
        at = np.concatenate(([0], np.cumsum(ends - starts)))
        m[:, 2] = (at[rows[1:]] - at[rows[:-1]]) / np.maximum(n_words, 1)
        for k in range(6):
            sums = np.concatenate(([0], np.cumsum(kinds[chunk.data, k])))
            m[:, 3 + k] = (sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]) / size
        sums = np.concatenate(([0], np.cumsum(chunk.data == 10)))
        m[:, 9] = (sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]) / np.maximum(n_words, 1)
        word = HASHES.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(n_words)), n_words)
        order = np.lexsort((word, row))
        new = np.flatnonzero(np.concatenate(([True], (row[order][1:] != row[order][:-1]) | (word[order][1:] != word[order][:-1])))) if len(word) else np.zeros(0, np.int64)
        kinds_of = row[order][new]
        m[:, 10] = np.bincount(kinds_of, minlength=len(n_words)) / np.maximum(n_words, 1)
        np.maximum.at(m[:, 11], kinds_of, np.diff(np.append(new, len(word))))
        m[:, 11] /= np.maximum(n_words, 1)
        out.append(m)
    return np.concatenate(out) if out else np.zeros((0, MEASURES))


def expand(m: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standard scores, their squares and a constant; scores beyond 6 count as 6."""
    z = np.clip((m - mean) / spread, -6, 6)
    return np.column_stack([z, z * z, np.ones(len(z))])


def fit(m: np.ndarray, good: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights of the logistic classifier; with one class only, its constant log-odds."""
    if not len(m):
        return np.zeros(MEASURES), np.ones(MEASURES), np.zeros(2 * MEASURES + 1)
    mean, spread = m.mean(axis=0), m.std(axis=0) + 1e-9
    x, w = expand(m, mean, spread), np.zeros(2 * MEASURES + 1)
    shrink = np.r_[np.full(2 * MEASURES, ridge), 1e-3]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - good) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _measured(rows: DataFrame) -> DataFrame:
    """Replace the last column, a text, by its measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measures(b.column(b.num_columns - 1))
            lists = pa.ListArray.from_arrays(np.arange(0, m.size + 1, MEASURES, dtype=np.int32), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=schema.names)

    schema = T.StructType([*list(rows.schema)[:-1], T.StructField("m", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on labelled documents whose crc32 of the id modulo 5 is not 0; null ids and labels are left out, the best of several counts."""
    told = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("good"))
    told = told.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    ids = None
    for kind in (0, 1):
        some = told.where(F.col("good") == kind).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # at most twice TRAIN_DOCS ids
    rows = _measured(texts.select("id", "good", "text")).groupBy("id").agg(F.min("good").alias("good"), F.min("m").alias("m")).orderBy("id").collect()
    return fit(np.array([r.m for r in rows]).reshape(-1, MEASURES), np.array([r.good for r in rows], np.float64))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(parent: str) -> Column:
    """How many documents a site's parent is worth: from the mean within-site variance and the variance between sites' shares.

    By moments, over sites of at least two documents; between 1 and 10,000, and 10,000 if sites don't differ beyond chance.
    """
    share = F.col("good") / F.col("n")
    mean = F.sum("good") / F.sum("n")
    between = F.sum(F.col("n") * F.pow(share - F.col(parent), 2)) / F.sum("n")
    within = mean * (1 - mean)
    chance = within * F.count("*") / F.sum("n")
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1e4), within / F.greatest(between - chance, F.lit(1e-9)))), F.lit(1e4))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, path, evidence (the classifier's probability), site (the path's prior without this
    document), quality (their posterior) and keep (quality of at least 0.5).

    Null hosts and paths are sites of their own.  Null and empty texts have the measures of an empty text.  Repeated rows count as
    often as they come.  No other columns are read.  An empty table gives an empty result.

    Sums by path and host are combined on the map side.  Priors join by key; hosts of many paths and paths of many documents are
    joined by broadcast, a bounded number of them, so that none meets in one task.
    """
    mean, spread, weights = model
    work = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = expand(measures(b.column(3)), mean, spread) @ weights
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=schema.names)

    schema = T.StructType([*list(rows.schema)[:-1], T.StructField("evidence", T.DoubleType())])
    told = work.keep(rows.mapInArrow(run, schema), "evidence")

    paths = told.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good"))
    paths = work.keep(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("docs"), F.sum("good").alias("good"), F.count("*").alias("paths"))
    whole = paths.agg(((F.sum("good") + 0.5) / (F.sum("n") + 1)).alias("all"))
    hosts = work.keep(hosts.crossJoin(F.broadcast(whole)), "hosts")  # one row
    k0 = hosts.select("good", F.col("docs").alias("n"), "all").agg(_strength("all").alias("k0"))
    of_host = (F.col("good") + F.col("k0") * F.col("all")) / (F.col("docs") + F.col("k0"))
    hosts = work.keep(hosts.crossJoin(F.broadcast(k0)).select("host", "all", of_host.alias("of_host"), F.col("paths").alias("n")), "host-priors")
    paths = work.keep(spread_join(paths, hosts, ["host"]), "path-priors")
    k1 = paths.agg(_strength("of_host").alias("k1"))
    paths = work.keep(paths.crossJoin(F.broadcast(k1)).select("host", "path", "n", F.col("n").alias("docs"), "good", "all", "of_host", "k1"), "priors")

    both = spread_join(told, paths, ["host", "path"])
    site = (F.col("good") - F.col("evidence") + F.col("k1") * F.col("of_host")) / (F.col("docs") - 1 + F.col("k1"))
    both = both.withColumn("site", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site)))
    own = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("evidence")))
    logit = _odds(own) + _odds(F.col("site")) - _odds(F.col("all"))
    both = both.withColumn("quality", 1 / (1 + F.exp(-logit)))
    return both.select(F.col("id").alias("doc_id"), "host", "path", "evidence", "site", "quality", (F.col("quality") >= 0.5).alias("keep"))
