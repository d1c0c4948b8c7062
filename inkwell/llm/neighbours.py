"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to unit length, is turned by pseudo-rotations (sign flips and Hadamard transforms, three times) and assigned to
the nearest signed axis, once for each table.  A query probes, in each table, the ``probes`` axes nearest to it; the vectors it
meets there are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Workspace

TABLES = 8
PROBES = 12
SEED = 11
BUCKET_ROWS = 50_000
"""Vectors of one bucket in one task; larger buckets are dealt into several tasks, to each of which their queries go."""


class Rotations:
    """The pseudo-rotations of all tables for vectors of ``dim`` numbers, padded to a power of two."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.width = 1 << max(dim - 1, 1).bit_length()
        self.signs = np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (tables, 3, self.width))

    def turn(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        y[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for flips in self.signs[table]:
            y = hadamard(y * flips)
        return y

    def axes(self, x: np.ndarray, count: int) -> np.ndarray:
        """For each vector and table the ``count`` nearest signed axes, nearest first, numbered apart for each table."""
        out = np.empty((len(x), len(self.signs), count), np.int32)
        for k in range(len(self.signs)):
            y = self.turn(x, k)
            both = np.concatenate([y, -y], axis=1)
            out[:, k] = np.argsort(-both, axis=1, kind="stable")[:, :count] + k * 2 * self.width
        return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _hash_rows(dim: int, tables: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = Rotations(dim, tables)
        for b in batches:
            if b.num_rows:
                keys = turns.axes(_matrix(b.column(1), dim), count).reshape(b.num_rows, -1)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["id", "v", "keys"])

    return run


def distances(vectors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The Euclidean distance of each vector to x; by scaled differences where their squares overflow or vanish."""
    with np.errstate(over="ignore", under="ignore"):
        apart = vectors - x
        out = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~(out < 1e150) | (out < 1e-150))
        if len(odd):
            half = vectors[odd] / 2 - x / 2  # of two huge numbers the difference itself may overflow
            most = np.abs(half).max(axis=1)
            unit = half / np.where(most > 0, most, 1)[:, None]
            out[odd] = np.sqrt((unit**2).sum(axis=1)) * most * 2
    return out


def rough_squares(points: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate squared distances of all points to all rows of x, scaled by a common power, and bounds of their errors."""
    scale = 2.0 ** -np.frexp(max(np.abs(points).max(initial=0), np.abs(x).max(initial=0)))[1].astype(np.float64)
    p, v = points * scale, x * scale
    pp, vv = (p**2).sum(axis=1)[:, None], (v**2).sum(axis=1)
    return pp + vv - 2 * p @ v.T, (8 + 4 * p.shape[1]) * np.finfo(float).eps * (pp + vv) + 1e-300


def nearest(ids: np.ndarray, vectors: np.ndarray, query: int, x: np.ndarray, k: int, rough: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of ``vectors`` to x by exact distance, ties to the smaller id, leaving out rows with the query's own id.

    ``rough`` are approximate squares and ``slack`` bounds of their errors: what can't be among the k nearest is not compared exactly.
    """
    high = np.where(ids == query, np.inf, rough + slack)
    near = np.arange(len(ids))
    if len(ids) > k:
        bound = np.partition(high, k - 1)[k - 1]
        near = np.flatnonzero(rough - slack <= bound)
        if len(np.unique(ids[near])) < k + 1 and len(near) < len(ids):  # repeated ids took places of others
            each, of = np.unique(ids, return_inverse=True)
            least = np.full(len(each), np.inf)
            np.minimum.at(least, of, high)
            bound = np.partition(least, k - 1)[k - 1] if len(each) > k else np.inf
            near = np.flatnonzero(rough - slack <= bound)
    near = near[ids[near] != query]
    exact = distances(vectors[near], x)
    order = np.lexsort((ids[near], exact))
    order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:k]  # an id once
    return ids[near][order], exact[order]


def _search(dim: int, k: int):
    """Rows (key, salt, vector, id, v), sorted by all but the last two, queries first: meet the queries of a bucket with its vectors.

    A bucket's vectors are taken a batch at a time; only its queries and their best so far are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked, points, best = None, [], None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if best:
                q = np.repeat(np.fromiter(best, np.int64, len(best)), [len(x[0]) for x in best.values()])
                i, d = (np.concatenate([x[j] for x in best.values()]) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i.astype(np.int64)), pa.array(d.astype(np.float64))], names=["q", "id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy().astype(np.int64) << 32 | b.column("salt").to_numpy()
            vector, ids, v = b.column("vector").to_numpy(zero_copy_only=False), b.column("id").to_numpy(), _matrix(b.column("v"), dim)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (vector[1:] != vector[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if key[lo] != current:
                    yield from close()
                    current, asked, points, best = key[lo], [], None, {}
                if not vector[lo]:
                    asked.append((ids[lo:hi], v[lo:hi]))
                    points = None
                elif asked:
                    if points is None:
                        points = np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked])
                    own, x = ids[lo:hi], v[lo:hi]
                    rough, slack = rough_squares(points[1], x)
                    for n, q in enumerate(points[0].tolist()):
                        i, d = nearest(own, x, q, points[1][n], k, rough[n], slack[n])
                        if q in best:
                            i, d = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], d])
                            order = np.lexsort((i, d))
                            order = order[np.sort(np.unique(i[order], return_index=True)[1])][:k]
                            i, d = i[order], d[order]
                        best[q] = i, d
        yield from close()

    return run


def _meet(queries: DataFrame, vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """Rows (q, id, score) from queries and vectors that share key and salt."""
    both = queries.select("key", "salt", F.lit(False).alias("vector"), "id", "v").unionByName(vectors.select("key", "salt", F.lit(True).alias("vector"), "id", "v"))
    return both.repartition("key", "salt").sortWithinPartitions("key", "salt", "vector").mapInArrow(_search(dim, k), "q bigint, id bigint, score double")


def _salted(queries: DataFrame, vectors: DataFrame, counts: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Deal buckets of more than ``rows`` vectors by id; their queries go to every part.  ``counts`` has a row for each bucket."""
    parts = F.broadcast(counts.select("key", F.ceil(F.col("n") / rows).cast("int").alias("parts")))  # at most tables * 2 * width rows
    vectors = vectors.join(parts, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    queries = queries.join(parts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return queries, vectors


def nearest_neighbours(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every``, the k nearest found of all other rows.

    Nearness is Euclidean distance in double precision; ties go to the smaller id.  Vectors that are null, zero, or hold a null or
    non-finite number, or another count of numbers than most do, take no part; nor do null ids.  Rows that share an id are one
    candidate, with its smallest distance; no query meets its own id; of rows that share a query's id the smallest vector asks, by
    its numbers in order.  A query that finds fewer than k is compared with all rows.  Distances that a double can't hold are inf.
    An empty table gives an empty result; further columns are not read.
    """
    work = Workspace(table.sparkSession, "neighbours")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes.d
    rows = rows.where(F.size("v") == dim).select("id", F.col("v").cast("array<float>").alias("v") if table.schema[vector_col].dataType.simpleString() == "array<float>" else "v")
    kind = rows.schema["v"].dataType.simpleString()
    hashed = work.keep(rows.mapInArrow(_hash_rows(dim, tables, 1), f"id bigint, v {kind}, keys array<int>"), "vectors")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = work.keep(asked.mapInArrow(_hash_rows(dim, tables, min(probes, 2 * dim)), f"id bigint, v {kind}, keys array<int>"), "queries")

    vectors = hashed.select("id", "v", F.explode("keys").alias("key"))
    counts = hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    found = _meet(*_salted(asked.select("id", "v", F.explode("keys").alias("key")), vectors, counts, bucket_rows), dim, k)
    found = work.keep(found.groupBy("q", "id").agg(F.min("score").alias("score")), "found")

    enough = found.groupBy(F.col("q").alias("id")).count().where(F.col("count") >= k)
    short = work.keep(asked.join(enough, "id", "left_anti").select("id", "v"), "short")
    if not short.isEmpty():
        one = F.lit(-1).alias("key")
        all_ = hashed.agg(F.lit(-1).alias("key"), F.count("*").alias("n")).where("n > 0")
        found = found.unionByName(_meet(*_salted(short.select("id", "v", one), hashed.select("id", "v", one), all_, bucket_rows), dim, k)).groupBy("q", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
