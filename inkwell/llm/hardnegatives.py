"""Hard-negative mining by distributed radix selection.

A window asks for the first k rows, by falling score and then rising id, among rows of the anchor's label or of other labels whose
integer score lies in a range.  Rows and windows are dealt into cells, a block of rows against a block of windows.  Each cell counts
its rows by the next digit of the key; the sums locate the digit that holds the k-th row, and the range shrinks to that digit until
few rows are left in it.  Digits of the score come first; rows of equal score go on by digits of the id.  Only rows that
qualify then leave their cells.  Scores are never stored, and nothing but the number of rows and windows is sent to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Workspace

DIGIT = 12
"""Bits of a digit."""
FEW = 64
"""A digit with so many rows at most is gathered and sorted, not refined."""
ROWS, WINDOWS = 1 << 16, 1 << 14
"""Rows and windows of a cell at most, about."""
SCORES = 1 << 20
"""Scores that a task has in memory at once, about."""
MOST = (1 << 63) - 1
EXACT = float(1 << 53)
"""Below this, products of whole numbers are exact in double precision."""


def vectors_of(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, vector) of rows with an id, a label and a vector of finite numbers; of several rows of one id the least counts."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width))
    if len(flat):
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def _whole(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale


class Scorer:
    """Integer inner products of ``scale`` times the vectors, rounded down.  Beyond 64 bits the nearest 64-bit number counts."""

    def __init__(self, vectors: np.ndarray, scale: int):
        self.vectors, self.scale = vectors, scale
        with np.errstate(over="ignore"):
            self.whole = np.floor(vectors * scale)
        self.top = np.abs(self.whole).max(axis=1, initial=0)

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        """Scores [row, anchor] as int64."""
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(anchors * self.scale)
            most = self.top.max(initial=0) * np.abs(whole).max(initial=0) * max(1, anchors.shape[1])
            if most < EXACT:
                return (self.whole @ whole.T).astype(np.int64)
            risky = self.top[:, None] * np.abs(whole).max(axis=1, initial=0)[None, :] * max(1, anchors.shape[1]) >= EXACT
            out = np.where(risky, 0.0, self.whole @ whole.T).astype(np.int64)
        for i, j in zip(*np.nonzero(risky), strict=True):
            exact = sum(_whole(a, self.scale) * _whole(b, self.scale) for a, b in zip(self.vectors[i].tolist(), anchors[j].tolist(), strict=True))
            out[i, j] = min(max(exact, -MOST), MOST)
        return out


def _cell(rows: pa.Table, windows: pa.Table, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each window of a cell its place, and the ids and scores of the rows of its labels; the anchor's own row takes no part."""
    if not rows.num_rows or not windows.num_rows:
        return
    width = max(pc.max(pc.list_value_length(t["vector"])).as_py() for t in (rows, windows))
    scorer = Scorer(_matrix(rows["vector"], width), scale)
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    anchor, own, same = (windows[c].to_numpy() for c in ("anchor", "label", "same"))
    distinct, first, kind = np.unique(anchor, return_index=True, return_inverse=True)
    vectors = _matrix(windows["vector"].take(pa.array(first)), width)
    order = np.argsort(kind, kind="stable")
    step = max(1, SCORES // rows.num_rows)
    for lo in range(0, len(distinct), step):
        scores = scorer(vectors[lo : lo + step])
        for w in order[slice(*np.searchsorted(kind[order], (lo, lo + step)))].tolist():
            at = np.flatnonzero(((labels == own[w]) == same[w]) & (ids != anchor[w]))
            yield w, ids[at], scores[at, kind[w] - lo]


def _shift(lo: int, hi: int) -> int:
    """How far to shift distances within [lo, hi] to get the leading digit."""
    return max(0, (int(hi) - int(lo)).bit_length() - DIGIT)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b of 64-bit numbers, a >= b; up to 2 ** 64 - 1."""
    return np.asarray(a, np.int64).view(np.uint64) - np.asarray(b, np.int64).view(np.uint64)


def _table(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    made = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(x.astype(np.int64)) for x in made], names=names)


def _histograms(scale: int):
    """A cell's rows by the leading digit of their distance from a window's best key, as far down as its last needed row may be."""

    def run(rows: pa.Table, windows: pa.Table) -> pa.Table:
        anchor, part, need, lo, hi, id_lo, id_hi = (windows[c].to_numpy() for c in ("anchor", "part", "need", "lo", "hi", "id_lo", "id_hi"))
        found = []
        for w, ids, scores in _cell(rows, windows, scale):
            if lo[w] < hi[w]:
                key = _distance(hi[w : w + 1], scores[(scores >= lo[w]) & (scores <= hi[w])]) >> np.uint64(_shift(lo[w], hi[w]))
            else:
                key = _distance(ids[(scores == lo[w]) & (ids >= id_lo[w]) & (ids <= id_hi[w])], id_lo[w : w + 1]) >> np.uint64(_shift(id_lo[w], id_hi[w]))
            each, n = np.unique(key, return_counts=True)
            last = int(np.searchsorted(np.cumsum(n), need[w])) + 1
            each, n = each[:last], n[:last]
            found.append((np.full(len(n), anchor[w]), np.full(len(n), part[w]), each, n))
        return _table(found, ["anchor", "part", "digit", "n"])

    return run


def _qualifying(scale: int):
    """A cell's rows from a window's top down to its cut; of those at the cut the ones with small ids, where ids were refined."""

    def run(rows: pa.Table, windows: pa.Table) -> pa.Table:
        anchor, part, top, lo, hi, id_hi = (windows[c].to_numpy() for c in ("anchor", "part", "top", "lo", "hi", "id_hi"))
        found = []
        for w, ids, scores in _cell(rows, windows, scale):
            at = np.flatnonzero((scores <= top[w]) & (scores >= lo[w]) & ((scores > lo[w]) | (lo[w] < hi[w]) | (ids <= id_hi[w])))
            found.append((np.full(len(at), anchor[w]), np.full(len(at), part[w]), ids[at], scores[at]))
        return _table(found, ["anchor", "part", "id", "score"])

    return run


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shrink each window to the digit that holds its last needed row.  It is settled if that digit has few rows, or if all rows are needed."""
    changed = ["need", "lo", "hi", "id_lo", "id_hi"]
    for b in batches:
        rows = b.select([*changed, "digits"]).to_pylist()
        for r in rows:
            before, digit, inside = 0, None, 0
            for d in r["digits"]:
                if before + d["n"] >= r["need"]:
                    digit, inside = d["digit"], d["n"]
                    break
                before += d["n"]
            r["settled"] = digit is None or inside <= max(FEW, r["need"] - before)
            if digit is None:
                continue
            r["need"] -= before
            if r["lo"] < r["hi"]:
                shift = _shift(r["lo"], r["hi"])
                r["lo"], r["hi"] = max(r["lo"], r["hi"] - ((digit + 1) << shift) + 1), r["hi"] - (digit << shift)
            else:
                shift = _shift(r["id_lo"], r["id_hi"])
                r["id_lo"], r["id_hi"] = r["id_lo"] + (digit << shift), min(r["id_hi"], r["id_lo"] + ((digit + 1) << shift) - 1)
        names = [n for n in b.schema.names if n != "digits"]
        columns = [pa.array([r[n] for r in rows], pa.int64()) if n in changed else b.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r["settled"] for r in rows], pa.bool_())], names=[*names, "settled"])


STATE = "anchor bigint, part int, label bigint, vector array<double>, same boolean, top bigint, lo bigint, hi bigint, id_lo bigint, id_hi bigint, need bigint"


def _in_cells(rows: DataFrame, windows: DataFrame, sizes: tuple[int, int], run, schema: str) -> DataFrame:
    """Apply ``run`` to each block of rows against each block of windows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across, down = max(parts, -(-sizes[0] // ROWS)), max(1, -(-sizes[1] // WINDOWS))
    left = rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(across))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    right = windows.withColumn("q", F.pmod(F.xxhash64("anchor", "part"), F.lit(down))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    return left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(run, schema)


def select_first(rows: DataFrame, windows: DataFrame, k: int, work: Workspace, name: str, scale: int = 1) -> DataFrame:
    """(anchor, part, rank, id, score): the first ``k`` rows of each window, all if fewer, by falling score and rising id.

    ``rows`` has (id, label, vector), ids once each; ``windows`` has (anchor, part, label, vector, same, lo, hi), which is a window of the
    anchor with that id, label and vector: rows but the anchor of its label, or of others unless ``same``, with a score from lo to
    hi.  An empty range gives no rows.  Both tables are read for each digit, so they should be stored.
    """
    ids = rows.agg(F.count("*").alias("n"), F.coalesce(F.min("id"), F.lit(0)).alias("a"), F.coalesce(F.max("id"), F.lit(0)).alias("b")).first()
    start = windows.where("lo <= hi").select(
        "anchor", "part", "label", "vector", "same", F.col("hi").alias("top"), "lo", "hi", F.lit(ids.a).cast("long").alias("id_lo"), F.lit(ids.b).cast("long").alias("id_hi"), F.lit(k).cast("long").alias("need")
    )
    open_, settled, turn = work.keep(start, f"{name}-0"), [], 0
    sizes = (ids.n, open_.count())
    while not open_.isEmpty():
        turn += 1
        counts = _in_cells(rows, open_, sizes, _histograms(scale), "anchor bigint, part bigint, digit bigint, n bigint")
        counts = counts.groupBy("anchor", "part", "digit").agg(F.sum("n").alias("n")).groupBy("anchor", "part").agg(F.sort_array(F.collect_list(F.struct("digit", "n"))).alias("digits"))
        counts = counts.withColumn("part", F.col("part").cast("int"))
        refined = open_.join(counts, ["anchor", "part"]).mapInArrow(_refine, f"{STATE}, settled boolean")  # a window without rows has no counts and goes
        refined = work.keep(refined, f"{name}-{turn}")
        settled.append(refined.where("settled").drop("settled"))
        open_ = refined.where("NOT settled").drop("settled")
    ends = start.limit(0)
    for more in settled:
        ends = ends.unionByName(more)
    found = _in_cells(rows, work.keep(ends, f"{name}-ends"), sizes, _qualifying(scale), "anchor bigint, part bigint, id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("anchor", "part").orderBy(F.desc("score"), "id"))
    return found.select("anchor", F.col("part").cast("int").alias("part"), "id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def mine(table: DataFrame, anchors: str = "id % 100 = 0", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the first ``negatives``
    rows of other labels whose score is at most the positive's and at least its ``share``.

    Scores are inner products of floor(scale * vector); higher ones come first, ties by smaller id.  ``anchors`` is a condition on
    ``id`` and ``label``; an anchor's positives are the first rows but itself of its label.  Rows with a null id or label, or a vector that is null or
    holds a null or a number that is not finite, take no part; of repeated ids the least (label, vector) counts; a shorter
    vector ends in zeros; a score beyond 64 bits counts as the nearest number.  An empty table gives an empty result; other columns aren't read.
    """
    work = Workspace(table.sparkSession, "hard-negatives")
    rows = work.keep(vectors_of(table, id_col, label_col, vector_col), "rows")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    most = rows.agg(F.max(F.sqrt(norm)).alias("norm"), F.max(F.size("vector")).alias("size")).first()
    bound = (scale * (most.norm or 0.0) + math.sqrt(most.size or 0)) ** 2 * 1.001 + 1 if (most.norm or 0.0) < 1e100 else math.inf
    bound = int(min(bound, MOST))
    own = rows.where(anchors).select(F.col("id").alias("anchor"), "label", "vector")
    wide = own.select("anchor", F.lit(0).alias("part"), "label", "vector", F.lit(True).alias("same"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    found = work.keep(select_first(rows, wide, positives, work, "positives", scale), "positives")
    # share * score, rounded up, without overflow
    low = F.col("score") - F.expr(f"score div {share[1]}") * F.lit(share[1] - share[0]).cast("long") - F.floor((F.col("score") - F.expr(f"score div {share[1]}") * share[1]) * (share[1] - share[0]) / share[1])
    windows = found.join(own, "anchor").select("anchor", F.col("rank").alias("part"), "label", "vector", F.lit(False).alias("same"), low.cast("long").alias("lo"), F.col("score").alias("hi"))
    first = select_first(rows, windows, negatives, work, "negatives", scale)
    pairs = found.select("anchor", F.col("rank").alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = first.select("anchor", "part", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return first.join(pairs, ["anchor", "part"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
