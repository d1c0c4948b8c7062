"""Substring deduplication over a log-structured fingerprint index.

Anchors: of every window of ``window`` words, the run of ``gram`` words with the smallest hash (winnowing), so two equal windows
have equal anchors at equal places, and about one word in seven starts one.  The index keeps anchors as immutable runs, tables
bucketed and sorted by hash.  A new batch becomes a run, is merge-joined with the older runs and with itself, and what repeats is
verified on the texts: windows around repeated anchors are compared by the 128-bit digest of their words.  Runs of one
size are merged, as in a log-structured merge tree.  Whole copies of earlier texts are told by their digest and go as a whole, so
none of their anchors and windows is stored or sent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Workspace, frugal, row_of, spread_join
from .wordscan import PLAIN_WORDS, Hasher, Words, chunks, words

WINDOW = 20
GRAM = 8
HASHES = Hasher(0x5EED)
BUCKETS = 64
"""Buckets of an index's runs; for a corpus of 100 TB, tens of thousands."""
FAN_IN = 2
"""So many runs of one level are merged into one of the next."""
MET = 1 << 20
"""Windows that a task remembers at most before it starts afresh; that only makes it send some windows again."""
WHOLE = 1 << 30
"""The last window start of a range that has all windows of a text, however long."""


def anchors(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the word it starts at, the word its anchor starts at and the anchor's hash; the first smallest counts."""
    wide = window - gram + 1
    counts = np.diff(w.rows)
    n = np.maximum(counts - window + 1, 0)
    starts = np.repeat(w.rows[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    grams = HASHES.grams(HASHES.words(w.data, w.starts, w.ends), gram)
    best, at, reach = grams, np.arange(len(grams)), 1
    while reach < wide:  # the smallest of `reach` grams from each place, doubling
        step = min(reach, wide - reach)
        left, right = best[:-step], best[step:]
        worse = right < left
        best, at = np.where(worse, right, left), np.where(worse, at[step:], at[:-step])
        reach += step
    return starts, at[starts], best[starts]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (fp, id, n): each anchor hash of a document once, with the number of places it is an anchor at."""
    for b in batches:
        for chunk in chunks(b.column(1)):
            w = words(chunk, PLAIN_WORDS)
            _, at, fp = anchors(w)
            at, first = np.unique(at, return_index=True)
            row = np.searchsorted(w.rows, at, side="right") - 1
            order = np.lexsort((fp[first], row))
            row, fp = row[order], fp[first][order]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (fp[1:] != fp[:-1])))) if len(fp) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(fp)))
            ids = b.column(0).take(pa.array(row[new] + chunk.first))
            yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), ids, pa.array(np.minimum(n, 2).astype(np.int8))], names=["fp", "id", "n"])


class FingerprintIndex:
    """Sorted immutable runs of anchor hashes (fp, id, n), and the log of what repeats between them.

    Runs are tables in the session's catalogue, stored in the shared folder, bucketed and sorted by fp, so that a merge join of
    two runs shuffles neither.
    """

    def __init__(self, spark: SparkSession, work: Workspace, buckets: int = BUCKETS):
        self.spark, self.work, self.buckets = spark, work, buckets
        self.runs: list[tuple[int, str]] = []
        self.repeats: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        """Store a run.  Rows are dealt by bucket, so that each bucket is one file, written by one task."""
        name = f"inkwell_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, F.pmod(F.hash("fp"), F.lit(self.buckets)))
        dealt.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", f"{self.work.path}/{name}").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """Append a batch of (id, text): write its run, note the hashes that repeat in it or in older runs, and compact."""
        rows = batch.mapInArrow(frugal(_anchor_rows), f"fp bigint, id {batch.schema['id'].dataType.simpleString()}, n tinyint")
        name = self._write(rows)
        new = self.spark.table(name)
        found = new.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
        for _, old in self.runs:
            found = found.unionByName(new.join(self.spark.table(old).select("fp"), "fp", "left_semi").select("fp"))
        self.repeats.append(self.work.keep(found, f"repeats-{len(self.repeats)}"))
        self.runs.append((0, name))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(same := [r for r in self.runs if r[0] == level]) >= FAN_IN:
            merged = None
            for _, name in same:
                merged = self.spark.table(name) if merged is None else merged.unionByName(self.spark.table(name))
            name = self._write(merged)
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, name)]
            for _, old in same:
                self._forget(old)
            level += 1

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.work.drop(name)

    def candidates(self) -> DataFrame:
        """(id, fps): for each document with an anchor that repeats anywhere, those anchors' hashes."""
        repeated = self.repeats[0]
        for more in self.repeats[1:]:
            repeated = repeated.unionByName(more)
        repeated = repeated.distinct()
        hits = None
        for _, name in self.runs:
            part = self.spark.table(name).join(repeated, "fp", "left_semi").select("id", "fp")
            hits = part if hits is None else hits.unionByName(part)
        return hits.groupBy("id").agg(F.collect_list("fp").alias("fps"))

    def close(self) -> None:
        for _, name in self.runs:
            self._forget(name)
        self.runs = []


# --- verification -----------------------------------------------------------------------------------------------------


def _ranges(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge window starts, sorted by row and start, into ranges (row, first, last) of consecutive starts."""
    if not len(row):
        return row, start, start
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    return row[first], start[first], start[np.append(first[1:], len(row)) - 1]


WINDOW_SCHEMA = "fp bigint, digest bigint, id {id}, first int, last int, sure boolean"


def _window_rows(window: int, gram: int):
    """(id, text, fps), sorted by id, to windows whose anchor repeats.

    A window that this task has already met at a smaller (id, start) is surely a repeat and goes out as part of a range; all others
    go out by anchor and digest to be compared across tasks.  However often a passage occurs, a task sends it about once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], tuple[object, int]] = {}
        for b in batches:
            fps = b.column(2)
            flat = fps.flatten().to_numpy().view(np.uint64)
            cuts = np.concatenate(([0], np.cumsum(fps.value_lengths().to_numpy(zero_copy_only=False))))
            for chunk in chunks(b.column(1)):
                w = words(chunk, PLAIN_WORDS)
                starts, _, fp = anchors(w, window, gram)
                row = np.searchsorted(w.rows, starts, side="right") - 1
                edge = np.searchsorted(row, np.arange(chunk.last - chunk.first + 1))
                hit = np.zeros(len(starts), bool)
                for r in range(chunk.last - chunk.first):
                    own = flat[cuts[chunk.first + r] : cuts[chunk.first + r + 1]]
                    hit[edge[r] : edge[r + 1]] = np.isin(fp[edge[r] : edge[r + 1]], own)
                if not hit.any():
                    continue
                starts, row, fp = starts[hit], row[hit], fp[hit]
                view, digest = memoryview(w.data), xxhash.xxh64_intdigest
                h = np.fromiter((digest(view[x:y]) for x, y in zip(w.starts[starts].tolist(), w.ends[starts + window - 1].tolist(), strict=True)), np.uint64, len(starts))
                start = starts - w.rows[row]
                ids = b.column(0).slice(chunk.first, chunk.last - chunk.first).to_pylist()
                same = np.array([k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]])  # rows of one id are neighbours
                doc = np.searchsorted(same, row, side="right")
                if len(met) > MET:
                    met.clear()
                order = np.lexsort((start, doc, h, fp))
                lead = np.concatenate(([True], (fp[order][1:] != fp[order][:-1]) | (h[order][1:] != h[order][:-1])))
                top = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]  # the smallest (id, start) of each window
                sure = np.zeros(len(order), bool)
                sure[order] = (doc[order] != doc[top]) | (start[order] != start[top])
                out = np.zeros(len(order), bool)
                for k in order[lead].tolist():
                    key, place = (int(fp[k]), int(h[k])), (ids[row[k]], int(start[k]))
                    old = met.get(key)
                    if old is None or (old[0] == place[0] and place[1] < old[1]):
                        met[key], out[k] = place, True
                    elif old != place:
                        sure[k] = True
                r, f, l = _ranges(row[sure], start[sure])
                n, m = int(out.sum()), len(r)
                if n + m:
                    where = np.concatenate((row[out], r))
                    none = np.zeros(m, np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate((fp[out], mixed(r, f) if m else none)).view(np.int64)),
                            pa.array(np.concatenate((h[out], none)).view(np.int64)),
                            b.column(0).take(pa.array(where + chunk.first)),
                            pa.array(np.concatenate((start[out], f)).astype(np.int32)),
                            pa.array(np.concatenate((start[out], l)).astype(np.int32)),
                            pa.array(np.arange(n + m) >= n),
                        ],
                        names=["fp", "digest", "id", "first", "last", "sure"],
                    )

    return run


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spread-out key, so that ranges are dealt evenly."""
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ranges of an id become one, batch by batch."""
    for b in batches:
        code = b.column(0).dictionary_encode()
        row = np.where(code.indices.is_null().to_numpy(zero_copy_only=False), len(code.dictionary), code.indices.fill_null(0).to_numpy())
        first, last = b.column(1).to_numpy(), b.column(2).to_numpy()
        order = np.lexsort((first, row))
        row, first, last = row[order], first[order], last[order]
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)))) if len(row) else np.zeros(0, np.int64)
        ends = np.maximum.reduceat(last, new) if len(new) else last
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order[new])), pa.array(first[new]), pa.array(ends)], names=["id", "first", "last"])


def _cut(window: int, carried: int):
    """Batches have ``carried`` columns, then text and ranges of window starts; gives counts and the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, ranges = b.column(carried), b.column(carried + 1)
            size = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = ranges.flatten()
            first, last = (flat.field(k).to_numpy() for k in (0, 1)) if len(flat) else (np.zeros(0, np.int32),) * 2
            to = np.concatenate(([0], np.cumsum(size)))
            n_words, n_removed, kept, sha = [], [], [], []
            for chunk in chunks(text):
                w = words(chunk, PLAIN_WORDS)
                raw = w.data.tobytes()
                for i in range(chunk.last - chunk.first):
                    k, lo, hi = chunk.first + i, int(w.rows[i]), int(w.rows[i + 1])
                    x, y = int(w.bytes_[i]), int(w.bytes_[i + 1])
                    rest, gone = raw[x : max(x, y - 1)], 0
                    if size[k] and hi - lo >= window:
                        change = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(change, first[to[k] : to[k + 1]], 1)
                        np.add.at(change, np.minimum(last[to[k] : to[k + 1]] + window, hi - lo), -1)
                        out = np.cumsum(change[:-1]) > 0
                        gone = int(out.sum())
                        stays = np.repeat(~out, w.ends[lo:hi] - w.starts[lo:hi] + 1)
                        rest = w.data[x:y][stays].tobytes()[:-1]
                    n_words.append(hi - lo)
                    n_removed.append(gone)
                    kept.append(rest.decode() if gone else None)
                    sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:carried], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pc.coalesce(pa.array(kept, text.type), text), pa.array(sha, pa.string())],
                names=[*b.schema.names[:carried], "n_words", "n_removed", "kept", "sha"],
            )

    return run


def _copies(rows: DataFrame, work: Workspace) -> DataFrame:
    """The ids of (id, text) of which each text also is, whole, that of a smaller id: all of their windows start earlier there."""
    texts = work.keep(rows.where("text IS NOT NULL").select("id", F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    least = work.keep(texts.groupBy("sha").agg(F.min(F.struct("id")).alias("least"), F.count("*").alias("n")).where("n > 1"), "texts-again")
    later = spread_join(texts, least, ["sha"]).where(F.struct("id") > F.col("least")).select("id").distinct()
    mixed = texts.groupBy("id").agg(F.min("sha").alias("x"), F.max("sha").alias("y")).where("x <> y").select("id")  # rows that share an id
    return work.keep(later.join(mixed, "id", "left_anti"), "copies")


def remove_repeats(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of the columns ``carry``), n_words, n_removed, kept, kept_sha256.

    A word goes if a window of ``window`` words over it also starts at a smaller (id, start).  ``kept`` is the kept words joined by
    one space if any word went, else the text as it was.  The digest is of the kept words joined by one space in either case.

    Null and empty texts, and texts shorter than a window, lose nothing.  Rows that share an id are one document as to order: a
    window at the same start is not earlier.  A null id comes before all others.  Carried columns are in a struct of their own, so
    no name clashes.  An empty table gives an empty result.  The index takes the documents in ``batches`` dealt by a hash of the
    id; the result doesn't depend on it, since repeats are verified against all documents in the end.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    index = FingerprintIndex(spark, work, buckets)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    copies = _copies(rows, work)
    fresh = rows.join(copies, "id", "left_anti")
    for k in range(batches):
        index.add(fresh.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
    found = work.keep(index.candidates(), "candidates")
    index.close()

    # both joins below take the same columns, so that the texts are dealt by id once
    names = ["id" if c == id_col else f"c{k}" for k, c in enumerate(carry)]
    others = [(c, n) for c, n in zip(carry, names, strict=True) if n != "id"]
    all_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in others))
    id_type = rows.schema["id"].dataType.simpleString()
    near = all_.join(found.withColumnRenamed("id", "cid"), F.col("id").eqNullSafe(F.col("cid")))
    near = near.select("id", "text", "fps", *(n for _, n in others)).sortWithinPartitions("id")
    seen = near.mapInArrow(frugal(_window_rows(window, gram)), WINDOW_SCHEMA.format(id=id_type))
    least = F.min(F.struct("id", "first")).over(W.partitionBy("fp", "digest"))
    again = seen.repartition("fp", "digest").withColumn("least", least).where(F.col("sure") | (F.struct("id", "first") != F.col("least")))
    ranges = again.select("id", "first", "last").mapInArrow(frugal(_merge_ranges), f"id {id_type}, first int, last int")
    ranges = ranges.unionByName(copies.select("id", F.lit(0).alias("first"), F.lit(WHOLE).alias("last")))
    ranges = ranges.groupBy(F.col("id").alias("rid")).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = all_.join(ranges, F.col("id").eqNullSafe(F.col("rid")), "left").select(*names, "text", "ranges")
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema[: len(names)])
    out = joined.mapInArrow(frugal(_cut(window, len(names))), f"{carried}, n_words bigint, n_removed bigint, kept string, sha string")
    return out.select(row_of(carry, names), "n_words", "n_removed", "kept", F.col("sha").alias("kept_sha256"))
