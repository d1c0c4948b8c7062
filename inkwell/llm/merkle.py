"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Rows are range-sorted by group and order.  A prefix sum over the counts of each group in each partition tells every row's place in its group, so
each partition builds all nodes whose leaves it holds.  The nodes left at its ragged edges, a few for each level, are shuffled by
the coordinate of an ancestor, whose task builds on up to it; levels are finished so many at a time.  Siblings then go the same
way down, and each partition joins them to what it can tell by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, row_of

FAN = 3
ROWS = 1 << 15
"""Rows of a partition, about."""
JUMP = 12
"""Levels that an ancestor's task builds."""

PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
Pair = tuple[str, str]


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 of values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)), 256)


def proof_hash(path: Column) -> Column:
    """SHA-256 of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def join(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


class Subtrees:
    """What can be built from some nodes of one tree, level by level up to ``top``: ``nodes[level][place]``."""

    def __init__(self, total: int, top: int, given: dict[int, dict[int, str]]):
        self.total, self.nodes = total, {level: dict(x) for level, x in given.items()}
        width = total
        self.widths = []
        for level in range(top):
            self.widths.append(width)
            here = self.nodes.get(level, {})
            above = self.nodes.setdefault(level + 1, {})
            for parent in sorted({place // FAN for place in here}):
                run = [here.get(k) for k in range(FAN * parent, min(FAN * parent + FAN, width))]
                if None not in run:
                    above[parent] = join(run)
            width = -(-width // FAN)
        self.widths.append(width)

    def whole(self, level: int, place: int) -> bool:
        """Whether the node's parent was built."""
        return place // FAN in self.nodes.get(level + 1, ())

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """Nodes whose parents weren't built."""
        for level, here in self.nodes.items():
            for place, digest in here.items():
                if not self.whole(level, place):
                    yield level, place, digest

    def siblings(self, level: int, place: int) -> Pair:
        """Digests of the run's other nodes, before and after this one."""
        first = place // FAN * FAN
        here = self.nodes[level]
        return "".join(here[k] for k in range(first, place)), "".join(here[k] for k in range(place + 1, min(first + FAN, self.widths[level])))

    def way(self, level: int, place: int) -> list[Pair]:
        """Siblings from a node as far up as was built."""
        out = []
        while self.whole(level, place):
            out.append(self.siblings(level, place))
            level, place = level + 1, place // FAN
        return out


def _paths(paths: list[list[Pair]]) -> pa.Array:
    flat = [p for path in paths for p in path]
    pairs = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.string()), pa.array([b for _, b in flat], pa.string())], names=["left", "right"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int32)), pairs)


def _pairs(path: list[dict] | None) -> list[Pair]:
    return [(p["left"], p["right"]) for p in path or ()]


NODES = "g string, total bigint, level int, place bigint, digest string, pid bigint"
_NODES = pa.schema([("g", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("pid", pa.int64())])


def _runs(rows: pa.Table, context: pa.Table) -> Iterator[tuple[str, dict, np.ndarray, Subtrees]]:
    """Of each group in a partition: its name, its row of the context, its rows in order, and what they build."""
    at = np.argsort(rows["k"].to_numpy(), kind="stable")
    names, digests = rows["g"].take(pa.array(at)).to_pylist(), rows["leaf"].take(pa.array(at)).to_pylist()
    about = {r["g"]: r for r in context.to_pylist() if r["level"] is None}
    first = 0
    while first < len(names):
        last = first
        while last < len(names) and names[last] == names[first]:
            last += 1
        row = about[names[first]]
        leaves = dict(zip(range(row["start"], row["start"] + last - first), digests[first:last], strict=True))
        yield names[first], row, at[first:last], Subtrees(row["total"], height(row["total"]), {0: leaves})
        first = last


def _local(rows: pa.Table, context: pa.Table) -> pa.Table:
    """The largest subtrees that a partition can build."""
    out = []
    for g, row, _, built in _runs(rows, context):
        out += [(g, row["total"], level, place, digest, row["pid"]) for level, place, digest in built.ragged()]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _NODES, strict=True)], schema=_NODES) if out else _NODES.empty_table()


def _build(nodes: pa.Table, upto: int) -> tuple[dict, Subtrees, int]:
    rows = nodes.to_pylist()
    top = min(upto, height(rows[0]["total"]))
    given: dict[int, dict[int, str]] = {}
    for r in rows:
        given.setdefault(r["level"], {})[r["place"]] = r["digest"]
    return rows[0], Subtrees(rows[0]["total"], top, given), top


def _upwards(upto: int):
    """From all nodes below an ancestor, the ancestor."""

    def run(nodes: pa.Table) -> pa.Table:
        row, built, top = _build(nodes, upto)
        ((place, digest),) = built.nodes[top].items()
        return pa.Table.from_pylist([{"g": row["g"], "total": row["total"], "level": top, "place": place, "digest": digest, "pid": None}], schema=_NODES)

    return run


WAYS = f"g string, level int, place bigint, pid bigint, path {PATH}"


def _downwards(upto: int):
    """Of all nodes below an ancestor the siblings up to the root, from those of the ancestor."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        _, built, _ = _build(nodes, upto)
        rest = _pairs(above["path"][0].as_py())
        paths = [built.way(level, place) + rest for level, place in zip(nodes["level"].to_pylist(), nodes["place"].to_pylist(), strict=True)]
        return pa.table([nodes["g"], nodes["level"], nodes["place"], nodes["pid"], _paths(paths)], names=["g", "level", "place", "pid", "path"])

    return run


def _proofs(rows: pa.Table, context: pa.Table) -> pa.Table:
    """A partition's rows with place, group size, both roots and the siblings of each."""
    ways = {(r["g"], r["level"], r["place"]): _pairs(r["path"]) for r in context.to_pylist() if r["level"] is not None}
    at, places, paths, about = [], [], [], []
    for g, row, of, built in _runs(rows, context):
        start, tail = row["start"], _pairs(row["path"])
        rest = {(level, place): ways.get((g, level, place), []) + tail for level, place, _ in built.ragged()}
        up: dict[tuple[int, int], list[Pair]] = dict(rest)  # the way of a node, from the top of what was built down
        for level in range(height(row["total"]) - 1, -1, -1):
            for place in built.nodes.get(level, ()):
                if (level, place) not in up:
                    up[level, place] = [built.siblings(level, place), *up[level + 1, place // FAN]]
        at.append(of)
        places.append(np.arange(start, start + len(of)))
        paths += [up[0, k] for k in range(start, start + len(of))]
        about += [row] * len(of)
    order = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
    out = rows.drop_columns(["g", "k", "pid"]).take(order)
    for name, values in (("place", np.concatenate(places) if places else np.zeros(0, np.int64)), ("total", pa.array([r["total"] for r in about], pa.int64()))):
        out = out.append_column(name, pa.array(values))
    for name in ("subroot", "root"):
        out = out.append_column(name, pa.array([r[name] for r in about], pa.string()))
    return out.append_column("path", _paths(paths))


def _grown(leaves: DataFrame, order: list[str], work: Workspace, name: str, parts: int, jump: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of leaves (g, leaf, ``order`` and others): them sorted, with partition ``pid`` and row ``k``; (pid, g, start, total); (g, subroot); and the
    siblings of the partitions' ragged nodes."""
    keys = ["g", *order, "leaf", "_row"]  # rows alike but for the last are the same, and many of them can be parted
    rows = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row", *order)
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumns({"pid": F.shiftright("at", 33), "k": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    rows = work.keep(rows.drop("at"), f"{name}-sorted")
    own = W.partitionBy("g")
    counts = rows.groupBy("g", "pid").agg(F.count("*").alias("n"))  # hardly more rows than groups and partitions
    start = F.coalesce(F.sum("n").over(own.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = work.keep(counts.select("pid", "g", start.alias("start"), F.sum("n").over(own).alias("total")), f"{name}-offsets")
    most = height(counts.agg(F.max("total")).first()[0] or 0)
    powers = F.array(*(F.lit(FAN**k).cast("long") for k in range(max(most, 1) + jump)))

    given = counts.withColumn("level", F.lit(None).cast("int"))
    nodes = work.keep(rows.select("g", "leaf", "pid", "k").groupBy("pid").cogroup(given.groupBy("pid")).applyInArrow(_local, NODES), f"{name}-0")
    rounds = []
    for upto in range(jump, most + jump, jump):
        done = F.col("level") >= F.least(F.lit(upto), F.size(F.filter(powers, lambda x: x < F.col("total"))))
        span = F.element_at(powers, F.lit(upto) - F.col("level") + 1)
        below = nodes.where(~done).withColumn("ancestor", ((F.col("place") - F.col("place") % span) / span).cast("long"))
        below = work.keep(below, f"{name}-below-{upto}")
        made = below.groupBy("g", "ancestor").applyInArrow(_upwards(upto), NODES)
        nodes = work.keep(nodes.where(done).unionByName(made), f"{name}-{upto}")
        rounds.append((upto, below))
    roots = nodes.select("g", F.col("digest").alias("subroot"))

    ways = nodes.select("g", "level", "place", "pid", F.array().cast(PATH).alias("path"))
    for upto, below in reversed(rounds):
        here = F.col("pid").isNull() & (F.col("level") > upto - jump) & (F.col("level") <= upto)  # the ancestors of this round
        above = ways.where(here).select("g", F.col("place").alias("ancestor"), "path")
        found = below.groupBy("g", "ancestor").cogroup(above.groupBy("g", "ancestor")).applyInArrow(_downwards(upto), WAYS)
        ways = work.keep(ways.where(~here).unionByName(found), f"{name}-ways-{upto}")
    return rows, counts, roots, ways.where("pid IS NOT NULL")


def _proven(grown: tuple[DataFrame, DataFrame, DataFrame, DataFrame], top: DataFrame) -> DataFrame:
    """The leaves with place, total, subroot, root and path; ``top`` has (g, root, path) from the subroots on."""
    rows, counts, roots, ways = grown
    about = counts.join(roots, "g").join(top, "g").select("pid", "g", "start", "total", "subroot", "root", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("place"), "path")
    none = {"start": "long", "total": "long", "subroot": "string", "root": "string"}
    context = about.unionByName(ways.select("pid", "g", *(F.lit(None).cast(kind).alias(n) for n, kind in none.items()), "level", "place", "path"))
    kept = [f for f in rows.schema if f.name not in ("g", "k", "pid")]
    more = [("place", T.LongType()), ("total", T.LongType()), ("subroot", T.StringType()), ("root", T.StringType())]
    schema = T.StructType([*kept, *(T.StructField(n, kind) for n, kind in more), T.StructField("path", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("left", "right")])))])
    return rows.groupBy("pid").cogroup(context.groupBy("pid")).applyInArrow(_proofs, schema)


def manifest(table: DataFrame, group: str, order: list[str], leaf: str, carry: list[str], rows_a_partition: int = ROWS, jump: int = JUMP) -> DataFrame:
    """One row for each row of ``table``: row (a struct of the columns ``carry``), leaf, place and total (its place in its group, from 0, and the
    group's size), subroot, root, and path, its proof: of each level from the leaf to the root the siblings before and after, end to end.

    ``leaf`` names a column of hexadecimal digests.  Leaves of a group ascend by ``order``, nulls first; while there are several, each
    three in a row, the last ones of a row maybe fewer or even one alone, become the SHA-256 of their digests.  The groups' subroots, ascending by the
    group as text, nulls first, become the root in the same way.  A lone leaf is its subroot, a lone subroot the root.  Rows that are equal in
    group and order stand by leaf; repeated rows are rows like any other.  No other column is read.  An empty table gives an empty result.
    """
    spark = table.sparkSession
    work = Workspace(spark, "merkle")
    keys, names = [f"o{k}" for k in range(len(order))], [f"c{k}" for k in range(len(carry))]
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all others, and never null
    leaves = table.select(g.alias("g"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.col(leaf).alias("leaf"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    leaves = work.keep(leaves, "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // rows_a_partition))
    grown = _grown(leaves, keys, work, "leaves", parts, jump)

    subroots = work.keep(grown[2].select(F.lit("").alias("g"), F.col("subroot").alias("leaf"), F.col("g").alias("o0"), F.col("g").alias("name")), "subroots")
    upper = _grown(subroots, ["o0"], work, "subroots", max(1, -(-subroots.count() // rows_a_partition)), jump)
    above = upper[2].select("g", F.col("subroot").alias("root"), F.array().cast(PATH).alias("path"))
    top = work.keep(_proven(upper, above).select(F.col("name").alias("g"), "root", "path"), "top")
    return _proven(grown, top).select(row_of(carry, names), "leaf", "place", "total", "subroot", "root", "path")
