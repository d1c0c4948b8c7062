"""SimHash near-duplicate detection with sharded BK-trees.

A fingerprint is 64 bits: a bit is set if it is set in over half of the XXH64 values of a text's word shingles.  Two
fingerprints within ``radius`` bits agree on all but ``radius`` of any larger number of bit blocks, so fingerprints that agree
on the same blocks form a shard, and a BK-tree in each shard finds the links.  A shard's tree stays in the task that holds the
shard.  Trees are not broadcast: that takes the fingerprints of all documents through the driver, which no job may do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import Workspace, carried, frugal, spread_join
from .wordscan import LOWER_WORDS, Chunk, chunks, words
from .xxh64 import xxh64

SEED = 42
SHINGLE = 3
RADIUS = 3
HOT_SHARD = 4096
"""Shards with more distinct fingerprints are cut again by the bits on which they don't have to agree."""


def _spread() -> np.ndarray:
    """For each byte value, its bits as eight separate bytes of one uint64."""
    bits = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)
    return (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


def fingerprints(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A fingerprint for each row, from hashes[rows[i]:rows[i + 1]]; a row without hashes gets zero.

    Bits are counted eight at a time in byte lanes over at most 255 hashes, then summed for the row.
    """
    count = np.diff(rows)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    parts = -(-count[full] // 255)
    firsts = np.concatenate(([0], np.cumsum(parts)))
    cuts = np.repeat(rows[full], parts) + 255 * (np.arange(firsts[-1]) - np.repeat(firsts[:-1], parts))
    lanes = np.add.reduceat(_spread()[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), firsts[:-1], axis=0)
    set_ = (2 * ones > count[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of ``size`` words, and where each text's begin; a shorter text has one, all its words."""
    w = words(chunk, LOWER_WORDS)
    n = np.diff(w.rows)
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    rows = np.concatenate(([0], np.cumsum(shingles)))
    first = np.arange(rows[-1]) - np.repeat(rows[:-1], shingles) + np.repeat(w.rows[:-1], shingles)
    last = first + np.repeat(np.minimum(n, size), shingles) - 1
    return xxh64(w.data, w.starts[first], w.ends[last], SEED), rows


def text_fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text of an Arrow column, as int64."""
    done = [fingerprints(*shingle_hashes(chunk, SHINGLE)) for chunk in chunks(column)]
    return np.concatenate(done).view(np.int64) if done else np.zeros(0, np.int64)


def with_key(docs: DataFrame, carry: list[str], text_col: str, key: Callable[[pa.Array], np.ndarray]) -> tuple[DataFrame, list[str]]:
    """The columns ``carry`` and ``key``, a 64-bit number that ``key`` gives each text, and the names that the former have here."""
    rows, names, text_at = carried(docs, carry, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(key(b.column(text_at)))], names=[*names, "key"])

    return rows.mapInArrow(frugal(scan), T.StructType([*list(rows.schema)[: len(names)], T.StructField("key", T.LongType())])), names


# --- shards and trees -------------------------------------------------------------------------------------------------


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks that deal the given bits into n blocks."""
    return [sum(1 << b for b in part) for part in np.array_split(np.array(bits), n) for part in [part.tolist()]]


def _masks(radius: int, blocks: int) -> list[int]:
    """For each choice of ``blocks - radius`` of the blocks, the bits on which a shard's fingerprints agree."""
    each = _blocks(list(range(64)), blocks)
    return [sum(pick) for pick in combinations(each, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _shard_rows(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(masks)))
    return fps.select("fp", F.explode(keys).alias("s")).select("fp", "s.k", "s.v")


def _cut_again(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Cut hot shards by blocks of their remaining bits: a pair within the radius agrees on one of radius + 1 such blocks too."""
    out = None
    for k, mask in enumerate(masks):
        rest = [b for b in range(64) if not mask >> b & 1]
        subs = F.array(*(F.struct(F.lit(len(masks) + k * (radius + 1) + i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask | m))).alias("v")) for i, m in enumerate(_blocks(rest, radius + 1))))
        part = rows.where(F.col("k") == k).select("fp", F.explode(subs).alias("s")).select("fp", "s.k", "s.v")
        out = part if out is None else out.unionByName(part)
    return out


class Links:
    """A union-find over fingerprints that remembers which pairs were linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def link_small(fps: list[int], radius: int, links: Links) -> None:
    """Insert fingerprints into a BK-tree one after another; each first searches the tree along edges within the radius."""
    root = (fps[0], {})
    for x in fps[1:]:
        todo = [root]
        while todo:
            y, kids = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                links.add(x, y)
            todo += [kid for e, kid in kids.items() if -radius <= d - e <= radius]
        at, d = root, (x ^ root[0]).bit_count()
        while (kid := at[1].get(d)) is not None:
            at, d = kid, (x ^ kid[0]).bit_count()
        at[1][d] = (x, {})


def link_large(fps: np.ndarray, radius: int, links: Links) -> None:
    """The same tree for a large shard, built top down; all searches that reach a node are carried out together.

    A node's subtree at edge e holds exactly the fingerprints at distance e.  Searches that have found their node's group
    already linked add nothing, so a dense group yields a spanning tree, not all its pairs.
    """
    group = np.arange(len(fps))
    done = np.zeros(len(fps), bool)
    everyone = np.arange(len(fps))
    todo = [(everyone, everyone)]
    while todo:
        members, asking = todo.pop()
        top, members = members[0], members[1:]
        done[top] = True
        asking = asking[~done[asking]]
        if not len(asking):
            continue
        d = np.bitwise_count(fps[asking] ^ fps[top]).astype(np.int64)
        near = asking[d <= radius]
        for g in np.unique(group[near]).tolist():
            if g != group[top]:
                links.add(int(fps[near[np.argmax(group[near] == g)]]), int(fps[top]))
                group[group == g] = group[top]
        if len(members):
            edge = np.bitwise_count(fps[members] ^ fps[top])
            for e in np.unique(edge).tolist():
                ask = asking[np.abs(d - e) <= radius]
                if len(ask):
                    todo.append((members[edge == e], ask))


def _link_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held, key = Links(), [], None

        def close() -> None:
            fps = np.unique(np.concatenate(held)) if held else ()
            if len(fps) > 64:
                link_large(fps, radius, links)
            elif len(fps) > 1:
                link_small(fps.tolist(), radius, links)

        for b in batches:
            k, v, fp = (b.column(i).to_numpy() for i in range(3))
            if not len(k):
                continue
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                if (k[lo], v[lo]) != key:
                    close()
                    held, key = [], (k[lo], v[lo])
                held.append(fp[lo:hi])
        close()
        pairs = [(x, links.root(x)) for x in list(links.up)]
        a, b = (np.array([p[i] for p in pairs if p[0] != p[1]], np.uint64).view(np.int64) for i in (0, 1))
        for lo in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + (1 << 16)]), pa.array(b[lo : lo + (1 << 16)])], names=["a", "b"])

    return run


def links(fps: DataFrame, n: int, radius: int = RADIUS, hot: int = HOT_SHARD) -> DataFrame:
    """Spanning links (a, b) between the ``n`` distinct fingerprints of column fp within ``radius`` bits; no component is missed.

    The number of blocks follows n so that a shard holds a few hundred fingerprints however large the corpus is: with 4, 5 or 6
    blocks and radius 3, shards agree on 16, 25 or 32 bits.
    """
    blocks = radius + 1
    while blocks < radius + 4 and n > 1 << (64 * (blocks - radius) // blocks + 6):
        blocks += 1
    masks = _masks(radius, blocks)
    rows = _shard_rows(fps, masks)
    hot_keys = rows.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", "v")
    cold, cut = rows.join(hot_keys, ["k", "v"], "left_anti"), rows.join(hot_keys, ["k", "v"], "left_semi")
    dealt = cold.unionByName(_cut_again(cut, masks, radius)).select("k", "v", "fp").repartition("k", "v").sortWithinPartitions("k", "v")
    return dealt.mapInArrow(frugal(_link_shards(radius)), "a bigint, b bigint")


def fingerprint_groups(docs: DataFrame, id_col: str, text_col: str, work: Workspace, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (id, key), the fingerprint of every text, and (key, part) for each fingerprint, its component's smallest one."""
    keyed, (name,) = with_key(docs, [id_col], text_col, text_fingerprints)
    rows = work.keep(keyed.select(F.col(name).alias("id"), "key"), "rows")
    keys = work.keep(rows.select(F.col("key").alias("fp")).distinct(), "keys")
    found = connected_components(links(keys, keys.count(), radius), work)
    parts = keys.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(F.col("fp").alias("key"), F.coalesce("component", "fp").alias("part"))
    return rows, work.keep(parts, "parts")


def named(rows: DataFrame, parts: DataFrame, work: Workspace) -> DataFrame:
    """The rows (id, key) with component_id, the smallest id of their component, null only if all its ids are."""
    keys = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).join(parts, "key")
    least = keys.groupBy("part").agg(F.min("least").alias("component_id"))
    return spread_join(rows, work.keep(keys.join(least, "part").select("key", "n", "component_id"), "named"), ["key"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Only the two named columns are read, so further columns never clash.  Null and empty texts have fingerprint zero and link
    like any other.  Repeated rows give repeated results.  A row with a null id takes part and keeps a null id; it never is a
    component_id, which is null only if all ids of a component are.  An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows, parts = fingerprint_groups(docs, id_col, text_col, work, radius)
    return named(rows, parts, work).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., tuple[DataFrame, DataFrame]] = fingerprint_groups, key: Callable[[pa.Array], np.ndarray] = text_fingerprints) -> DataFrame:
    """The rows of ``docs`` but near copies, which ``find`` and ``key`` tell: of each component one row stays, with all its columns.

    It is the row with the smallest id, a null id counting as the largest; of several with this id that with the smallest key; of
    several with this key too that with the smallest hash of all its columns.  So rows that share an id or have none are told
    apart by their texts, and no text goes without a near copy that stays.  An empty table gives an empty one.  Columns that
    can't be hashed (maps) are not supported.
    """
    work = Workspace(docs.sparkSession, "one-of-each")
    rows, parts = find(docs, id_col, text_col, work)
    each = rows.groupBy("key", "id").agg(F.count("*").alias("n"))
    first = each.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("first"))
    stays = first.join(parts, "key").groupBy("part").agg(F.min("first").alias("f")).select(F.col("f.id").alias("sid"), F.col("f.key").alias("skey"), "f.n")
    stays = work.keep(stays, "stays")
    work.drop("rows", "keys", "parts")

    keyed, names = with_key(docs, docs.columns, text_col, key)
    own = names[docs.columns.index(id_col)]

    def staying(some: DataFrame) -> DataFrame:
        some = some.select("sid", "skey")
        return keyed.join(some, (F.col("key") == F.col("skey")) & F.col(own).eqNullSafe(F.col("sid")), "left_semi")

    kept = staying(stays.where("n = 1")).select(*names)
    if not stays.where("n > 1").isEmpty():  # repeated rows, or texts with one key under one id
        least = staying(stays.where("n > 1")).groupBy("key", own).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("r"))
        kept = kept.unionByName(least.select("r.*"))
    return kept.toDF(*docs.columns)
