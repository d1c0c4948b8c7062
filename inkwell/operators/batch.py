"""Ranked search for a table of queries, as one plan: query terms are joined with postings, and each query's best documents are kept.

Queries of one or two words are met by block of documents: each distinct one once, and only its best of a block leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..plans.query import parse
from ..sources.store import Kept
from .index import Index, postings_of
from .search import idf, min_span

_STRINGS = T.ArrayType(T.StringType())
_WORD = T.StructType([T.StructField("term", T.StringType()), T.StructField("offset", T.IntegerType())])
ASKED = T.StructType(
    [
        *(T.StructField(n, _STRINGS) for n in ("terms", "title_terms", "excluded", "tags")),
        T.StructField("phrases", T.ArrayType(T.ArrayType(_WORD))),
        T.StructField("expansions", T.MapType(T.StringType(), _STRINGS)),
    ]
)


def asked(queries: DataFrame, text: str = "text", expand: bool = True, stemmed: bool = True) -> DataFrame:
    """Add what each query text asks for: the columns of ASKED.  A null text is blank."""

    @F.pandas_udf(ASKED)
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = [parse(t or "", expand, stemmed) for t in texts]
            rows = [{"phrases": [[{"term": t, "offset": o} for t, o in p] for p in q.phrases]} | {n: getattr(q, n) for n in ASKED.names if n != "phrases"} for q in found]
            yield pd.DataFrame(rows, columns=ASKED.names)

    return queries.withColumn("_asked", parsed(text)).select(*queries.columns, "_asked.*")


def _phrase(hits: Column, phrase: Column, name: str) -> Column:
    """Whether a field has the words of a phrase at their offsets."""

    def starts(word: Column) -> Column:
        places = F.get(F.filter(hits, lambda h: h["term"] == word["term"]), 0)[name]
        return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda p: p - word["offset"])

    return F.size(F.aggregate(F.slice(phrase, 2, F.size(phrase)), starts(F.get(phrase, 0)), lambda a, w: F.array_intersect(a, starts(w)))) > 0


def score_many(index: Index, queries: DataFrame, key: str = "query") -> DataFrame:
    """(key, doc_id, score, matched_terms) of every document that matches a query, as ``search.score`` gives them for one.

    ``queries`` has a unique ``key`` and the columns of ASKED.  No term is a constant of the plan, which is the same for any number of queries.
    """
    flat = F.flatten(F.transform("phrases", lambda p: F.transform(p, lambda w: w["term"])))
    asked_ = queries.select(F.col(key).alias("_query"), *ASKED.names).withColumn("positive", F.array_distinct(F.concat("terms", "title_terms", flat)))
    asked_ = asked_.withColumns({
        "extra": F.array_except(F.flatten(F.map_values("expansions")), "positive"),
        "core": F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.col("positive")),
    })
    wanted = F.array_distinct(F.concat("positive", "extra", "excluded"))
    banned, extra = F.array_contains("excluded", F.col("term")), ~F.array_contains("positive", F.col("term"))
    terms = asked_.select("_query", "excluded", "positive", F.explode(wanted).alias("term"))
    terms = terms.select("_query", "term", banned.alias("banned"), F.when(extra, lx.EXPANSION_WEIGHT).otherwise(1.0).alias("weight"))
    terms = terms.join(index.terms, "term")  # a term without documents matches none

    found = terms.join(index.postings, "term").groupBy("_query", "doc_id").agg(
        F.collect_list(F.struct("term", "weight", "df", "title", "body")).alias("hits"), F.max("banned").alias("banned")
    ).where(~F.col("banned"))
    corpus = index.stats.select(
        F.greatest("doc_count", F.lit(1)).alias("n"),
        F.greatest(F.col("title_len") / F.greatest("doc_count", F.lit(1)), F.lit(1.0)).alias("avg_title"),
        F.greatest(F.col("body_len") / F.greatest("doc_count", F.lit(1)), F.lit(1.0)).alias("avg_body"),
    )
    documents = index.documents.select("doc_id", F.col("tags").alias("own_tags"), "title_len", "body_len")
    rows = found.join(documents, "doc_id").join(asked_, "_query").crossJoin(F.broadcast(corpus))  # one row
    hits, core = F.col("hits"), F.col("core")

    fits = F.size(F.array_except("tags", "own_tags")) == 0
    fits &= F.forall("title_terms", lambda t: F.exists(hits, lambda h: (h["term"] == t) & (F.size(h["title"]) > 0)))
    fits &= F.forall("phrases", lambda p: _phrase(hits, p, "title") | _phrase(hits, p, "body"))
    rows = rows.where(fits)

    norm_title = 1 - lx.TITLE_B + lx.TITLE_B * F.col("title_len") / F.col("avg_title")
    norm_body = 1 - lx.BODY_B + lx.BODY_B * F.col("body_len") / F.col("avg_body")

    def weighed(h: Column) -> Column:
        tf = lx.TITLE_WEIGHT * F.size(h["title"]) / norm_title + lx.BODY_WEIGHT * F.size(h["body"]) / norm_body
        return h["weight"] * idf(h["df"], F.col("n")) * tf / (lx.K1 + tf)

    have = F.transform(hits, lambda h: h["term"])
    met = F.size(F.filter(core, lambda c: F.array_contains(have, c) | F.coalesce(F.arrays_overlap(F.col("expansions")[c], have), F.lit(False))))
    total = F.aggregate(hits, F.lit(0.0), lambda a, h: a + weighed(h))
    total = total * F.when(F.size(core) > 0, lx.COVERAGE_FLOOR + (1 - lx.COVERAGE_FLOOR) * F.pow(met / F.size(core), F.lit(2))).otherwise(1.0)
    lists = F.transform(F.filter(hits, lambda h: F.array_contains(core, h["term"])), lambda h: h["body"])
    total = total + F.when(F.size(core) > 1, F.coalesce(lx.PROXIMITY_WEIGHT * F.size(lists) / min_span(lists), F.lit(0.0))).otherwise(0.0)

    def bonus(p: Column) -> Column:
        idfs = F.transform(p, lambda w: idf(F.get(F.filter(hits, lambda h: h["term"] == w["term"]), 0)["df"], F.col("n")))
        return lx.PHRASE_BONUS * F.aggregate(idfs, F.lit(0.0), lambda a, x: a + x) / F.size(p)

    total = total + F.aggregate(F.transform("phrases", bonus), F.lit(0.0), lambda a, x: a + x)
    matched = F.array_sort(F.filter("positive", lambda t: F.array_contains(have, t)))
    scored = rows.select("_query", "doc_id", total.alias("score"), matched.alias("matched_terms"))

    # queries of tags alone: documents are met by the first tag
    browse = asked_.where((F.size(wanted) == 0) & (F.size("tags") > 0)).select("_query", "tags", F.get("tags", F.lit(0)).alias("tag"))
    tagged = documents.select("doc_id", "own_tags", F.explode("own_tags").alias("tag"))
    met_by_tag = browse.join(tagged, "tag").where(F.size(F.array_except("tags", "own_tags")) == 0)
    none = F.array().cast("array<string>")
    scored = scored.unionByName(met_by_tag.select("_query", "doc_id", F.lit(1.0).alias("score"), none.alias("matched_terms")))
    return scored.withColumnRenamed("_query", key)


# --- queries of one or two words --------------------------------------------------------------------------------------

BLOCK = 1 << 14
"""Documents, about, whose postings meet in one task."""
CHUNK = 1 << 20
"""Distinct queries, about, that meet a block in one task."""
TURN = 1 << 14
"""Queries whose best are held at once."""
TOPS = 1 << 14
"""Terms whose best documents are remembered at once."""
FOUND = "a string, b string, doc_id bigint, score double, met int"
_NONE = np.zeros(0, np.int64)


def _nearest(at: np.ndarray, n: np.ndarray, places: np.ndarray, other_at: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """For each k: the fewest words that hold one of places[at[k]:][:n[k]] and one of places[other_at[k]:][:other_n[k]]; inf if either is empty."""
    starts, sizes = np.concatenate([at, other_at]), np.concatenate([n, other_n])
    each = np.repeat(np.arange(len(starts)), sizes)
    own = each % len(at)
    value = places[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(each))]
    order = np.lexsort((value, own))
    own, value, side = own[order], value[order], (each >= len(at))[order]
    next_to = np.flatnonzero((own[1:] == own[:-1]) & (side[1:] != side[:-1]))  # the nearest two stand side by side
    out = np.full(len(at), np.inf)
    np.minimum.at(out, own[next_to], value[next_to + 1] - value[next_to] + 1)
    return out


class _Block:
    """The postings of a block of documents, by number of the term and by document; those that come are held without their terms' texts."""

    def __init__(self):
        self.code, self.parts = {}, []

    def add(self, b: pa.RecordBatch) -> None:
        """Postings (cell, term, _, doc_id, tf, _, body)."""
        term, body = b.column(1).dictionary_encode(), b.column(6)
        own = np.array([self.code.setdefault(t, len(self.code)) for t in term.dictionary.to_pylist()], np.int32)
        many = np.diff(body.offsets.to_numpy()).astype(np.int32)
        self.parts.append((own[term.indices.to_numpy()], b.column(3).to_numpy(), b.column(4).to_numpy().copy(), many, body.flatten().to_numpy().copy()))

    def close(self) -> None:
        """All have come."""
        parts, self.parts = self.parts or [(np.zeros(0, np.int32), _NONE, np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32))], []
        self.ids = np.unique(np.concatenate([np.unique(p[1]) for p in parts]))
        self.rank = np.argsort(np.argsort(self.ids.astype(str)))  # ties go by the id as text
        n = max(len(self.ids), 1)
        key = np.concatenate([p[0].astype(np.int64) * n + np.searchsorted(self.ids, p[1]) for p in parts])
        tf, many, self.places = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        del parts
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.starts = np.searchsorted(key, np.arange(len(self.code) + 1) * n)
        self.doc = (key % n).astype(np.int32)
        self.tf = tf[order]
        self.at = (np.cumsum(many, dtype=np.int64) - many)[order]
        self.many = many[order]
        self.tops: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.place = np.full(len(self.ids), -1)

    def rows(self, t: int) -> slice:
        return slice(self.starts[t], self.starts[t + 1]) if t >= 0 else slice(0, 0)

    def top(self, t: int, idf_: float, factor: float, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of those with one term: no other without a second term can be among a query's best."""
        if (t, factor) not in self.tops:
            own = self.rows(t)
            value = idf_ * self.tf[own] / (lx.K1 + self.tf[own]) * factor
            some = np.flatnonzero(value >= np.partition(value, -size)[-size]) if len(value) > size else np.arange(len(value))
            some = some[np.lexsort((self.rank[self.doc[own][some]], -value[some]))[:size]]
            if len(self.tops) >= TOPS:
                self.tops.clear()
            self.tops[t, factor] = self.doc[own][some], value[some]
        return self.tops[t, factor]

    def best(self, queries: pa.RecordBatch, size: int) -> pa.RecordBatch:
        """Queries (cell, a, b, _, idf_a, idf_b, _), of which b may be null, to FOUND: each one's ``size`` best."""
        doc, tf, starts, place, top, rows = self.doc, self.tf, self.starts, self.place, self.top, self.rows
        part = [lx.COVERAGE_FLOOR + (1 - lx.COVERAGE_FLOOR) * (met / 2) ** 2 for met in (1, 2)]
        a, b = (np.array([self.code.get(t, -1) for t in queries.column(k).to_pylist()], np.int64) for k in (1, 2))
        single = queries.column(2).is_null().to_numpy(zero_copy_only=False)
        idf_a, idf_b = (queries.column(k).to_numpy() for k in (4, 5))
        found: list[list[np.ndarray]] = [[_NONE], [_NONE], [np.zeros(0)], [_NONE]]

        def tell(k: int, docs: np.ndarray, score: np.ndarray, met: np.ndarray) -> None:
            best = np.lexsort((self.rank[docs], -score))[:size]
            for column, x in zip(found, (np.full(len(best), k), docs[best], score[best], met[best]), strict=True):
                column.append(x)

        n = np.diff(starts)
        count = [np.where(x >= 0, n[x] if len(n) else 0, 0) for x in (a, b)]
        more = np.where(count[0] >= count[1], a, b)  # the more frequent term
        last = -1
        for k in np.argsort(more, kind="stable").tolist():
            if single[k]:
                docs, value = top(int(a[k]), idf_a[k], 1.0, size)
                tell(k, docs, value, np.full(len(docs), 1))
                continue
            if more[k] != last:
                place[doc[rows(last)]] = -1
                last = int(more[k])
                place[doc[rows(last)]] = np.arange(starts[last], starts[last + 1]) if last >= 0 else _NONE
            swapped = more[k] != a[k]
            less, idfs = (int(a[k]), (idf_b[k], idf_a[k])) if swapped else (int(b[k]), (idf_a[k], idf_b[k]))
            own = rows(less)
            other = place[doc[own]]
            both = np.flatnonzero(other >= 0)
            x, y = other[both], both + own.start
            score = (idfs[0] * tf[x] / (lx.K1 + tf[x]) + idfs[1] * tf[y] / (lx.K1 + tf[y])) * part[1]
            if len(both) > size:  # places add PROXIMITY_WEIGHT at most
                may = np.flatnonzero(score + lx.PROXIMITY_WEIGHT * (1 + 1e-9) >= np.partition(score, -size)[-size])
                x, y, score = x[may], y[may], score[may]
            if len(x):
                score = score + lx.PROXIMITY_WEIGHT * 2 / _nearest(self.at[x], self.many[x], self.places, self.at[y], self.many[y])
            columns = [(doc[x], score, np.full(len(x), 3))]
            for t, value, bit in ((last, idfs[0], 2 if swapped else 1), (less, idfs[1], 1 if swapped else 2)):
                docs, alone = top(t, value, part[0], size)
                at_other = own if t == last else rows(last)
                without = ~np.isin(docs, doc[at_other]) if t == last else place[docs] < 0
                columns.append((docs[without], alone[without], np.full(without.sum(), bit)))
            tell(k, *map(np.concatenate, zip(*columns, strict=True)))
        place[doc[rows(last)]] = -1
        k, docs, score, met = map(np.concatenate, found)
        names = [queries.column(c).take(pa.array(k)) for c in (1, 2)]
        return pa.RecordBatch.from_arrays([*names, pa.array(self.ids[docs], pa.int64()), pa.array(score), pa.array(met, pa.int32())], names=["a", "b", "doc_id", "score", "met"])


def _best_of_block(size: int):
    """Of a block's postings and some queries each one's ``size`` best."""

    def run(postings: _Block, queries: pa.RecordBatch) -> pa.RecordBatch:
        return postings.best(queries, size)

    return run


def _best_of_blocks(size: int):
    """Rows (cell, a, b, doc_id, x, y, body), sorted by cell, to FOUND.  An even cell has the postings of a block, the next one the queries that meet them."""

    best = _best_of_block(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, closed = None, None, False
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if lo == hi:
                    continue
                if cell[lo] // 2 != number:
                    block, number, closed = None, cell[lo] // 2, False  # the one before goes first
                    block = _Block()
                if cell[lo] % 2 == 0:
                    block.add(batch.slice(lo, hi - lo))
                    continue
                if not closed:
                    block.close()
                    closed = True
                for k in range(lo, hi, TURN):
                    yield best(block, batch.slice(k, min(TURN, hi - k)))

    return run


def _search_short(index: Index, queries: DataFrame, size: int, key: str, kept: Kept) -> DataFrame:
    """``search_many`` for queries of one or two different ``terms`` and nothing else.

    Of the documents with one of two terms only the best by that term can be among a query's best, since a second term adds to the
    score; those with both are met in their block, where the shortest spans are looked at only if they can matter.
    """
    queries = queries.select(key, F.array_sort("terms").alias("t")).select(key, F.col("t")[0].alias("a"), F.get("t", F.lit(1)).alias("b"))
    shapes = kept.keep(queries.select("a", "b").distinct(), "shapes")
    wanted = shapes.select(F.explode(F.array("a", "b")).alias("term")).where("term IS NOT NULL").distinct()
    lengths = ("title_len", "body_len")
    if index.built:
        postings = postings_of(index.documents, index.stemmed, more=lengths)
    else:
        postings = index.postings.join(index.documents.select("doc_id", *lengths), "doc_id")
    corpus = kept.keep(index.stats.select(
        F.greatest("doc_count", F.lit(1)).alias("n"),
        F.greatest(F.col("title_len") / F.greatest("doc_count", F.lit(1)), F.lit(1.0)).alias("avg_title"),
        F.greatest(F.col("body_len") / F.greatest("doc_count", F.lit(1)), F.lit(1.0)).alias("avg_body"),
    ), "corpus")
    norm_title = 1 - lx.TITLE_B + lx.TITLE_B * F.col("title_len") / F.col("avg_title")
    norm_body = 1 - lx.BODY_B + lx.BODY_B * F.col("body_len") / F.col("avg_body")
    tf = lx.TITLE_WEIGHT * F.size("title") / norm_title + lx.BODY_WEIGHT * F.size("body") / norm_body
    postings = postings.join(wanted, "term", "left_semi").crossJoin(F.broadcast(corpus)).select("term", "doc_id", tf.alias("tf"), "body")
    postings = kept.keep(postings, "postings")

    blocks = max(1, -(-corpus.first().n // BLOCK))
    chunks = max(1, -(-shapes.count() // CHUNK))
    counts = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus)).select("term", idf(F.col("df"), F.col("n")).alias("idf"))
    counts = kept.keep(counts, "counts")
    for x in "ab":
        shapes = shapes.join(counts.select(F.col("term").alias(x), F.col("idf").alias(f"idf_{x}")), x, "left")
    shapes = shapes.select("a", "b", F.coalesce("idf_a", F.lit(0.0)).alias("idf_a"), F.coalesce("idf_b", F.lit(0.0)).alias("idf_b"))
    shapes = shapes.withColumn("chunk", F.pmod(F.xxhash64("a", "b"), F.lit(chunks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    cells = postings.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    cell = (F.col("block") * chunks + F.col("chunk")) * 2
    cells = cells.select(cell.alias("cell"), F.col("term").alias("a"), F.lit(None).cast("string").alias("b"), "doc_id", F.col("tf").alias("x"), F.lit(None).cast("double").alias("y"), "body")
    shapes = shapes.select((cell + 1).alias("cell"), "a", "b", F.lit(None).cast("bigint").alias("doc_id"), F.col("idf_a").alias("x"), F.col("idf_b").alias("y"), F.lit(None).cast("array<int>").alias("body"))
    both = cells.unionByName(shapes).repartition(min(4 * blocks * chunks, 10_000), F.floor(F.col("cell") / 2)).sortWithinPartitions("cell")
    found = both.mapInArrow(_best_of_blocks(size), FOUND)
    best = W.partitionBy("a", "b").orderBy(F.desc("score"), F.col("doc_id").cast("string"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    rows = queries.join(found, (queries["a"] == found["a"]) & queries["b"].eqNullSafe(found["b"]))
    matched = F.filter(F.array(F.when(F.col("met").bitwiseAND(1) > 0, found["a"]), F.when(F.col("met").bitwiseAND(2) > 0, found["b"])), lambda t: t.isNotNull())
    return rows.select(key, "rank", "doc_id", "score", matched.alias("matched_terms"))


def search_many(index: Index, queries: DataFrame, size: int = 10, key: str = "query") -> DataFrame:
    """(key, rank, doc_id, score, matched_terms): the ``size`` best documents of each query, ties by the id as text."""
    plain = F.size("terms").between(1, 2) & (F.size(F.array_distinct("terms")) == F.size("terms"))
    for name in ("title_terms", "excluded", "tags", "phrases", "expansions"):
        plain &= F.size(name) <= 0
    kept = Kept(index.documents.sparkSession, "batch")
    queries = kept.keep(queries, "queries")
    short, others = _search_short(index, queries.where(plain), size, key, kept), queries.where(~plain)
    if others.isEmpty():
        return short
    best = W.partitionBy(key).orderBy(F.desc("score"), F.col("doc_id").cast("string"))
    ranked = score_many(index, others, key).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    return ranked.select(key, "rank", "doc_id", "score", "matched_terms").unionByName(short)
