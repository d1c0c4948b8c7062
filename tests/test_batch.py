"""Many queries in one plan against single searches, and the sweep for the shortest span."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.operators import batch
from inkwell.operators import search as se
from inkwell.operators.index import build_index
from inkwell.plans.query import parse
from test_engine import CORPUS

QUERIES = [
    "search engines", "how do search engines rank results?", "data", "machine learning data", '"machine learning"', '"learning machine"', "docker -kubernetes", "containers title:docker", "tag:ai",
    "tag:ai data", "car", "movie history", "", "   ", "-docker", "tag:nothing", "title:search index", '"node.js" loop', "javascript tag:react", '"event loop" javascript -react', "zzzz", "index index formula", None,
]


@pytest.fixture(scope="module", params=[True, False])
def index(spark, request):
    rows = [(k, k, t, b, None, tags, None) for k, (t, b, tags) in enumerate(CORPUS)]
    schema = "doc_id bigint, seq bigint, title string, body string, url string, tags array<string>, created_at timestamp"
    return build_index(spark.createDataFrame(rows, schema), request.param).cached()


def test_a_table_of_queries_equals_single_searches(spark, index):
    table = spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string")
    asked = batch.asked(table, stemmed=index.stemmed)
    got = {}
    for r in batch.search_many(index, asked, size=4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.doc_id, round(r.score, 9), list(r.matched_terms)))
    for k, text in enumerate(QUERIES):
        found = se.top(se.score(index, parse(text or "", stemmed=index.stemmed)), size=4)
        assert sorted(got.get(k, [])) == sorted((r["rank"], r.doc_id, round(r.score, 9), list(r.matched_terms)) for r in found.collect()), text
    assert sum(map(bool, got.values())) > 10


def test_the_plan_has_no_terms(spark, index):
    plans = []
    for texts in (QUERIES[:2], QUERIES[2:9]):
        asked = batch.asked(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query int, text string"), stemmed=index.stemmed)
        plan = batch.search_many(index, asked)._jdf.queryExecution().optimizedPlan().toString()
        plans.append(plan.count("\n"))
        assert "docker" not in plan and "engin" not in plan
    assert plans[0] == plans[1]


def spans(lists):
    if len(lists) < 2 or not all(lists):
        return None
    return min(max(c) - min(c) + 1 for c in itertools.product(*lists))


def test_min_span_by_brute_force(spark):
    rng = random.Random(8)
    cases = [[[1, 5], []], [[3]], [[2, 9], [4]], []] + [[sorted(rng.sample(range(40), rng.randint(1, 5))) for _ in range(rng.randint(2, 4))] for _ in range(60)]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, lists array<array<int>>")
    got = {r.k: r.s for r in rows.select("k", se.min_span(F.col("lists")).alias("s")).collect()}
    assert got == {k: spans(c) for k, c in enumerate(cases)}


def test_many_positions(spark):
    """Linear in the number of positions."""
    rows = spark.range(1).select(F.array(F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda x: x * 4), F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda x: x * 4 + 3)).alias("lists"))
    assert rows.select(se.min_span(F.col("lists"))).first()[0] == 2
    assert rows.select(se.phrase_in([F.col("lists")[0], F.col("lists")[1]], [0, 3])).first()[0] and not rows.select(se.phrase_in([F.col("lists")[0], F.col("lists")[1]], [0, 2])).first()[0]


@pytest.mark.parametrize("block, chunk, size", [(1 << 15, 1 << 20, 10), (7, 5, 3)])
def test_short_queries_by_block(spark, monkeypatch, block, chunk, size):
    """One and two words, words that nobody has, titles without a body, repeated queries and ties, against the plain form."""
    monkeypatch.setattr(batch, "BLOCK", block)
    monkeypatch.setattr(batch, "CHUNK", chunk)
    rng, words = random.Random(3), "aa bb cc dd ee ff gg hh".split()
    texts = [" ".join(rng.choices(words, [9, 7, 5, 3, 2, 1, 1, 1], k=rng.randint(1, 25))) for _ in range(60)]
    rows = [(k, k, rng.choice(["", "aa", "bb cc", "ff"]), t if k % 9 else "", None, [], None) for k, t in enumerate(texts * 2)]
    schema = "doc_id bigint, seq bigint, title string, body string, url string, tags array<string>, created_at timestamp"
    index = build_index(spark.createDataFrame(rows, schema), stemmed=False)
    asked_ = [" ".join(rng.sample([*words, "zz"], rng.randint(1, 2))) for _ in range(50)] * 2
    table = batch.asked(spark.createDataFrame(list(enumerate(asked_)), "query int, text string"), stemmed=False)
    plain = batch.score_many(index.cached(), table).collect()
    want = {}
    for r in sorted(plain, key=lambda r: (-round(r.score, 9), str(r.doc_id))):
        if len(want.setdefault(r.query, [])) < size:
            want[r.query].append((len(want[r.query]) + 1, r.doc_id, round(r.score, 8), sorted(r.matched_terms)))
    got = {}
    for r in batch.search_many(index, table, size).collect():
        got.setdefault(r.query, []).append((r["rank"], r.doc_id, round(r.score, 8), sorted(r.matched_terms)))
    assert {q: sorted(x) for q, x in got.items()} == want


def test_repeated_queries_are_met_once(spark, index, monkeypatch):
    """A query that comes 500 times is scored once in each block."""
    made = spark.sparkContext.accumulator(0)
    plain = batch._best_of_block

    def counted(size):
        run = plain(size)

        def of(postings, queries):
            made.add(queries.num_rows)
            return run(postings, queries)

        return of

    monkeypatch.setattr(batch, "_best_of_block", counted)
    table = batch.asked(spark.createDataFrame([(k, "docker data") for k in range(500)], "query int, text string"), expand=False, stemmed=index.stemmed)
    rows = batch.search_many(index, table, size=2).collect()
    assert len({r.query for r in rows}) == 500 and made.value == 1


def test_queries_pass_a_block_in_turns(monkeypatch):
    """A block's postings stay, its queries and their best don't: each turn's are given before the next ones are read."""
    monkeypatch.setattr(batch, "TURN", 4)
    names = ["cell", "a", "b", "doc_id", "x", "y", "body"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]

    def rows(*given):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*given, strict=True), kinds, strict=True)], names=names)

    read = []

    def come():
        for n, cell in enumerate((0, 2)):  # two blocks
            yield rows(*((cell, "ab"[d % 2], None, 10 * n + d, 1.0 + d, None, [d]) for d in range(4)))
            yield rows((cell, "a", None, 10 * n + 1, 0.5, None, [3]))
            for k in range(5):
                read.append(k)
                yield rows(*[(cell + 1, "a", "b", None, 1.0, 1.0, None)] * 3, *[(cell + 1, "b", None, None, 1.0, 0.0, None)] * 3)

    got = []
    for b in batch._best_of_blocks(2)(come()):
        got.append((len(read), b.to_pylist()))
    assert [n for n, _ in got] == [k for k in range(1, 11) for _ in range(2)] and all(len(x) <= 8 for _, x in got)
    first = got[0][1]
    assert [(r["a"], r["b"], r["doc_id"]) for r in first[:2]] == [("a", "b", 1), ("a", "b", 3)] and [r["met"] for r in first[:2]] == [3, 2]
    assert [r["doc_id"] for r in got[1][1] if r["b"] is None] == [3, 1] * 2 and {r["doc_id"] // 10 for _, x in got[10:] for r in x} == {1}
