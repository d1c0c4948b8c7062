"""Texts are cut into words once, and only keys with a partner are dealt."""

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import toxicity
from inkwell.operators import index as ix
from inkwell.operators import search as se
from inkwell.operators import spelling
from inkwell.plans.query import parse

SCHEMA = "doc_id bigint, seq bigint, title string, body string, url string, tags array<string>, created_at timestamp"
ROWS = [(1, 1, "Über docs", "docs and more docs, the docs", None, ["a"], None), (2, 2, "the", None, None, [], None), (3, 3, "more", "x 7 running runs", None, ["b"], None)]


def test_one_pass_gives_lengths_and_postings(spark):
    docs = ix.tidied(spark.createDataFrame(ROWS, SCHEMA))
    for stemmed in (False, True):
        plain, once = ix.prepared(docs), ix.analysed(docs, stemmed)
        assert sorted(map(tuple, once.select("doc_id", "title_len", "body_len").collect())) == sorted(map(tuple, plain.select("doc_id", "title_len", "body_len").collect()))
        assert sorted(map(tuple, ix.postings_in(once).collect())) == sorted(map(tuple, ix.postings_of(docs, stemmed).collect()))
    assert sorted(map(tuple, ix.vocab_in(ix.postings_of(docs, False)).collect())) == sorted(map(tuple, ix.vocab_of(docs).collect()))


def test_a_search_cuts_each_text_once(spark):
    index = ix.build_index(spark.createDataFrame(ROWS, SCHEMA), stemmed=False)
    found = se.score(index, parse("docs -running", stemmed=False))
    assert [(r.doc_id, r.matched_terms) for r in found.collect()] == [(1, ["docs"])]
    assert "n_indexed" not in found._jdf.queryExecution().optimizedPlan().toString()  # lengths come with the hits


def test_keys_that_nobody_asks_for_are_not_dealt(spark):
    vocab = spark.range(3000).select(F.concat(F.lit("w"), F.hex(F.xxhash64("id"))).alias("word"), F.lit(1).cast("long").alias("freq"))
    vocab = vocab.union(spark.createDataFrame([("thing", 5)], "word string, freq bigint")).select("word", "freq", F.substring("word", 1, 1).alias("first"), F.length("word").alias("len"))
    asked = spark.createDataFrame([("thign",)], "word string").select(F.explode(spelling._deletions(F.col("word"), F.lit(1))).alias("key"))
    keys = spelling.deletion_index(vocab)
    kept = spelling._asked_for(keys, asked)
    assert kept.count() < keys.count() // 100
    assert kept.join(asked, "key").count() == keys.join(asked, "key").count() > 0
    assert [tuple(r) for r in spelling.corrections(spark.createDataFrame([("thign",)], "word string"), vocab).collect()] == [("thign", "thing", 1)]


def test_features_are_added_in_place():
    """No second copy of the features of all words."""
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(60)) for _ in range(400)]
    labels = np.arange(400) % 2
    tracemalloc.start()
    model = toxicity.fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.table.any() and peak < 95e6, peak
