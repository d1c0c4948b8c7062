import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions.analysis import fold, folded, raw_words, tokens, words_of
from inkwell.functions.stemmer import stem
from inkwell.operators.search import min_span
from inkwell.operators.spelling import edit_distance
from inkwell.plans.query import intent_column, intent_of, parse, parse_table


def terms(text):
    return [t.term for t in tokens(text)]


def test_positions_count_dropped_words():
    found = tokens("The state of the art in Search")
    assert [(t.surface, t.position) for t in found] == [("state", 1), ("art", 4), ("search", 6)]


def test_terms():
    assert terms("Running runners ran") == ["run", "runner", "ran"]
    assert terms("Café") == terms("cafe")
    assert terms("Node.js and C++ with python3") == ["node.js", "c++", "python3"]
    assert [stem(w) for w in ("mongodb's", "o'reilly", "kubernetes", "guide")] == ["mongodb", "o", "kubernet", "guid"]


def test_offsets_are_of_the_original():
    text = "… ﬁne café art"
    assert [text[t.start : t.end] for t in tokens(text)] == ["ﬁne", "café", "art"]


def test_folding_is_the_same_in_spark(spark):
    texts = ["Café ﬁn ½ … Ł straße Ünï", "éà", "ＡＢＣ １２", "plain", "", "ñandú №5 ™", "İstanbul"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", raw_words(F.col("t")).alias("w"), folded(F.col("t")).alias("f")).collect()
    for r in rows:
        assert r.w == words_of(r.t)
    assert next(r.f for r in rows if r.t.startswith("Café")) == fold(texts[0])


def test_query_operators():
    q = parse('how to deploy "react app" -kubernetes tag:DevOps title:guide')
    assert (q.terms, q.phrases, q.phrase_texts) == (["deploy"], [[("react", 0), ("app", 1)]], ["react app"])
    assert (q.excluded, q.tags, q.title_terms, q.intent, q.is_question) == (["kubernet"], ["devops"], ["guid"], "question", True)
    assert parse('"state of the art"').phrases == [[("state", 0), ("art", 3)]]
    assert parse('"machine learning" machine').terms == []
    assert parse('"-foo" bar').excluded == ["foo"]
    assert parse('alpha "beta" gamma').keywords == ["alpha", "gamma", "beta"]


def test_filler_and_synonyms():
    assert parse("can you please tell me about neural networks").terms == ["neural", "network"]
    assert parse("how do search engines find information").terms == ["search", "engin", "inform"]
    assert parse("show me things").terms == ["show", "thing"]
    assert parse("car").expansions == {"car": ["automobil", "vehicl"]}
    assert parse("car", expand=False).expansions == {}
    assert parse("cars").expansions == {}


@pytest.mark.parametrize(("text", "intent"), [("react vs vue", "comparison"), ("buy electric car", "transactional"), ("python documentation", "navigational"), ("renewable energy", "informational"), ("what is it", "question"), ("", "informational")])
def test_intents(spark, text, intent):
    assert parse(text).intent == intent
    row = spark.createDataFrame([(text,)], "t string").select(intent_column(raw_words(F.col("t"))).alias("i")).first()
    assert (row.i.intent, row.i.is_question) == intent_of(words_of(text))


def test_a_table_of_queries(spark):
    rows = parse_table(spark.createDataFrame([("car -bus",), (None,)], "query string")).collect()
    assert rows[0].parsed.terms == ["car"] and rows[0].parsed.excluded == ["bus"] and rows[0].parsed.expansions == {"car": ["automobil", "vehicl"]}
    assert rows[1].parsed.terms == []


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance(spark):
    rng = random.Random(5)
    pairs = [("serach", "search"), ("kitten", "sitting"), ("ca", "abc"), ("", "ab"), ("ab", ""), ("", "")]
    pairs += [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(80)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == distance(r.a, r.b), r


def shortest(lists):
    if len(lists) < 2 or not all(lists):
        return None
    places = sorted({p for x in lists for p in x})
    return min(b - a + 1 for a in places for b in places if a <= b and all(any(a <= p <= b for p in x) for x in lists))


def test_min_span(spark):
    rng = random.Random(9)
    cases = [[[1, 10], [12], [4, 11]], [[1], []], [[3]], []] + [[sorted(rng.sample(range(30), rng.randint(0, 4))) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    for r in spark.createDataFrame([(c,) for c in cases], "x array<array<int>>").select("x", min_span(F.col("x")).alias("s")).collect():
        assert r.s == shortest(r.x), r


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé'’.-+#0 tag:title\"", max_size=40))
def test_parsing_never_fails(text):
    q = parse(text)
    assert len(q.terms) == len(q.keywords) == len(set(q.terms))


def test_postings_are_made_without_moving_rows(spark):
    """A document's words are grouped where it is read, and a few terms' postings equal those among all."""
    from inkwell.operators import index as ix

    rows = [(1, "Straße ½ cups", "the Ünïcode ﬁt don't 7 a thble, thbles thble."), (2, "", "thble\n" * 3), (3, "x", "Ⅳ K K…"), (4, None, None)]
    docs = ix.prepared(spark.createDataFrame(rows, "doc_id bigint, title string, body string").selectExpr("*", "array('t') tags"))
    for stemmed in (False, True):
        made = ix.postings_of(docs, stemmed)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        every = sorted(map(tuple, made.collect()))
        some = sorted(map(tuple, ix.postings_of(docs, stemmed, ["thble", "unicode"]).collect()))
        assert some == [r for r in every if r[0] in ("thble", "unicode")] and len(some) == (2 if stemmed else 3)
    slow = ix.tokens_of(docs).groupBy("doc_id", "surface", "field").agg({"position": "collect_list"}).collect()
    fast = {(r.doc_id, r.term, f): r[f] for r in ix.postings_of(docs, False).collect() for f in ("title", "body") if r[f]}
    assert fast == {(r[0], r[1], r[2]): sorted(r[3]) for r in slow}
    lengths = {r.doc_id: r.title_len + r.body_len for r in docs.collect()}
    assert lengths == {k: sum(len(v) for (d, _, _), v in fast.items() if d == k) for k in range(1, 5)}


def test_phrases_are_scored_without_moving_rows(spark):
    """A text's runs, words and phrases are counted in the task that reads it; only its known terms are gathered."""
    from inkwell.operators import keywords as kw

    texts = spark.createDataFrame([(1, "Red apple pie. Red apple pie, 42 the apple - tart"), (2, ""), (3, None), (4, "solo")], "doc_id bigint, text string").coalesce(1)
    for made in (kw.content_runs(texts), kw.word_scores(texts), kw.rake(texts), kw.candidates(texts), kw.keywords(texts)):
        assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    runs = sorted((r.doc_id, r.run, r.k, r.run_len, r.word) for r in kw.content_runs(texts).collect())
    assert runs == [(1, r, k, len(w), x) for r, w in enumerate((["red", "apple", "pie"], ["red", "apple", "pie"], ["apple"], ["tart"])) for k, x in enumerate(w)] + [(4, 0, 0, 1, "solo")]
    assert {(r.word, r.frequency, r.degree) for r in kw.word_scores(texts).collect()} == {("red", 2, 4), ("apple", 3, 4), ("pie", 2, 4), ("tart", 1, 0), ("solo", 1, 0)}
    assert {r.phrase for r in kw.rake(texts).where("doc_id = 1").collect()} == {"red", "apple", "pie", "tart", "red apple", "apple pie", "red apple pie"}
    assert {r.doc_id: r.keywords[0].text for r in kw.keywords(texts, stemmed=False).collect()} == {1: "red apple pie", 4: "solo"}


def test_arrivals_of_postings_with_seq_need_no_documents(spark):
    from inkwell.operators import index as ix
    from inkwell.operators import keywords as kw

    docs = ix.prepared(spark.createDataFrame([(k, 9 - k, "t", f"a b{k % 3} c{k}") for k in range(9)], "doc_id bigint, seq bigint, title string, body string").selectExpr("*", "array('t') tags"))
    joined = kw.arrival_df(docs, ix.postings_of(docs, False))
    alone = kw.arrival_df(docs, ix.postings_of(docs, False, more=("seq",)))
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, joined.collect()))
    assert "hashpartitioning(doc_id" not in alone._jdf.queryExecution().executedPlan().toString()
