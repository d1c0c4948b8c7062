"""The search engine's queries over the test tables.  They index surface words, so that SQL can check them without a stemmer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.analysis import is_indexed, raw_words, with_terms
from .operators import index as ix
from .operators import keywords as kw
from .operators import search as se
from .operators import spelling, statistics, suggest
from .operators.batch import ASKED, search_many
from .operators.snippets import passages
from .plans.query import Query as ParsedQuery
from .plans.query import intent_column, parse, parse_table
from .sources.documents import corpus_of_documents, corpus_of_pages
from .sources.store import Kept, scratch

Query = Callable[[SparkSession, str], DataFrame]


def _index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.build_index(corpus_of_documents(spark, sf_dir), stemmed=False)


def _places(df: DataFrame, *columns: str) -> DataFrame:
    """Round doubles for output."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- analysis ---------------------------------------------------------------------------------------------------------


def tokens_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.tokens_of(ix.prepared(corpus_of_documents(spark, sf_dir))).groupBy("doc_id", "field").agg(F.count("*").alias("n"), F.countDistinct("surface").alias("distinct_words"))


def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.tokens_of(ix.prepared(corpus_of_documents(spark, sf_dir))).select("doc_id", "field", "position", "surface")


def raw_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_of_documents(spark, sf_dir).select("doc_id", F.size(raw_words(F.col("body"))).cast("long").alias("n_words"))


def identifier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ix.vocab_of(ix.prepared(corpus_of_documents(spark, sf_dir)))
    return words.where(F.col("word").rlike(r"[0-9.+#\-]")).select("word", "freq")


def page_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ix.prepared(corpus_of_pages(spark, sf_dir))
    return docs.select("doc_id", "title", "title_len", "body_len", F.array_join("tags", ",").alias("tags"))


def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ix.tokens_of(ix.prepared(corpus_of_documents(spark, sf_dir))).select("surface").distinct()
    return with_terms(words)


# --- index ------------------------------------------------------------------------------------------------------------


def vocab_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).vocab


def vocab_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_words(_index(spark, sf_dir))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms


def postings_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.select("term", "doc_id", F.array_join(F.col("title").cast("array<string>"), ",").alias("title"), F.array_join(F.col("body").cast("array<string>"), ",").alias("body"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.summary(_index(spark, sf_dir))


def incremental_delta_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index the even documents, then insert the odd ones: counts as if all had been indexed at once."""
    docs = corpus_of_documents(spark, sf_dir)
    half = ix.build_index(docs.where("doc_id % 2 = 0"), stemmed=False)
    return ix.change_index(half, docs.where("doc_id % 2 = 1")).terms


def delete_then_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return ix.change_index(index, delete=index.documents.where("doc_id % 10 = 0").select("doc_id")).terms


def update_then_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace the body of every fifth document by its title."""
    index = _index(spark, sf_dir)
    changes = index.documents.where("doc_id % 5 = 0").select("doc_id", F.col("title").alias("body"))
    return ix.update_documents(index, changes).stats


# --- search -----------------------------------------------------------------------------------------------------------

# Searches by name: query text, tags, expand.
SEARCHES: dict[str, tuple[str, list[str], bool]] = {
    "bm25f_two_terms": ("thble thanea", [], True),
    "exclusion_search": ("thble -thanea", [], True),
    "title_term_search": ("thble title:erble", [], True),
    "tag_filter_all": ("thble tag:en tag:src0", [], True),
    "tag_only_browse": ("", ["de", "src0"], True),
    "excluded_only_empty": ("-thing", ["en"], True),
    "phrase_search": ('"eriner thanea"', [], True),
    "phrase_reversed": ('"thanea eriner"', [], True),
    "phrase_stopword_gap": ('"thanedble the anea"', [], True),
    "proximity_two": ("eriner thanea", [], True),
    "proximity_three": ("thble eriner thanea", [], True),
    "full_score": ('thble erble "eriner thanea" -ananin tag:en', [], True),
}


def _search(name: str) -> Query:
    text, tags, expand = SEARCHES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = se.score(_index(spark, sf_dir), parse(text, expand, stemmed=False), tags)
        return _places(found.select("doc_id", "score", F.array_join("matched_terms", ",").alias("matched")), "score")

    return run


def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of which a document may have some."""
    found = se.score(_index(spark, sf_dir), parse("erble thble ananin", stemmed=False))
    return _places(found.select("doc_id", F.size("matched_terms").alias("n_matched"), "score"), "score")


def expansion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that is nowhere with expansion terms that are: found by these alone, at their lower weight."""
    q = parse("zzzz", stemmed=False)
    q.expansions = {"zzzz": ["thing", "thanea"]}
    return _places(se.score(_index(spark, sf_dir), q).select("doc_id", "score"), "score")


def facets_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.facets(se.score(_index(spark, sf_dir), parse("thble thanea", stemmed=False)))


def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten, with relevance to the best."""
    found = se.top(se.score(_index(spark, sf_dir), parse("thble thanea", stemmed=False)), page=2)
    return _places(found.select("rank", "doc_id", "score", "relevance"), "score", "relevance")


def list_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.listing(_index(spark, sf_dir), page=2, size=20, tag="EN").select("doc_id", "title")


def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).documents.where("doc_id = 7").select("doc_id", "title", "body", F.array_join("tags", ",").alias("tags"))


def _terms(spark: SparkSession, q: ParsedQuery) -> DataFrame:
    return spark.createDataFrame([(t,) for t in (*q.positive, *q.expansion_terms)], "term string")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the ten best documents."""
    index = _index(spark, sf_dir)
    q = parse("thble thanea", stemmed=False)
    page = se.top(se.score(index, q)).select("rank", "doc_id").join(index.documents.select("doc_id", "body"), "doc_id")
    return page.select("rank", "doc_id").join(passages(page.select("doc_id", F.col("body").alias("text")), _terms(spark, q), ["doc_id"], stemmed=False), "doc_id").select("rank", "doc_id", "snippet")


def match_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all matches of a search, with brackets for highlights."""
    index = _index(spark, sf_dir)
    q = parse("thble thanea", stemmed=False)
    found = se.score(index, q).select("doc_id").join(index.documents.select("doc_id", F.col("body").alias("text")), "doc_id")
    parts = F.transform("snippet", lambda x: F.when(x["highlight"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"]))
    return passages(found, _terms(spark, q), ["doc_id"], stemmed=False).select("doc_id", F.array_join(parts, "").alias("snippet"))


def parse_query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return parse_table(turns.select("conv_id", "turn", F.col("text").alias("query"))).drop("query")


def intent_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return turns.select("conv_id", "turn", intent_column(raw_words(F.coalesce("text", F.lit("")))).alias("i")).select("conv_id", "turn", "i.intent", "i.is_question")


# --- query log, suggestions, spelling ---------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return suggest.summarize_log(events.select(F.concat(F.upper("event_type"), F.lit("  by "), F.col("user_id") % 50).alias("query"), F.floor("value").cast("long").alias("total"), F.col("ts").alias("at")))


def query_log_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("query", "count", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


def popular_queries_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.popular(_log(spark, sf_dir))


def prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent queries of every prefix."""
    return suggest.prefix_table(_log(spark, sf_dir))


def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggestions(_log(spark, sf_dir), _index(spark, sf_dir).vocab, "p").select("k", "suggestion")


def suggest_two_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggestions(_log(spark, sf_dir), _index(spark, sf_dir).vocab, "thing tha").select("k", "suggestion")


def _misspelt(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ("thign", "eriiner", "thaena", "erbl", "thble", "ononx", "the")], "word string")


def _stored_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary, made once for the steps that read it."""
    return Kept(spark, "vocab").keep(_index(spark, sf_dir).vocab, "vocab")


def spell_candidates_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.candidates(_misspelt(spark), _index(spark, sf_dir).vocab)


def spell_best_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.corrections(_misspelt(spark).where("length(word) <= 6"), _stored_vocab(spark, sf_dir))


def spell_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corrections, of long words within two edits."""
    return spelling.corrections(_misspelt(spark), _stored_vocab(spark, sf_dir))


def spell_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that users ask for and no document has, corrected."""
    vocab = _stored_vocab(spark, sf_dir)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    words = turns.select(F.explode_outer(raw_words(F.col("text"))).alias("word")).where("word IS NOT NULL").distinct()
    unknown = Kept(spark, "unknown").keep(words.join(vocab, "word", "left_anti"), "words")
    return spelling.corrections(unknown, vocab)


# --- keywords ---------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def content_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kw.content_runs(_texts(spark, sf_dir)).groupBy("doc_id", "run").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum("n").alias("words"), F.max("n").alias("longest"))


def rake_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(kw.word_scores(_texts(spark, sf_dir)).select("doc_id", "word", "frequency", "degree", "word_score"), "word_score")


def rake_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(kw.rake(_texts(spark, sf_dir)).select("doc_id", "phrase", "rake"), "rake")


def _arrivals(index: ix.Index) -> DataFrame:
    return kw.arrival_df(index.documents, ix.postings_of(index.documents, index.stemmed, more=("seq",)))


def keyword_idf_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The idf of each document's terms when it arrived."""
    index = _index(spark, sf_dir)
    rows = _arrivals(index).join(kw.arrival_counts(index.documents).select("doc_id", "before"), "doc_id")
    return _places(rows.select("doc_id", "term", "df", kw.keyword_idf(F.col("df"), F.col("before")).alias("idf")), "idf")


def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's keywords with counts as of its arrival."""
    index = ix.build_index(corpus_of_documents(spark, sf_dir))
    texts = index.documents.select("doc_id", F.concat("title", F.lit(".\n"), "body").alias("text"))
    return kw.keywords(texts, _arrivals(index), kw.arrival_counts(index.documents))


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases that keywords are chosen from, with counts as of each document's arrival."""
    index = _index(spark, sf_dir)
    found = kw.candidates(_texts(spark, sf_dir), _arrivals(index), kw.arrival_counts(index.documents), stemmed=False)
    return _places(found.select("doc_id", "text", "score"), "score")


# --- many queries at once ---------------------------------------------------------------------------------------------


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the ten best matches of the first two words of its title, in one plan."""
    index = _index(spark, sf_dir)
    words = F.slice(F.array_distinct(F.filter(raw_words(F.col("title")), is_indexed)), 1, 2)
    asked = index.documents.select(F.col("doc_id").alias("query"), F.array_join(words, " ").alias("text")).where("text <> ''")
    none = {n: F.expr(f"cast(array() AS {ASKED[n].dataType.simpleString()})") for n in ("title_terms", "excluded", "tags", "phrases")}
    asked = asked.select("query", F.split("text", " ").alias("terms"), *(c.alias(n) for n, c in none.items()), F.expr("cast(map() AS map<string, array<string>>)").alias("expansions"))
    return _places(search_many(index, asked).select("query", "rank", "doc_id", "score"), "score")


# --- a stored index ---------------------------------------------------------------------------------------------------

_STORED: dict[tuple[str, str], str] = {}


def _changed(spark: SparkSession, sf_dir: str) -> ix.Index:
    """A stored index after some changes, made once: even and odd documents come apart, each fifth one's body is replaced by its title, and each tenth goes."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch(spark, "stored")
        engine, docs = Engine(spark, path, stemmed=False), corpus_of_documents(spark, sf_dir)
        for rest in (0, 1):
            engine.add(docs.where(F.col("doc_id") % 2 == rest))
        engine.add(docs.where("doc_id % 5 = 0").withColumn("body", F.col("title")), replace=True)
        engine.remove_many(docs.where("doc_id % 10 = 0").select("doc_id"))
        _STORED[key] = path
    return Engine.open(spark, _STORED[key], stemmed=False).index


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).postings.select("term", "doc_id", F.array_join(F.col("title").cast("array<string>"), ",").alias("title"), F.array_join(F.col("body").cast("array<string>"), ",").alias("body"))


def stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).terms


def stored_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).vocab


def stored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.summary(_changed(spark, sf_dir))


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.score(_changed(spark, sf_dir), parse("thble thanea", stemmed=False))
    return _places(found.select("doc_id", "score", F.array_join("matched_terms", ",").alias("matched")), "score")


def labels_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of labelled documents that match a search."""
    found = se.score(_index(spark, sf_dir), parse("thble", stemmed=False)).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return found.select("quality", F.explode("tags").alias("tag")).groupBy("quality", "tag").agg(F.count("*").alias("count"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        tokens_by_doc, token_positions, raw_word_counts, identifier_terms, page_word_counts, stem_terms, vocab_freq, vocab_top_words, term_df, postings_positions,
        corpus_stats, incremental_delta_df, delete_then_df, update_then_stats, coverage_score, expansion_search, facets_top20, search_page2, list_documents_page,
        get_document, snippets, match_snippets, parse_query_batch, intent_detection, query_log_popularity, popular_queries_top10, prefix_table, suggest_prefix, suggest_two_words,
        spell_candidates_blocked, spell_best_d1, spell_best, spell_log, content_runs, rake_word_scores, rake_ngram_scores, keyword_idf_as_of, keywords_topk, labels_by_tag,
        keyword_scores, batch_search, stored_postings, stored_terms, stored_vocab, stored_stats, stored_search,
    )
} | {name: _search(name) for name in SEARCHES}
