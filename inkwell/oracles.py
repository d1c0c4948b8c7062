"""DuckDB SQL for the search engine's queries, written apart from the engine."""

from __future__ import annotations

from .functions.lexicon import COMPARISON, NAVIGATIONAL, QUESTION_STARTERS, QUESTION_WORDS, RUN_BREAK, STOP_WORDS, TRANSACTIONAL, WORD


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


RX = "'" + WORD.replace("'", "''") + "'"
STOP = _in(STOP_WORDS)

DOCS = """
docs AS (
  SELECT doc_id, regexp_replace(regexp_extract(coalesce(text, ''), '^[^.!?\\n]*'), '^\\s+|\\s+$', '', 'g') AS title,
    regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body, [lower(lang), lower(source)] AS tags FROM documents
)"""

TOK = f"""
{DOCS}, field_words AS (
  SELECT doc_id, 'title' AS field, regexp_extract_all(lower(strip_accents(title)), {RX}) AS w FROM docs
  UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(strip_accents(body)), {RX}) FROM docs
), tok AS (
  SELECT doc_id, field, (k - 1)::INTEGER AS position, w[k] AS surface FROM field_words, unnest(range(1, len(w) + 1)) AS t(k)
  WHERE replace(w[k], '’', '''') NOT IN {STOP} AND (length(w[k]) > 1 OR w[k] BETWEEN '0' AND '9')
)"""

INDEX = f"""
{TOK}, postings AS (
  SELECT surface AS term, doc_id, coalesce(list(position ORDER BY position) FILTER (field = 'title'), []) AS title,
    coalesce(list(position ORDER BY position) FILTER (field = 'body'), []) AS body FROM tok GROUP BY ALL
), terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
vocab AS (SELECT surface AS word, count(*) AS freq, surface[1] AS first, length(surface)::INTEGER AS len FROM tok GROUP BY surface),
lengths AS (
  SELECT doc_id, count(surface) FILTER (field = 'title') AS tl, count(surface) FILTER (field = 'body') AS bl FROM docs LEFT JOIN tok USING (doc_id) GROUP BY doc_id
), stats AS (SELECT count(*) AS n, greatest(sum(tl) / count(*), 1.0) AS avg_t, greatest(sum(bl) / count(*), 1.0) AS avg_b FROM lengths)"""


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def _scored(core: list[str], positive: list[str] | None = None, extra: dict[str, list[str]] | None = None, excluded: list[str] = (), title: list[str] = (), phrases: list[list[tuple[str, int]]] = (), tags: list[str] = ()) -> str:
    """CTEs up to ``scored`` (doc_id, score, matched) for a search by these surface terms."""
    positive = positive or core
    extra = extra or {}
    synonyms = sorted({s for x in extra.values() for s in x} - set(positive))
    weights = _values([*((t, 1.0) for t in positive), *((t, 0.35) for t in synonyms)], "term, weight")
    hits = _values([(t, s) for t in core for s in [t, *extra.get(t, [])]], "core, term")
    tests = [f"NOT EXISTS (SELECT 1 FROM postings p WHERE p.doc_id = b.doc_id AND p.term IN {_in(excluded)})"] if excluded else []
    tests += [f"EXISTS (SELECT 1 FROM postings p WHERE p.doc_id = b.doc_id AND p.term = '{t}' AND len(p.title) > 0)" for t in title]
    tests += [f"list_contains(tags, '{t}')" for t in tags]
    bonus = ""
    for phrase in phrases:
        joins = " ".join(f"JOIN tok t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.field = t0.field AND t{k}.position = t0.position + {o} AND t{k}.surface = '{t}'" for k, (t, o) in enumerate(phrase) if k)
        tests.append(f"b.doc_id IN (SELECT t0.doc_id FROM tok t0 {joins} WHERE t0.surface = '{phrase[0][0]}')")
        bonus += f" + 1.5 * (SELECT sum(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) FROM {_values([(t,) for t, _ in phrase], 'term')} LEFT JOIN terms USING (term), stats) / {len(phrase)}"
    return f"""WITH {INDEX}, asked AS {weights}, matches AS (SELECT * FROM postings JOIN asked USING (term)
), bm AS (
  SELECT doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf / (1.2 + wtf)) AS bm FROM (
    SELECT *, 3.0 * len(title) / (0.5 + 0.5 * tl / avg_t) + 1.0 * len(body) / (0.25 + 0.75 * bl / avg_b) AS wtf
    FROM matches JOIN terms USING (term) JOIN lengths USING (doc_id), stats
  ) GROUP BY doc_id
), coverage AS (
  SELECT doc_id, count(DISTINCT core) / {len(core)}.0 AS c FROM {hits} h JOIN postings USING (term) GROUP BY doc_id
), core_hits AS (SELECT * FROM postings WHERE term IN {_in(core)}
), core_places AS (SELECT doc_id, term, unnest(body) AS p FROM core_hits
), lasts AS (
  SELECT e.doc_id, e.p, x.term, max(x.p) AS l FROM core_places e JOIN core_places x ON x.doc_id = e.doc_id AND x.p <= e.p GROUP BY ALL
), spans AS (
  SELECT doc_id, min(s) AS span, any_value(k) AS k FROM (
    SELECT doc_id, p, p - min(l) + 1 AS s, count(DISTINCT term) AS k FROM lasts GROUP BY doc_id, p
  ) JOIN (SELECT doc_id, count(*) AS need FROM core_hits GROUP BY doc_id) USING (doc_id) WHERE k = need AND need > 1 GROUP BY doc_id
), matched AS (
  SELECT doc_id, string_agg(term, ',' ORDER BY term) AS matched, count(*)::INTEGER AS n_matched FROM postings WHERE term IN {_in(positive)} GROUP BY doc_id
), scored AS (
  SELECT b.doc_id, tags, bm * (0.4 + 0.6 * coalesce(c, 0) ** 2) + coalesce(0.6 * spans.k / span, 0){bonus} AS score, coalesce(matched, '') AS matched, coalesce(n_matched, 0) AS n_matched
  FROM bm b JOIN docs USING (doc_id) LEFT JOIN coverage USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN matched USING (doc_id)
  {"WHERE " + " AND ".join(tests) if tests else ""}
)"""


def _found(**spec) -> str:
    return _scored(**spec) + " SELECT doc_id, round(score, 6) AS score, matched FROM scored"


BIGRAM = [("eriner", 0), ("thanea", 1)]
TWO = _scored(core=["thble", "thanea"])

LOG = """
log AS (
  SELECT query, count(*) AS count, max(ts) AS last_at FROM (
    SELECT regexp_replace(lower(event_type || '  by ' || (user_id % 50)::VARCHAR), '\\s+', ' ', 'g') AS query, floor(value) AS total, ts FROM events
  ) WHERE total > 0 AND query IS NOT NULL GROUP BY query
)"""

MISSPELT = "(SELECT unnest(['thign', 'eriiner', 'thaena', 'erbl', 'thble', 'ononx', 'the']) AS word)"
CANDIDATES = f"""
near AS (
  SELECT q.word, v.word AS candidate, freq FROM {MISSPELT} q JOIN vocab v ON v.first IN (q.word[1], q.word[2]) AND v.len BETWEEN length(q.word) - 2 AND length(q.word) + 2
  QUALIFY row_number() OVER (PARTITION BY q.word ORDER BY freq DESC, v.word) <= 5000
)"""

RUNS = f"""
fragments AS (
  SELECT doc_id, f, regexp_extract_all(parts[f], {RX}) AS w FROM (
    SELECT doc_id, regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '{RUN_BREAK}') AS parts FROM documents
  ), unnest(range(1, len(parts) + 1)) AS t(f)
), frag_words AS (
  SELECT doc_id, f, k, w[k] AS word, (replace(w[k], '’', '''') IN {STOP} OR length(w[k]) < 2 OR regexp_full_match(w[k], '[0-9]+')) AS stop
  FROM fragments, unnest(range(1, len(w) + 1)) AS t(k)
), islands AS (
  SELECT *, count(*) FILTER (stop) OVER (PARTITION BY doc_id, f ORDER BY k) AS island FROM frag_words
), runs AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, f, island) AS run_len, row_number() OVER (PARTITION BY doc_id, f, island ORDER BY k) AS at FROM islands WHERE NOT stop
), word_scores AS (
  SELECT doc_id, word, count(*) AS frequency, sum(least(run_len, 3) - 1)::BIGINT AS degree, (sum(least(run_len, 3) - 1) + count(*)) / count(*) AS word_score FROM runs GROUP BY doc_id, word
)"""

STORED_DOCS = DOCS.replace("docs AS", "all_docs AS") + f""", docs AS (
  SELECT doc_id, title, CASE WHEN doc_id % 5 = 0 THEN title ELSE body END AS body, tags FROM all_docs JOIN (SELECT doc_id, length(regexp_extract(coalesce(text, ''), '^[^.!?\\n]*')) AS raw_len FROM documents) USING (doc_id)
  WHERE doc_id % 10 <> 0 AND title <> '' AND raw_len <= 500 AND length(body) <= 1000000
)"""
STORED = INDEX.replace(DOCS, STORED_DOCS)

GRAMS = """
grams AS (
  SELECT a.doc_id, g.n, CASE g.n WHEN 1 THEN a.word WHEN 2 THEN a.word || ' ' || b.word ELSE a.word || ' ' || b.word || ' ' || c.word END AS phrase, a.at = 1 AND a.run_len = g.n AS whole,
    CASE g.n WHEN 1 THEN x.word_score WHEN 2 THEN x.word_score + y.word_score ELSE x.word_score + y.word_score + z.word_score END AS total,
    CASE g.n WHEN 1 THEN x.s WHEN 2 THEN x.s + y.s ELSE x.s + y.s + z.s END AS weight
  FROM runs a JOIN (SELECT unnest([1, 2, 3]) AS n) g ON a.at + g.n - 1 <= a.run_len
  LEFT JOIN runs b ON (b.doc_id, b.f, b.island, b.at) = (a.doc_id, a.f, a.island, a.at + 1) LEFT JOIN runs c ON (c.doc_id, c.f, c.island, c.at) = (a.doc_id, a.f, a.island, a.at + 2)
  JOIN weights x ON (x.doc_id, x.word) = (a.doc_id, a.word) LEFT JOIN weights y ON (y.doc_id, y.word) = (b.doc_id, b.word) LEFT JOIN weights z ON (z.doc_id, z.word) = (c.doc_id, c.word)
)"""

DELTA_TERMS = "SELECT term, df FROM terms"

SQL: dict[str, str] = {
    "tokens_by_doc": f"WITH {TOK} SELECT doc_id, field, count(*) AS n, count(DISTINCT surface) AS distinct_words FROM tok GROUP BY ALL",
    "token_positions": f"WITH {TOK} SELECT * FROM tok",
    "raw_word_counts": f"SELECT doc_id, len(regexp_extract_all(lower(strip_accents(text)), {RX}))::BIGINT AS n_words FROM documents",
    "identifier_terms": f"WITH {INDEX} SELECT word, freq FROM vocab WHERE regexp_matches(word, '[0-9.+#\\-]')",
    "page_word_counts": f"""
WITH p AS (
  SELECT page_id AS doc_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g') AS title,
    regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g') AS body, regexp_extract(html, '<html lang="([^"]*)"', 1) AS tags FROM pages
), kept AS (
  SELECT *, list_filter(regexp_extract_all(lower(strip_accents(title)), {RX}), lambda x: replace(x, '’', '''') NOT IN {STOP} AND (length(x) > 1 OR x BETWEEN '0' AND '9')) AS t,
    list_filter(regexp_extract_all(lower(strip_accents(body)), {RX}), lambda x: replace(x, '’', '''') NOT IN {STOP} AND (length(x) > 1 OR x BETWEEN '0' AND '9')) AS b FROM p
) SELECT doc_id, title, len(t)::INTEGER AS title_len, len(b)::INTEGER AS body_len, tags FROM kept""",
    "vocab_freq": f"WITH {INDEX} SELECT * FROM vocab",
    "vocab_top_words": f"WITH {INDEX} SELECT word, freq FROM vocab ORDER BY freq DESC, word LIMIT 15",
    "term_df": f"WITH {INDEX} SELECT * FROM terms",
    "postings_positions": f"WITH {INDEX} SELECT term, doc_id, array_to_string(title, ',') AS title, array_to_string(body, ',') AS body FROM postings",
    "corpus_stats": f"WITH {INDEX} SELECT count(*) AS documents, (SELECT count(*) FROM terms) AS unique_terms, round(sum(tl) / count(*), 2) AS avg_title_length, round(sum(bl) / count(*), 2) AS avg_body_length FROM lengths",
    "incremental_delta_df": f"WITH {INDEX} {DELTA_TERMS}",
    "delete_then_df": f"WITH {INDEX} SELECT term, count(*) AS df FROM postings WHERE doc_id % 10 <> 0 GROUP BY term",
    "update_then_stats": f"WITH {INDEX} SELECT count(*) AS doc_count, sum(tl)::BIGINT AS title_len, sum(CASE WHEN doc_id % 5 = 0 THEN tl ELSE bl END)::BIGINT AS body_len FROM lengths",
    "bm25f_two_terms": _found(core=["thble", "thanea"]),
    "exclusion_search": _found(core=["thble"], excluded=["thanea"]),
    "title_term_search": _found(core=["thble"], positive=["thble", "erble"], title=["erble"]),
    "tag_filter_all": _found(core=["thble"], tags=["en", "src0"]),
    "tag_only_browse": f"WITH {DOCS} SELECT doc_id, 1.0::DOUBLE AS score, '' AS matched FROM docs WHERE list_contains(tags, 'de') AND list_contains(tags, 'src0')",
    "excluded_only_empty": f"WITH {DOCS} SELECT doc_id, 1.0::DOUBLE AS score, '' AS matched FROM docs WHERE false",
    "phrase_search": _found(core=["eriner", "thanea"], phrases=[BIGRAM]),
    "phrase_reversed": _found(core=["thanea", "eriner"], phrases=[[("thanea", 0), ("eriner", 1)]]),
    "phrase_stopword_gap": _found(core=["thanedble", "anea"], phrases=[[("thanedble", 0), ("anea", 2)]]),
    "proximity_two": _found(core=["eriner", "thanea"]),
    "proximity_three": _found(core=["thble", "eriner", "thanea"]),
    "full_score": _found(core=["thble", "erble"], positive=["thble", "erble", "eriner", "thanea"], phrases=[BIGRAM], excluded=["ananin"], tags=["en"]),
    "coverage_score": _scored(core=["erble", "thble", "ananin"]) + " SELECT doc_id, n_matched, round(score, 6) AS score FROM scored",
    "expansion_search": _scored(core=["zzzz"], extra={"zzzz": ["thing", "thanea"]}) + " SELECT doc_id, round(score, 6) AS score FROM scored",
    "facets_top20": TWO
    + """ SELECT tag, count(*) AS count FROM (
      SELECT row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR) AS rank, unnest(tags) AS tag, unnest(range(len(tags))) AS k FROM scored
    ) GROUP BY tag ORDER BY count(*) DESC, min((rank, k)) LIMIT 20""",
    "search_page2": TWO
    + """, ranked AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR)::INTEGER AS rank, doc_id, score, score / max(score) OVER () AS relevance FROM scored)
    SELECT rank, doc_id, round(score, 6) AS score, round(relevance, 6) AS relevance FROM ranked WHERE rank BETWEEN 11 AND 20""",
    "list_documents_page": f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE list_contains(tags, 'en') ORDER BY doc_id DESC LIMIT 20 OFFSET 20",
    "get_document": f"WITH {DOCS} SELECT doc_id, title, body, array_to_string(tags, ',') AS tags FROM docs WHERE doc_id = 7",
    "intent_detection": f"""
WITH q AS (SELECT conv_id, turn, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), {RX}) AS w FROM conversations WHERE role = 'user'),
f AS (SELECT *, coalesce(w[1] IN {_in(QUESTION_STARTERS)}, false) OR list_has_any(w, {list(QUESTION_WORDS)}) AS is_question FROM q)
SELECT conv_id, turn, CASE WHEN list_has_any(w, {list(COMPARISON)}) THEN 'comparison' WHEN is_question THEN 'question'
  WHEN list_has_any(w, {list(TRANSACTIONAL)}) THEN 'transactional' WHEN list_has_any(w, {list(NAVIGATIONAL)}) THEN 'navigational' ELSE 'informational' END AS intent, is_question FROM f""",
    "query_log_popularity": f"WITH {LOG} SELECT query, count, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM log",
    "popular_queries_top10": f"WITH {LOG} SELECT query, count FROM log ORDER BY count DESC, query LIMIT 10",
    "suggest_prefix": f"""
WITH {INDEX}, {LOG}, l AS (SELECT query AS s, 0 AS src, count AS w FROM log WHERE starts_with(query, 'p') ORDER BY count DESC, query LIMIT 8),
v AS (SELECT word AS s, 1 AS src, freq AS w FROM vocab WHERE starts_with(word, 'p') ORDER BY freq DESC, word LIMIT 24),
u AS (SELECT s, min((src, -w, s)) AS o FROM (SELECT * FROM l UNION ALL SELECT * FROM v WHERE s NOT IN {STOP} AND s <> 'p') GROUP BY s)
SELECT row_number() OVER (ORDER BY o)::INTEGER AS k, s AS suggestion FROM u ORDER BY o LIMIT 8""",
    "suggest_two_words": f"""
WITH {INDEX}, v AS (SELECT word, freq FROM vocab WHERE starts_with(word, 'tha') ORDER BY freq DESC, word LIMIT 24)
SELECT row_number() OVER (ORDER BY freq DESC, word)::INTEGER AS k, 'thing ' || word AS suggestion FROM v WHERE word NOT IN {STOP} ORDER BY freq DESC, word LIMIT 8""",
    "prefix_table": f"""
WITH {LOG} SELECT query[1:n] AS prefix, query, count FROM log, unnest(range(0, least(length(query), 16) + 1)) AS t(n)
QUALIFY row_number() OVER (PARTITION BY query[1:n] ORDER BY count DESC, query) <= 20""",
    "match_snippets": f"""
WITH {DOCS}, split AS (
  SELECT doc_id, regexp_extract_all(body, '\\S+') AS words, regexp_split_to_array(body, '\\S+') AS gaps FROM docs
), at_word AS (
  SELECT doc_id, words[k] AS word, k - 1 AS place, regexp_extract_all(lower(strip_accents(words[k])), {RX}) AS t, regexp_split_to_array(lower(strip_accents(words[k])), {RX}) AS g
  FROM split, unnest(range(1, len(words) + 1)) AS u(k)
), hits AS (SELECT doc_id, place, term FROM (SELECT doc_id, place, unnest(t) AS term FROM at_word) WHERE term IN ('thble', 'thanea')
), weighed AS (
  SELECT doc_id, a.place, count(DISTINCT h.term) + 0.1 * count(*) AS weight FROM (SELECT DISTINCT doc_id, place FROM hits) a JOIN hits h USING (doc_id) WHERE h.place BETWEEN a.place AND a.place + 31 GROUP BY doc_id, a.place, a.doc_id
), best AS (SELECT doc_id, arg_max(place, (weight, -place)) AS hit FROM weighed GROUP BY doc_id
), windows AS (
  SELECT doc_id, gaps, len(words) AS n, CASE WHEN len(words) <= 32 THEN 0 ELSE greatest(0, least(hit - 4, len(words) - 32)) END AS b FROM best JOIN split USING (doc_id)
), marked AS (
  SELECT doc_id, place, list_reduce(list_prepend('', list_transform(range(1, len(g) + 1), lambda j:
    word[list_sum(list_transform(g[1:j], lambda x: length(x))) - length(g[j]) + coalesce(list_sum(list_transform(t[1:j - 1], lambda x: length(x))), 0) + 1 : list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:j - 1], lambda x: length(x))), 0)]
    || CASE WHEN j > len(t) THEN '' WHEN t[j] IN ('thble', 'thanea') THEN '[' || word[list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:j - 1], lambda x: length(x))), 0) + 1 : list_sum(list_transform(g[1:j], lambda x: length(x))) + list_sum(list_transform(t[1:j], lambda x: length(x)))] || ']'
      ELSE word[list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:j - 1], lambda x: length(x))), 0) + 1 : list_sum(list_transform(g[1:j], lambda x: length(x))) + list_sum(list_transform(t[1:j], lambda x: length(x)))] END)), lambda x, y: x || y) AS word
  FROM at_word WHERE doc_id IN (SELECT doc_id FROM best)
) SELECT doc_id, CASE WHEN any_value(b) > 0 THEN '… ' ELSE '' END || string_agg(CASE WHEN place > b THEN gaps[place + 1] ELSE '' END || word, '' ORDER BY place)
  || CASE WHEN any_value(b) + 32 < any_value(n) THEN ' …' ELSE '' END AS snippet
FROM windows JOIN marked USING (doc_id) WHERE place >= b AND place < b + 32 GROUP BY doc_id""",
    "spell_candidates_blocked": f"WITH {INDEX}, {CANDIDATES} SELECT * FROM near",
    "spell_best_d1": f"""
WITH {INDEX}, {CANDIDATES}, d AS (
  SELECT *, damerau_levenshtein(word, candidate) AS distance FROM near WHERE candidate <> word AND length(word) BETWEEN 4 AND 6
) SELECT word, arg_min(candidate, (distance, -freq, candidate)) AS correction, min(distance)::INTEGER AS distance FROM d WHERE distance <= 1 GROUP BY word""",
    "spell_log": f"""
WITH {INDEX}, asked AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), {RX})) AS word FROM conversations WHERE role = 'user'
), near AS (
  SELECT q.word, v.word AS candidate, freq FROM asked q JOIN vocab v ON v.first IN (q.word[1], q.word[2]) AND v.len BETWEEN length(q.word) - 2 AND length(q.word) + 2
  WHERE q.word NOT IN (SELECT word FROM vocab) AND length(q.word) > 3
  QUALIFY row_number() OVER (PARTITION BY q.word ORDER BY freq DESC, v.word) <= 5000
), d AS (
  SELECT *, damerau_levenshtein(word, candidate) AS distance, length(candidate) - length(word) AS more FROM near
), apart AS ( -- a letter that comes or goes between two that are swapped is a third edit
  SELECT * FROM d WHERE distance <= CASE WHEN length(word) <= 6 THEN 1 ELSE 2 END AND (distance < 2 OR more = 0 OR levenshtein(word, candidate) < 3 OR len(list_filter(range(1, length(word)), lambda i:
    (word[1:i - 1] = candidate[1:i - 1] AND candidate[i] = word[i + 1] AND candidate[i + 1] = word[i] AND levenshtein(word[i + 2:], candidate[i + 2:]) = 1)
    OR (word[i + 2:] = candidate[i + 2 + more:] AND candidate[i + more] = word[i + 1] AND candidate[i + 1 + more] = word[i] AND levenshtein(word[1:i - 1], candidate[1:i - 1 + more]) = 1))) > 0)
) SELECT word, arg_min(candidate, (distance, -freq, candidate)) AS correction, min(distance)::INTEGER AS distance FROM apart GROUP BY word""",
    "content_runs": f"""
WITH {RUNS} SELECT doc_id, count(*) AS runs, sum(n)::BIGINT AS words, max(n) AS longest FROM (SELECT doc_id, f, island, count(*) AS n FROM runs GROUP BY ALL) GROUP BY doc_id""",
    "rake_word_scores": f"WITH {RUNS} SELECT doc_id, word, frequency, degree, round(word_score, 6) AS word_score FROM word_scores",
    "rake_ngram_scores": f"""
WITH {RUNS}, grams AS (
  SELECT a.doc_id, g.n, CASE g.n WHEN 1 THEN a.word WHEN 2 THEN a.word || ' ' || b.word ELSE a.word || ' ' || b.word || ' ' || c.word END AS phrase,
    CASE g.n WHEN 1 THEN x.word_score WHEN 2 THEN x.word_score + y.word_score ELSE x.word_score + y.word_score + z.word_score END AS total, a.at = 1 AND a.run_len = g.n AS whole
  FROM runs a JOIN (SELECT unnest([1, 2, 3]) AS n) g ON a.at + g.n - 1 <= a.run_len
  LEFT JOIN runs b ON (b.doc_id, b.f, b.island, b.at) = (a.doc_id, a.f, a.island, a.at + 1) LEFT JOIN runs c ON (c.doc_id, c.f, c.island, c.at) = (a.doc_id, a.f, a.island, a.at + 2)
  JOIN word_scores x ON (x.doc_id, x.word) = (a.doc_id, a.word) LEFT JOIN word_scores y ON (y.doc_id, y.word) = (b.doc_id, b.word)
  LEFT JOIN word_scores z ON (z.doc_id, z.word) = (c.doc_id, c.word)
) SELECT doc_id, phrase, round(max(total) / n * (1 + 0.5 * (n - 1)) * (1 + ln(count(*))), 6) AS rake FROM grams GROUP BY doc_id, n, phrase HAVING n = 1 OR count(*) > 1 OR bool_or(whole)""",
    "keyword_idf_as_of": f"""
WITH {INDEX}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS before FROM docs),
p AS (SELECT doc_id, term, count(*) OVER (PARTITION BY term ORDER BY doc_id) - 1 AS df FROM postings)
SELECT doc_id, term, df, round(CASE WHEN before > 0 THEN ln(1 + (before + 1) / (df + 1)) ELSE 1 END, 6) AS idf FROM p JOIN o USING (doc_id)""",
    "keyword_scores": f"""
WITH {INDEX}, {RUNS}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS before FROM docs),
p AS (SELECT doc_id, term, count(*) OVER (PARTITION BY term ORDER BY doc_id) - 1 AS df FROM postings),
weights AS (
  SELECT w.doc_id, w.word, word_score, (0.5 + 0.5 * frequency / max(frequency) OVER (PARTITION BY w.doc_id)) * CASE WHEN before > 0 THEN ln(1 + (before + 1) / (coalesce(df, 0) + 1)) ELSE 1 END AS s
  FROM word_scores w JOIN o USING (doc_id) LEFT JOIN p ON p.doc_id = w.doc_id AND p.term = w.word
), {GRAMS}, phrases AS (
  SELECT doc_id, phrase, max(total) / n * (1 + 0.5 * (n - 1)) * (1 + ln(count(*))) AS rake, max(weight) / n AS tfidf
  FROM grams GROUP BY doc_id, n, phrase HAVING n = 1 OR count(*) > 1 OR bool_or(whole)
)
SELECT doc_id, phrase AS text, round(0.5 * rake / max(rake) OVER (PARTITION BY doc_id) + 0.5 * tfidf / most, 6) AS score
FROM phrases JOIN (SELECT doc_id, max(s) AS most FROM weights GROUP BY doc_id) USING (doc_id)""",
    "batch_search": f"""
WITH {INDEX}, asked AS (
  SELECT doc_id AS query, surface AS term FROM tok WHERE field = 'title' GROUP BY doc_id, surface QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(position)) <= 2
), m AS (SELECT query, p.* FROM asked JOIN postings p USING (term)
), bm AS (
  SELECT query, doc_id, count(*) AS hits, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf / (1.2 + wtf)) AS bm FROM (
    SELECT *, 3.0 * len(title) / (0.5 + 0.5 * tl / avg_t) + 1.0 * len(body) / (0.25 + 0.75 * bl / avg_b) AS wtf FROM m JOIN terms USING (term) JOIN lengths USING (doc_id), stats
  ) GROUP BY query, doc_id
), spans AS (
  SELECT query, doc_id, min(abs(x - y)) + 1 AS span
  FROM (SELECT a.query, a.doc_id, unnest(a.body) AS x, b.body AS other FROM m a JOIN m b ON a.query = b.query AND a.doc_id = b.doc_id AND a.term < b.term), unnest(other) AS t(y) GROUP BY query, doc_id
), scored AS (
  SELECT query, doc_id, bm * (0.4 + 0.6 * (hits / asks) ** 2) + coalesce(0.6 * 2 / span, 0) AS score
  FROM bm JOIN (SELECT query, count(*) AS asks FROM asked GROUP BY query) USING (query) LEFT JOIN spans USING (query, doc_id)
)
SELECT query, row_number() OVER w::INTEGER AS rank, doc_id, round(score, 6) AS score FROM scored
WINDOW w AS (PARTITION BY query ORDER BY score DESC, doc_id::VARCHAR) QUALIFY row_number() OVER w <= 10""",
    "stored_postings": f"WITH {STORED} SELECT term, doc_id, array_to_string(title, ',') AS title, array_to_string(body, ',') AS body FROM postings",
    "stored_terms": f"WITH {STORED} SELECT term, df FROM terms",
    "stored_vocab": f"WITH {STORED} SELECT word, freq, first, len FROM vocab",
    "stored_stats": f"""
WITH {STORED} SELECT count(*) AS documents, (SELECT count(*) FROM terms) AS unique_terms, round(sum(tl) / count(*), 2) AS avg_title_length, round(sum(bl) / count(*), 2) AS avg_body_length FROM lengths""",
    "stored_search": TWO.replace(DOCS, STORED_DOCS) + " SELECT doc_id, round(score, 6) AS score, matched FROM scored",
    "labels_by_tag": _scored(core=["thble"]) + ", each AS (SELECT quality, unnest(tags) AS tag FROM scored JOIN labels USING (doc_id)) SELECT quality, tag, count(*) AS count FROM each GROUP BY ALL",
}
