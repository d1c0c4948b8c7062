"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# Words that are not indexed.
STOP_WORDS = frozenset(
    """
    a about above after again against all am an and any are aren't as at be because been before
    being below between both but by can can't cannot could couldn't did didn't do does doesn't doing
    don't down during each few for from further had hadn't has hasn't have haven't having he he'd
    he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into
    is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only
    or other ought our ours ourselves out over own same shan't she she'd she'll she's should
    shouldn't so some such than that that's the their theirs them themselves then there there's
    these they they'd they'll they're they've this those through to too under until up very was
    wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while
    who who's whom why why's will with won't would wouldn't you you'd you'll you're you've your
    yours yourself yourselves also just may might must shall us get got via etc e.g i.e
    without within upon among since though although however instead often every many much
    even still yet whether else either neither rather per another several
    """.split()
)

# A word, and where keyword runs break.
WORD = r"[a-z0-9]+(?:['’.\-+#][a-z0-9+#]+)*[+#]*"
RUN_BREAK = r"[.!?,;:\t\n\r()\[\]{}\"“”]+|\s[-–—]\s"

# Words that tell a query's intent, and filler that carries no meaning.
QUESTION_WORDS = ["what", "why", "how", "when", "where", "who", "which", "whom", "whose"]
QUESTION_STARTERS = [*QUESTION_WORDS, "is", "are", "can", "could", "does", "do", "should", "would", "will", "did", "explain", "define"]
NAVIGATIONAL = ["login", "homepage", "website", "site", "official", "download", "docs", "documentation"]
TRANSACTIONAL = ["buy", "price", "pricing", "install", "download", "subscribe", "order", "cost"]
COMPARISON = ["vs", "versus", "compare", "comparison", "difference", "differences", "better"]
FILLER = ["please", "tell", "show", "find", "give", "explain", "know", "want", "need", "like", "looking", "anyone", "someone", "thing", "things"]

# Synonyms by surface word.
SYNONYMS: dict[str, list[str]] = {
    "ai": ["artificial intelligence", "machine learning"],
    "ml": ["machine learning"],
    "js": ["javascript"],
    "javascript": ["js"],
    "db": ["database"],
    "database": ["db"],
    "car": ["automobile", "vehicle"],
    "automobile": ["car"],
    "fast": ["quick", "performance"],
    "quick": ["fast"],
    "bug": ["error", "defect"],
    "error": ["bug", "exception"],
    "doc": ["document", "documentation"],
    "docs": ["documentation"],
    "api": ["interface", "endpoint"],
    "k8s": ["kubernetes"],
    "kubernetes": ["k8s"],
    "nlp": ["natural language processing"],
    "search": ["retrieval"],
    "retrieval": ["search"],
    "movie": ["film"],
    "film": ["movie"],
    "big": ["large"],
    "large": ["big"],
    "small": ["tiny", "little"],
    "begin": ["start"],
    "start": ["begin"],
    "tutorial": ["guide", "introduction"],
    "guide": ["tutorial"],
}

# Ranking parameters.
K1 = 1.2
TITLE_WEIGHT, BODY_WEIGHT = 3.0, 1.0
TITLE_B, BODY_B = 0.5, 0.75
EXPANSION_WEIGHT = 0.35
COVERAGE_FLOOR = 0.4
PROXIMITY_WEIGHT = 0.6
PHRASE_BONUS = 1.5
SNIPPET_WORDS = 32
SPELLING_CANDIDATES = 5000
