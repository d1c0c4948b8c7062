"""Each operator against a brute-force version on small tables with nulls, empty texts, repeated rows and odd characters."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from inkwell.llm import chat, decontamination, licences, neighbours, pieces, quality, simhash, substring, tokenfiles, toxicity
from inkwell.llm.components import connected_components
from inkwell.llm.shared import Workspace
from inkwell.llm.xxh64 import xxh64

RNG = random.Random(4)
VOCABULARY = ["alpha", "beta", "Gamma", "delta", "naïve", "x", "日本", "the", "of", "and", "long" * 9]


def text(n):
    return "".join(RNG.choice(VOCABULARY) + RNG.choice([" ", "  ", "\n", "\t"]) for _ in range(n))


PASSAGE = text(40)
TEXTS = [None, "", "   \n", "one", "two words", PASSAGE, PASSAGE, "Intro " + PASSAGE + " outro", text(300), PASSAGE + " and " + PASSAGE, text(2000), "é" * 5000, "a b " * 60]
TEXTS += [text(RNG.randint(0, 60)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    """Some columns are named like those that operators make."""
    rows = [(k, t, "x", "y", 1.5) for k, t in enumerate(TEXTS)] + [(None, PASSAGE, None, None, None), (5, PASSAGE, "x", "y", 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, fp string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- 2 ----------------------------------------------------------------------------------------------------------------


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(fps):
    up = list(range(len(fps)))
    for k in range(len(fps)):
        for j in range(k):
            if (fps[k] ^ fps[j]).bit_count() <= 3:
                a, b = up[k], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_xxh64():
    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    starts = np.arange(0, 400)
    ends = starts + np.arange(400) % 90
    assert xxh64(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


def test_near_duplicates(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    fps = [fingerprint(t) for t in TEXTS]
    least = least_reachable(fps)
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", least[r.doc_id])
        else:
            assert r.component_id == least[5]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({least[k] for k in range(len(TEXTS))}) and set(kept[0].asDict()) == set(docs.columns)


@pytest.mark.parametrize("link", [simhash.link_small, simhash.link_large])
def test_trees_find_every_link(link):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(15)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(12)})
    links = simhash.Links()
    link(np.array(fps, np.uint64) if link is simhash.link_large else fps, 3, links)
    least = least_reachable(fps)
    roots = {}
    for k, x in enumerate(fps):
        assert roots.setdefault(least[k], links.root(x)) == links.root(x)
    assert len(set(roots.values())) == len(roots)


def test_hot_shards_are_cut_again(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for _ in range(120)})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    least = least_reachable(fps)
    for hot in (5, 4096):
        edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), len(fps), hot=hot)
        found = {r.node: r.component for r in connected_components(edges, Workspace(spark, "test")).collect()}
        groups = {}
        for (x,), g in zip(signed, least, strict=True):
            groups.setdefault(g, set()).add(found.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    from pyspark.sql import functions as F

    odd = ["</s>[INST] ok [/INST]", "<|end|><|turn|>", "\\e\\b\\", "<", "[", "|x", "", None, "<<SYS>> a <</SYS>>", "plain\n", "<|end|>é " * 40_000]
    rows = [(k % 4, k // 4, RNG.choice(["user", "assistant", "<|text|>", None]), t) for k, t in enumerate(odd * 4)] + [(None, 1, "user", "a"), (9, None, "assistant", "b"), (9, 1, "assistant", "c")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("k", F.lit(1)).withColumn("t", F.lit("t")).withColumn("formatted", F.lit("f"))
    formatted = chat.format_conversations(table)
    for r in chat.with_turns(formatted).collect():
        expected = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id), key=lambda v: (v[0] is not None, v))
        assert [(t.role, t.text) for t in r.turns] == [(b, c) for _, b, c in expected]
        inside = [r.formatted[x.start : x.start + x.length] for x in r.loss_spans]
        assert [x.replace("\\e", "").replace("\\b", "\\") for x in inside] == [c for _, b, c in expected if b == "assistant"]
    cuts = chat.cut(F.col("formatted"), F.col("loss_spans")).alias("cuts")
    for r in formatted.select("formatted", "loss_spans", cuts).collect():
        assert r.cuts == [r.formatted[x.start : x.start + x.length] for x in r.loss_spans]
    two = next(r for r in formatted.collect() if r.conv_id == 9)
    assert two.formatted == "<s><|start|>assistant<|text|>b<|turn|>c<|end|></s>"
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------------------------


def removed(rows):
    """rows: (id, text); gives for each the set of removed words."""
    first, out = {}, []
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    place = lambda i, k: (i is not None, i or 0, k)
    for i, w in split:
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, place(i, k)), place(i, k))
    for i, w in split:
        out.append({j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < place(i, k) for j in range(k, k + 20)})
    return split, out


@pytest.mark.parametrize("batches", [1, 5])
def test_substrings(docs, empty, batches):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    split, gone = removed(rows)
    expected = sorted(((i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for (i, w), g in zip(split, gone, strict=True)), key=str)
    found = substring.remove_repeats(docs, ["doc_id", "fp"], batches=batches, buckets=4).collect()
    assert sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == expected
    assert sum(r.n_removed for r in found) > 100
    for r in found:
        if not r.n_removed and r.row.doc_id is not None:
            assert r.kept == TEXTS[r.row.doc_id]
    if batches == 1:
        assert substring.remove_repeats(empty, ["doc_id"], buckets=4).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontamination(spark, docs, empty, limit):
    items = [(1, PASSAGE), (2, "  ALPHA, beta! "), (3, None), (10, ""), (None, "the of"), (4, text(25)), (4, text(12)), (5, "—é naïve")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = {}
    for i, t in items:
        w = re.findall(rx, lower(t))
        if i is not None and w:
            for k in range(max(len(w) - 9, 1)):
                wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    found = decontamination.find_contamination(docs, table, ["doc_id", "score"], limit=limit).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.row.doc_id is None:
            continue
        w = re.findall(rx, lower(TEXTS[r.row.doc_id]))
        hit, owners = set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    owners |= own
        assert (r.n_words, {x for s in r.spans for x in range(s["first"], s["last"])}, r["items"]) == (len(w), hit, sorted(owners))
    assert decontamination.character_spans("é, Two three", [(1, 3)]) == [(3, 12)]
    if limit > 60:
        assert decontamination.find_contamination(empty, table, ["doc_id"]).count() == 0
        assert not any(r.spans for r in decontamination.find_contamination(docs, table.limit(0), ["doc_id"]).collect())


def test_a_large_benchmark_takes_little_memory():
    """4 MB of random words, dealt as ``find_contamination`` does, with each automaton under 250 MB; every planted window is found."""
    code = """
import random, resource, sys
import pyarrow as pa
sys.path.insert(0, sys.argv[1])
from inkwell.llm import decontamination as d
from inkwell.llm.wordscan import chunks
rng = random.Random(1)
items = [(str(k), " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(70))) for k in range(8000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
part = items[: d.AUTOMATON_WORDS // 70]
m = d.Matcher(part)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
texts = []
for i, t in part[:200]:
    w = t.split()
    at, n = rng.randrange(55), rng.choice([9, 10, 13])
    texts.append("the of " + " ".join(w[at : at + n]) + " and")
got = [r for c in chunks(pa.array(texts)) for r in m.scan(c)]
assert all((r[1], r[2]) == (([(2, n - 1)], {part[k][0]}) if n - 3 >= 10 else ([], set())) for k, r in enumerate(got) for n in [len(texts[k].split())])
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 250


# --- 4, 3 -------------------------------------------------------------------------------------------------------------


def test_pieces(docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["  a", "\n\n b", "日本 ﬁ", " " * 90 + "x", "a" * 70, "<s> </s>", "\r\n x"] + ["".join(RNG.choice("abcdef  \n.-=0é日") for _ in range(50)) for _ in range(300)]
    codec = pieces.Codec(pieces.load())
    got = [ids[a:b].tolist() for ids, at, _, _ in codec.encode(pa.array(odd)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == library.encode(odd)
    for r in pieces.encode_documents(docs, ["doc_id"]).collect():
        expected = TEXTS[r.row.doc_id] if r.row.doc_id is not None else PASSAGE
        assert r.ids == library.encode(expected or "") and r.n_ids == len(r.ids) and r.round_trip
    assert pieces.encode_documents(empty, ["doc_id"]).count() == 0
    assert [r.round_trip for r in pieces.encode_documents(docs.limit(1).selectExpr("1L AS doc_id", "'a▁b' AS text"), ["doc_id"]).collect()] == [False]


def test_best_paths_of_a_unigram_model():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -2.2, "ba": -2.0, "aba": -6.0}
    v = pieces.Vocabulary({p: k + 256 for k, p in enumerate(scores)}, scores, list(range(256)), [b""] * 300, False, 3)

    def best(word):
        if not word:
            return 0.0, ()
        return max((best(word[:-n])[0] + scores[word[-n:]], best(word[:-n])[1] + (v.ids[word[-n:]],)) for n in range(1, min(3, len(word)) + 1) if word[-n:] in scores)

    words = sorted({"▁" + "".join(RNG.choice("ab") for _ in range(RNG.randint(1, 8))) for _ in range(60)})
    for word, ids in zip(words, pieces.Encoder(v).words(words), strict=True):
        by_id = {k: p for p, k in v.ids.items()}
        assert abs(sum(scores[by_id[k]] for k in ids) - best(word)[0]) < 1e-9


def test_token_counts(docs, empty):
    import base64

    import tiktoken

    with open(tokenfiles.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=tokenfiles.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for block in (64, 1 << 20):
        for r in tokenfiles.token_counts(docs, block_bytes=block).collect():
            t = TEXTS[r.doc_id] if r.doc_id is not None else PASSAGE
            assert r.n_tokens == len(encoding.encode_ordinary(t or ""))
    assert tokenfiles.token_counts(empty).count() == 0


def test_unclosed_files(spark, tmp_path):
    streams = {"a": [5, 6, 50256, 50256, 7], "b": [1] * 9, "c": [], "d": [50256]}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(n,) for n in streams], "file string")
    for block in (2, 4, 64):
        found = tokenfiles.count_tokens(files, f"file://{tmp_path}", Workspace(spark, "t"), block).collect()
        assert sorted((r.file, r.ordinal, r.n_tokens) for r in found) == [("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("b", 0, 9), ("d", 0, 0)]


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 20))
    x[300:330] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(700, None), (800, [0.0] * 20), (900, [float("nan")] * 20), (1000, [1.0]), (None, x[1].tolist()), (42, x[42].tolist()), (1100, [None] * 20)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {}
    for r in neighbours.nearest_neighbours(table, every=20, bucket_rows=50).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((np.arange(600), d)) if k != q][:10]
        assert sorted(got) == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for v, s in got.values())
        hits += len({v for v, _ in got.values()} & set(best))
    assert hits >= 0.9 * 10 * len(found) and [v for v, _ in (found[0][k] for k in range(1, 11))] == list(range(300, 310))
    few = table.where("vec_id < 4").collect()
    assert neighbours.nearest_neighbours(spark.createDataFrame(few, table.schema), every=1).count() == 12
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0


def test_neighbours_with_an_id_repeated_often(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=16) + 0.01 * rng.normal(size=(40, 16))  # one bucket in each table
    near = [(1, (x[0] + 0.0001 * rng.normal(size=16)).tolist()) for _ in range(20)]
    rows = [(k, v.tolist()) for k, v in enumerate(x) if k != 1] + near
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    got = sorted(neighbours.nearest_neighbours(table, every=40, probes=32).collect(), key=lambda r: r["rank"])
    least = {}
    for k, v in rows[1:]:
        least[k] = min(least.get(k, np.inf), float(np.sqrt(((np.array(v) - x[0]) ** 2).sum())))
    assert [r.vec_id for r in got] == sorted(least, key=least.get)[:10]
    assert all(abs(r.score - least[r.vec_id]) < 1e-12 for r in got)


def test_neighbours_of_huge_tiny_and_distant_vectors(spark):
    """Squares that overflow or vanish, a large common offset, repeated ids with different vectors, and columns with clashing names."""
    rng = np.random.default_rng(2)
    tables = {
        "huge": [[1e200, 1.0], [1e200, 2e199], [-1e308, 1e308], [1e308, -1e308], [1.0, 1.0], [3.0, 1.0]],
        "tiny": [[1e-200, 1e-200], [2e-200, 1e-200], [1e-200, 5e-200], [1e-300, -1e-200]],
        "offset": (1e7 + 1e-3 * rng.normal(size=(60, 8))).tolist(),
    }
    for name, vectors in tables.items():
        rows = [(k, v, 1, [0], "x") for k, v in enumerate(vectors)] + [(1, vectors[-1], 1, [0], "x"), (0, vectors[-1], 1, [0], "x")]
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int, keys array<int>, v string").repartition(2)
        x = min(vectors[0], vectors[-1])
        least = {}
        for k, v, *_ in rows:
            if k:
                least[k] = min(least.get(k, np.inf), float(np.hypot.reduce(np.array(v) / 2 - np.array(x) / 2) * 2))
        got = sorted(neighbours.nearest_neighbours(table, every=100, probes=16).collect(), key=lambda r: r["rank"])
        exact = np.array([least[r.vec_id] for r in got])
        assert len(got) == min(10, len(least)) and np.allclose([r.score for r in got], exact, rtol=1e-12, atol=0), name
        assert np.allclose(exact, sorted(least.values())[: len(got)], rtol=1e-9, atol=0), name


def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = {}
    for r in neighbours.nearest_neighbours(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        hits += len(got & set([v for v in ids[np.lexsort((ids, d))].tolist() if v != q][:10]))
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(found)


# --- 9, 1, 8 ----------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    told = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    model = toxicity.train(table, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = [d for d in told if not zlib.crc32(str(d).encode()) % 5]
    rows = {r.doc_id: r.text for r in table.where(table.doc_id.isin(held)).collect()}
    p = toxicity.scores(model, pa.array([rows[d] for d in rows]))
    y = np.array([told[d] for d in rows])
    assert (p[y == 1] >= 0.5).mean() > 0.75 and (p[y == 0] < 0.5).mean() > 0.98
    plain = toxicity.scores(model, pa.array(["you idiot, a total moron", "you idxiot, a total m.o.r.o.n", "", None, "the and of"]))
    assert plain[0] > 0.5 and plain[1] > 0.5 and (plain[2:] < 0.5).all() and plain[2] == plain[3]


def test_toxicity_edges(spark, docs, empty):
    model = toxicity.fit([], np.zeros(0))
    assert toxicity.score_documents(docs, model, ["doc_id", "score"]).count() == docs.count()
    assert toxicity.score_documents(empty, model, ["doc_id"]).count() == 0
    nobody = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    assert (toxicity.scores(toxicity.train(docs, nobody), pa.array(["x", None])) < 0.5).all()


def phi(word):
    """Each subsequence of three letters that spans at most six, with the sum of its decays, over the norm of its length."""
    out = {}
    for i in range(len(word)):
        for k in range(i + 2, min(i + 6, len(word))):
            for j in range(i + 1, k):
                out[word[i] + word[j] + word[k]] = out.get(word[i] + word[j] + word[k], 0) + 0.7 ** (k - i - 1)
    spans = [k - i for i in range(len(word)) for k in range(i + 2, min(i + 6, len(word))) for _ in range(k - i - 1)]
    norm = sum(0.7 ** (2 * (s - 1)) for s in spans) ** 0.5
    return {c: v / norm for c, v in out.items()}


def test_the_subsequence_kernel_and_its_landmarks():
    """Against a naive kernel; features of landmarks reproduce the kernel, those of other words its projection on the landmarks."""
    words = ["moron", "mo.ron", "mxoron", "banana", "aaaaaaaa", "ab", "anagram", "idiot", "diotic"]
    plain = [re.sub(r"\W", "", w) for w in words]
    naive = np.array([[sum(v * phi(b).get(c, 0) for c, v in phi(a).items()) for b in plain] for a in plain])
    u = toxicity.units(next(iter(toxicity.chunks(pa.array([" ".join(words)])))))
    ends = np.append(u.starts[1:], len(u.symbols))
    symbols = [u.symbols[a:b] for a, b in zip(u.starts, ends, strict=True)]
    held = [0, 3, 6, 7]
    marks = toxicity.Landmarks([symbols[k] for k in held])
    assert np.allclose(marks.kernel(u), naive[:, held], atol=1e-5)
    f = marks.features(u)
    assert np.allclose(f @ f.T, naive[:, held] @ np.linalg.inv(naive[np.ix_(held, held)]) @ naive[held], atol=1e-4)
    w = np.random.default_rng(1).normal(size=f.shape[1])
    assert np.allclose(toxicity.decisions(u, marks.table(w)), f @ w, atol=1e-4)


def test_quality_by_hand(spark):
    """Every posterior from the evidence, by plain sums; hosts of one document, a host of many paths, null sites, repeated rows."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(k, text(rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", None]), rng.choice(["p", "q", None]), 0.1, "m") for k in range(80)]
    rows += [(100 + k, text(5), f"host{k}", "p", 0.1, "m") for k in range(4)] + rows[:2]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, h string, p string, evidence double, m string").repartition(3)
    model = quality.fit(quality.measures(pa.array([r[1] for r in rows])), np.array([len(r[1]) > 150 for r in rows], np.float64))
    for part in (table, table.where("h = 'b'")):
        found = quality.score_quality(part, model, F.col("h"), F.col("p")).collect()
        assert len(found) == part.count() > 0
        n, good = {}, {}
        for r in found:
            for key in ("", (r.host,), (r.host, r.path)):
                n[key], good[key] = n.get(key, 0) + 1, good.get(key, 0) + r.evidence
        corpus = (good[""] + 0.5) / (n[""] + 1)

        def strength(keys, parent, n=n, good=good):
            total = sum(n[k] for k in keys)
            mean = sum(good[k] for k in keys) / total
            between = sum(n[k] * (good[k] / n[k] - parent(k)) ** 2 for k in keys) / total
            return max(1, min(1e4, mean * (1 - mean) / max(between - mean * (1 - mean) * len(keys) / total, 1e-9)))

        hosts, paths = [k for k in n if len(k) == 1], [k for k in n if len(k) == 2]
        k0 = strength(hosts, lambda k: corpus)
        of_host = {k: (good[k] + k0 * corpus) / (n[k] + k0) for k in hosts}
        k1 = strength(paths, lambda k: of_host[k[:1]])
        odds = lambda p: np.log(p / (1 - p))
        for r in found:
            key = (r.host, r.path)
            site = (good[key] - r.evidence + k1 * of_host[key[:1]]) / (n[key] - 1 + k1)
            z = odds(min(max(r.evidence, 1e-9), 1 - 1e-9)) + odds(min(max(site, 1e-6), 1 - 1e-6)) - odds(corpus)
            assert abs(r.site - site) < 1e-6 and abs(r.quality - 1 / (1 + np.exp(-z))) < 1e-6 and r.keep == (r.quality >= 0.5)


def test_quality(spark, docs, empty):
    from pyspark.sql import functions as F

    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(table, labels)
    rows = {r.doc_id: r for r in quality.score_quality(table, model, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    told = {r.doc_id: r.quality for r in labels.collect() if not zlib.crc32(str(r.doc_id).encode()) % 5}
    assert np.mean([rows[d].keep == (q == 1) for d, q in told.items()]) > 0.95
    # the priors, by hand
    n, good = {}, {}
    for r in rows.values():
        for key in (r.host, (r.host, r.path), ""):
            n[key], good[key] = n.get(key, 0) + 1, good.get(key, 0) + r.evidence
    mean = (good[""] + 0.5) / (n[""] + 1)
    sparse = min(rows.values(), key=lambda r: n[r.host, r.path])
    own = (good[sparse.host, sparse.path] - sparse.evidence) / max(n[sparse.host, sparse.path] - 1, 1)
    assert min(own, mean, good[sparse.host] / n[sparse.host]) - 1e-6 <= sparse.site <= max(own, mean, good[sparse.host] / n[sparse.host]) + 1e-6
    assert quality.score_quality(docs, model, F.col("id"), F.col("fp")).count() == docs.count()
    assert quality.score_quality(empty, model, F.col("id"), F.col("fp")).count() == 0


def test_licences(spark):
    from pyspark.sql import functions as F

    word = " ".join(["filler"] * 60)
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "# Licensed under the Apache License, Version 2.0\n" + word),
        (3, "a/b/c/y.py", word),
        (4, "a/b/COPYING.txt", "Some words first, then: This work is licensed under the GNU General Public License, version 3\n" + word),
        (5, "a/z.py", None),
        (6, "q/z.py", ""),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "top.txt", "the of and to"),
        (9, "a/b/c/d/e.py", word + " Licensed under CC BY 4.0. " + word),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    found = {r.doc_id: r for r in licences.scan_licences(table, F.col("path"), threshold=0.5).collect()}
    assert {k: r.own for k, r in found.items() if r.own} == {1: "MIT", 2: "Apache-2.0", 4: "GPL-3.0", 7: "CC-BY-NC-4.0", 9: "CC-BY-4.0"}
    assert (found[3].licence, found[3].origin) == ("GPL-3.0", "a/b") and (found[5].licence, found[5].origin) == ("MIT", "a")
    assert found[2].origin == "text" and found[6].licence is None and found[8].licence is None and found[9].licence == "CC-BY-4.0"
    assert licences.scan_licences(table.limit(0), F.col("path")).count() == 0


def test_embedded_licence_notices():
    """At the production threshold, with few and with many documents."""
    word = " ".join(["filler"] * 60)
    texts = {
        word + " Licensed under CC BY 4.0. " + word: "CC-BY-4.0",
        word + " Released under the MIT\nLicense, " + word: "MIT",
        "Released under the MIT License by two people": "MIT",
        word + " Licensed under CC BY-SA 4.0 " + word: "CC-BY-SA-4.0",
        "the " + word + " of the License " + word: None,
    }
    for n in (10, 10_000, 10_000_000):
        v = licences.Vocabulary()
        v.weigh(n, np.full(len(v.terms), n // 20))
        assert [r[0] for r in licences.scan(pa.array(list(texts)), v)] == list(texts.values()), n
        assert all(r[2] < 0.2 for r in list(licences.scan(pa.array(list(texts)), v))[:2])
