import os
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import jaccard, shared, simhash
from inkwell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0.7 * before <= docs.count() <= before, name
    for r in docs.collect():
        assert r.text == source[r.doc_id].text or len(r.text.split()) < len(source[r.doc_id].text.split())
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(coded) == docs.count() and all(r.round_trip for r in coded)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.choice([3, 20, 60, 200]))] for _ in range(12)]
    common = ["all", "rights", "reserved", "by", "the", "owner", "of", "this", "text"]
    texts = [None, "", "one two", "One  TWO", "one two three"]
    for k in range(160):
        words = list(base[k % 12])
        for _ in range(rng.randint(0, 1 + len(words) // 25)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        texts.append(" ".join(words + common * (k % 3 == 0)))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    least = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    assert 20 < len(set(least)) < 150
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    usual = jaccard.CLUSTER, jaccard.SHARD, jaccard.HUB_PAIRS
    for cluster, shard, hub in (usual, (6, 8, 3)):
        jaccard.CLUSTER, jaccard.SHARD, jaccard.HUB_PAIRS = cluster, shard, hub
        assert {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()} == dict(enumerate(least))
    jaccard.CLUSTER, jaccard.SHARD, jaccard.HUB_PAIRS = usual
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == sorted(set(least))
    assert jaccard.near_copies(docs.limit(0)).count() == 0


def test_trees_link_every_pair_within_the_radius():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    fp = np.concatenate([fp ^ np.uint64((1 << 21) - 1 << k) for k in (0, 5, 30)] + [fp, fp[:7]])
    near = [(i, j) for j in range(len(fp)) for i in range(j) if int(fp[i] ^ fp[j]).bit_count() <= jaccard.RADIUS]
    wanted = simhash.Links()
    for i, j in near:
        wanted.add(i, j)
    for leaf in (0, 1, 5, 400):
        links = simhash.Links()
        jaccard.link_tree(fp, np.full(len(fp), 10), np.arange(len(fp)), links, leaf)
        assert [links.root(k) for k in range(len(fp))] == [wanted.root(k) for k in range(len(fp))]


def test_shards_over_batch_ends():
    rng = random.Random(1)
    rows = sorted({(rng.randrange(12), rng.randrange(1000)) for _ in range(40)})
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 3]))]
    token, key = (np.array([r[k] for r in rows]) for k in (0, 1))
    zero = np.zeros(len(rows), np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (token, key, zero.astype(np.int32) + 9, key, zero)], names=["token", "order", "n", "key", "fp"])
    groups = {}
    for t, k in sorted(set(rows)):
        groups.setdefault(t, []).append(k)
    wanted = [(t, k, g[0] if k != g[0] else None) for t, g in groups.items() if len(g) > 1 for k in g]
    for size in (1, 2, 3, 7, 100):
        cut = [whole.slice(k, size) for k in range(0, len(rows), size)]
        got = [(r["token"], r["key"], r["root"]) for b in jaccard._shards(iter(cut)) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted(wanted, key=str), size


def test_no_text_is_lost_with_repeated_or_missing_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "b " * 9, "x"), (5, "a " * 9, "x"), (5, "b " * 9, "y"), (5, "a " * 9, "x"), (7, long, "x"), (7, long, "y"), (None, long, "z"), (None, "c " * 9, "z"), (None, "C " * 9, "a"), (8, None, None), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(3)
    for how in ({}, {"find": jaccard.set_groups, "key": jaccard.set_keys}):
        kept = [tuple(r) for r in simhash.one_of_each(docs, **how).collect()]
        assert len(kept) == 5 and {(i, (t or "")[:1].lower()) for i, t, _ in kept} == {(1, "b"), (5, "a"), (7, "o"), (None, "c"), (8, "")}
        assert sorted(map(str, kept)) == sorted(str(tuple(r)) for r in simhash.one_of_each(docs.repartition(1), **how).collect())


def test_stages_on_odd_tables(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows, an extra column with a clashing name, and no rows."""
    words = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, "plain words here", "en", "a", 1, 0.5), (1, None, None, None, None, None), (1, "", "en", "a", 0, 1.0), (2, words, "en", "a", 9, 0.1), (2, words, "en", "a", 9, 0.1), (3, "x y z " * 40, "en", "a", 2, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = {(r.doc_id, (r.text or "")[:2]) for r in docs.collect()}
    assert kept == {(None, "pl"), (1, ""), (2, "w0"), (3, "x ")}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_small_sets_with_distant_fingerprints(spark):
    """Nine words and the first eight of them have five and four shingles, a similarity of exactly 0.8, and fingerprints as they fall."""
    rng, texts = np.random.default_rng(9), []
    for k in range(4000):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 9)]
        texts += [" ".join(words), " ".join(words[:8])]
    (chunk,) = jaccard.chunks(pa.array(texts))
    hashes, rows, _ = jaccard.shingle_sets(chunk)
    fps = jaccard.fingerprints(hashes, rows)
    far = np.argsort(-np.bitwise_count(fps[0::2] ^ fps[1::2]).astype(int), kind="stable")[:30]
    docs = spark.createDataFrame([(2 * i + j, texts[2 * k + j]) for i, k in enumerate(far.tolist()) for j in (0, 1)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert got == {k: k // 2 * 2 for k in range(60)}


def test_few_shingles_are_linked_by_size():
    n, links = np.array([4, 5, 70, 63, 79, 200, 300, 90]), simhash.Links()
    group = jaccard.link_few(n, np.arange(8), links)
    assert group.tolist() == [0, 0, 2, 2, 2, 5, 6, 7] and links.root(3) == links.root(4) == links.root(2) and links.root(5) == 5


def test_only_wanted_texts_are_dealt(spark, tmp_path):
    """Of many texts a task sends those few on that are wanted, and the join keeps exactly these."""
    texts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(3000)]
    keys = jaccard.set_keys(pa.array(texts))
    wanted = spark.createDataFrame([(int(k),) for k in keys[::500]] * 2, "key bigint")
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    sent = [k for b in jaccard._fresh_texts(jaccard._key_map(wanted))(iter([batch, batch])) for k in b.column(0).to_pylist()]
    assert set(keys[::500].tolist()) <= set(sent) and len(sent) <= 10
    docs = spark.createDataFrame([(t,) for t in texts + texts[:600]], "text string").repartition(3)
    work = jaccard.Workspace(spark, "wanted")
    assert sorted((r.key, r.text) for r in jaccard._texts_of(wanted, docs, work, "some").collect()) == sorted(zip(keys[::500].tolist(), texts[::500], strict=True))


def test_near_copies_leave_no_tables_behind(spark, monkeypatch):
    """Only what the last, lazy step reads stays on disk."""
    made = []
    monkeypatch.setattr(simhash, "Workspace", lambda *a: made.append(jaccard.Workspace(*a)) or made[-1])
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[: 60 - k % 3] + [f"x{k // 3}"])) for k in range(30)], "doc_id bigint, text string")
    kept = simhash.one_of_each(docs, find=jaccard.set_groups, key=jaccard.set_keys)
    left = {n for n in os.listdir(made[0].path.removeprefix("file://")) if not n.startswith(("edges-", "half-"))}
    assert left == {"stays"} and 0 < kept.count() < 30


def test_shuffle_files_go_when_a_table_is_kept(spark, monkeypatch):
    monkeypatch.setattr(shared, "SWEEP_S", 0)
    tracker, work = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker(), shared.Workspace(spark, "swept")
    for k in range(20):
        work.keep(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), f"t-{k}")
    for _ in range(50):
        if tracker.shuffleStatuses().size() < 20:
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() < 20
