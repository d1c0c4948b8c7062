"""Hard negatives, Merkle manifests and coded token files against brute-force versions, on tables with nulls, ties, repeats and odd characters."""

import hashlib
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import hardnegatives, merkle, queries, tokenbits
from inkwell.llm.shared import Workspace, shared_dir

RNG = random.Random(12)

# --- 11 ---------------------------------------------------------------------------------------------------------------


def vectors():
    rows = [(k, [RNG.gauss(0, 0.4) for _ in range(6)], RNG.randrange(4)) for k in range(400)]
    hot = [0.5, 0.5, -0.5, 0.25, 0.0, 0.1]
    rows += [(k, hot, k % 3) for k in range(400, 900)]  # many equal scores
    rows += [(900, None, 1), (901, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (902, [math.nan] * 6, 2), (903, [math.inf] + [0.0] * 5, 2), (904, hot, None), (None, hot, 1)]
    rows += [(905, [0.3, 0.2], 1), (906, [], 2), (907, [1e30] * 6, 1), (908, [-1e30] * 6, 2), (1000, [1e18, 0.0, 0.0, 0.0, 0.0, 0.0], 3), (-100, hot, 0), (100, hot, 0), (100, hot, 0), (401, hot, 3)]
    return rows


def whole(x):
    return math.floor(x * 256)


def mined(rows, positives=5, negatives=5):
    by_id = {}
    for k, v, label in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if k not in by_id or (label, v) < by_id[k]:
            by_id[k] = (label, v)
    ints = {k: [whole(x) for x in v] for k, (_, v) in by_id.items()}
    most = (1 << 63) - 1
    out = []
    for a, (label, _) in by_id.items():
        if a % 100:
            continue
        scores = {k: min(max(sum(x * y for x, y in zip(ints[a], v)), -most), most) for k, v in ints.items() if k != a}  # a shorter vector ends in zeros
        ordered = sorted(scores, key=lambda k: (-scores[k], k))
        for p in [k for k in ordered if by_id[k][0] == label][:positives]:
            fits = [k for k in ordered if by_id[k][0] != label and 80 * scores[p] <= 100 * scores[k] <= 100 * scores[p]]
            out += [(a, p, r, k, scores[p], scores[k]) for r, k in enumerate(fits[:negatives], 1)]
    return sorted(out)


SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("few,digit", [(64, 12), (2, 3)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, few, digit):
    monkeypatch.setattr(hardnegatives, "FEW", few)
    monkeypatch.setattr(hardnegatives, "DIGIT", digit)
    monkeypatch.setattr(hardnegatives, "WINDOWS", 7)
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "score": F.lit(1), "vector": F.lit(2)}).repartition(3)
    got = hardnegatives.mine(table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_few_hard_negatives(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hardnegatives.mine(none).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 1)], SCHEMA)
    assert hardnegatives.mine(alone).collect() == []
    three = [(100, [1.0], 1), (1, [0.9], 1), (2, [0.8], 2)]
    assert sorted(map(tuple, hardnegatives.mine(spark.createDataFrame(three, SCHEMA)).collect())) == mined(three) == [(100, 1, 1, 2, 58880, 52224)]


# --- 12 ---------------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(built, k):
    out = []
    for level in built[:-1]:
        first = k // 3 * 3
        out.append(("".join(level[first:k]), "".join(level[k + 1 : first + 3])))
        k //= 3
    return out


def trees(rows):
    """Of (group, key, leaf): (key, leaf, place, total, subroot, root, path)."""
    groups = {}
    for g, key, leaf in rows:
        groups.setdefault(g, []).append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([built[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for k, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((x[3], x[2], k, len(groups[g]), built[g][-1][0], top[-1][0], siblings(built[g], k) + siblings(top, i)))
    return out


@pytest.mark.parametrize("rows_a_partition,jump", [(1 << 15, 12), (9, 1), (25, 2)])
def test_merkle_by_brute_force(spark, rows_a_partition, jump):
    rows = [("hot", k, sha(str(k))) for k in range(300)] + [(None, k, sha("n")) for k in range(5)] + [("", 1, sha("e")), ("é", 2, sha("f")), ("z", None, sha("g")), ("z", None, sha("g")), ("z", 3, sha("h"))]
    rows += [("hot", 7, sha("7"))] * 20 + [(f"g{k % 40}", k, sha("x", str(k))) for k in range(90)]
    table = spark.createDataFrame(rows, "source string, doc_id bigint, digest string").withColumns({"g": F.lit("clash"), "leaf": F.lit(0), "path": F.lit(1)}).repartition(5)
    got = merkle.manifest(table, "source", ["doc_id"], "digest", ["doc_id", "path"], rows_a_partition, jump)
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r.folded == r.root and r.row.path == 1 for r in got)
    found = [(r.row.doc_id, r.leaf, r.place, r.total, r.subroot, r.root, [tuple(p) for p in r.path]) for r in got]
    assert sorted(found, key=repr) == sorted(trees(rows), key=repr)


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([("a", 1, sha("x"))], "s string, k int, digest string")
    (r,) = merkle.manifest(one, "s", ["k"], "digest", ["k"]).collect()
    assert r.leaf == r.subroot == r.root == sha("x") and r.path == []
    assert merkle.manifest(one.limit(0), "s", ["k"], "digest", ["k"]).collect() == []


def test_manifest_query(spark, tmp_path):
    rows = [(k, RNG.choice(["", "a\nb", "\n", "no end", "é\n" * 50]) if k % 9 else None, "en", RNG.choice(["s", None, "ü"]), k if k % 4 else None) for k in range(60)] + [(None, "x\ny", None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    by_leaf = {leaf_of(k, s, lang, n, t): (k, t, lang, s, n) for k, t, lang, s, n in rows}
    for key, leaf, _, _, subroot, root, path in trees([(s, k, leaf_of(k, s, lang, n, t)) for k, t, lang, s, n in rows]):
        k, t, lang, s, n = by_leaf[leaf]
        h = leaf_of(k, s, lang, n, t.replace("\n", "")) if k is not None and t is not None and zlib.crc32(str(k).encode()) % 2 == 0 else leaf
        for a, b in path:
            h = sha(a, h, b)
        want.append((key, leaf, subroot, root, sha(*(a + b for a, b in path)), h, h == root))
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.verified for r in got} == {True, False}


# --- 13 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(model):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model)


ALPHABET = "aAbB'sStT,.<|>15 \n\té́É—漢≠ßİ👍"
ODD = [
    None, "", " \n ", "It's don't STOP's 'sx ''s -'re x-'re-y 5's", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>!!", "J̌ ǰ Éé ≠ a≠ क़x", "Ünï—.x,— 漢字かな 12ab34 a b  c\x85d\x1ce",
    "́abc ́ a,́b", "ΑΣ İI", "👍🏽x", "x" * 5000, "|a|b<c>d'e \x00a\x00 \x7f", 'ends with "', '"',
] + ["".join(RNG.choices(ALPHABET, k=RNG.randrange(60))) for _ in range(400)]


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_as_the_library_encodes_them(model, library, monkeypatch):
    monkeypatch.setattr(tokenbits, "CHUNK_BYTES", 300)
    monkeypatch.setattr(tokenbits, "MEMO", 50)
    with open(model, encoding="utf-8") as f:
        encoder = tokenbits.WordEncoder(f.read())
    got = [x.tolist() for ids, at in encoder.encode(pa.array(ODD)) for x in np.split(ids, at[1:-1])]
    assert got == [ids_of(library, t)[:-1] for t in ODD]


@pytest.mark.parametrize("counts", [[], [5], [0, 3, 0], [1, 1], [0, 7, 1, 1, 0, 40, 2, 2], [2**k for k in range(40)], list(range(70000))])
def test_codes(counts):
    counts = np.array(counts, np.int64)
    lengths = tokenbits.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert lengths.max() <= max(tokenbits.LONGEST, 17) and math.isclose((0.5 ** lengths[lengths > 0].astype(float)).sum(), 1)
    code = tokenbits.Code(lengths)
    if (counts > 0).any():
        ids = np.random.default_rng(3).choice(np.flatnonzero(counts), 5000).astype(np.uint32)
        data, bits = code.encode(ids)
        sizes = np.minimum(tokenbits.LANE, len(ids) - tokenbits.LANE * np.arange(len(bits)))
        assert (code.decode(data, bits, sizes) == ids).all()


def test_shortest_codes_under_the_limit():
    """Against the best of all lengths, for a few symbols."""
    import itertools

    counts = np.array([1, 1, 2, 3, 5, 9])
    best = min(sum(a * b for a, b in zip(counts.tolist(), x, strict=True)) for x in itertools.product(range(1, 4), repeat=6) if sum(0.5**k for k in x) <= 1)
    assert int((tokenbits.code_lengths(counts, 3) * counts).sum()) == best


def test_blocks_are_read_alone():
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.4, n).clip(0, 9999).astype(np.uint32) for n in (0, 1, 70000, 3, 0, 200000, 256)]
    flat = np.concatenate(docs)
    code = tokenbits.Code(tokenbits.code_lengths(np.bincount(flat)))
    out = io.BytesIO()
    n_ids, n_bytes = tokenbits.write_file(out, code, [5, None, 7, -1, 8, 9, 10], docs)
    assert (n_ids, n_bytes) == (len(flat), len(out.getvalue()))
    out.seek(0)
    file = tokenbits.TokenFile(out, code)
    assert file.keys == [5, None, 7, -1, 8, 9, 10] and file.sizes.tolist() == [len(d) for d in docs]
    for first, last in ((2, 3), (0, file.n_blocks), (file.n_blocks - 1, file.n_blocks)):
        assert (file.blocks(first, last) == flat[first * tokenbits.BLOCK : last * tokenbits.BLOCK]).all()
    assert (file.ids(65530, 131100) == flat[65530:131100]).all() and len(file.ids(9, 9)) == 0


def test_token_files_by_brute_force(spark, model, library, monkeypatch):
    for name, value in (("BLOCK", 512), ("GROUP", 2), ("FILE_IDS", 3000)):
        monkeypatch.setattr(tokenbits, name, value)
    rows = [(k * 7 % 431, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again"), (3, "once more again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(1), "ids": F.lit("x"), "n": F.lit(0), "start": F.lit(0)}).repartition(5)
    got = sorted(tokenbits.write_and_read(docs, model).collect(), key=lambda r: r.start)
    want = sorted(((k, ids_of(library, t)) for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    start = 0
    for r, (key, ids) in zip(got, want, strict=True):
        assert (r.id, r.start, r.n_tokens) == (key, start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert tokenbits.write_and_read(docs.limit(0), model).collect() == []


def test_files_are_smaller_than_their_ids(spark, model):
    work = Workspace(spark, "bits-test")
    assert work.path.startswith(shared_dir(spark))
    docs = spark.createDataFrame([(k, "the cat sat on the mat and the dog " * 30) for k in range(50)], "doc_id bigint, text string")
    table, width = tokenbits.encoded(docs, model).cache(), tokenbits.width_of(model)
    folder = f"{work.path}/files"
    tokenbits.save_code(folder, tokenbits.code_lengths(tokenbits.counts_of(table, width)))
    total = work.keep(tokenbits.write_files(table, folder, width), "manifest").agg(F.sum("n_ids").alias("ids"), F.sum("n_bytes").alias("bytes"), F.sum("n_docs").alias("docs")).first()
    assert total.docs == 50 and total.bytes < total.ids * width / 2


# --- long words and repeated items ------------------------------------------------------------------------------------


def test_a_long_text_without_spaces_takes_linear_memory():
    import tracemalloc

    from inkwell.llm import pieces

    codec = pieces.Codec(pieces.load())
    text = "".join(RNG.choices("漢字かなé日本abcDEF+/=", k=60_000))
    tracemalloc.start()
    ((ids, at, _, _),) = codec.encode(pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sentencepiece = pytest.importorskip("sentencepiece")
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
    assert peak < 300 << 20


def test_repeated_items_take_one_pass(spark, monkeypatch):
    from inkwell.llm import decontamination

    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item)] * 3000 + [(2, "other words")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"so {item} end"), (2, "nothing")], "doc_id bigint, text string")
    kept = []
    monkeypatch.setattr(decontamination, "Workspace", lambda *x: kept.append(x))
    got = {r.row.doc_id: (r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in decontamination.find_contamination(docs, items, ["doc_id"], limit=1000).collect()}
    assert got == {1: (13, [(1, 12)], ["1"]), 2: (1, [], [])} and not kept
