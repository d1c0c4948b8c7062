"""What a Python process of the executors keeps between tasks stays small."""

from __future__ import annotations

import gc
import tracemalloc

import numpy as np
import pyarrow as pa

from inkwell.llm import pieces, shared, substring, wordscan


def _ids(codec, texts):
    return [ids[a:b].tolist() for ids, at, _, _ in codec.encode(texts) for a, b in zip(at, at[1:], strict=False)]


def test_words_are_remembered_in_few_bytes(monkeypatch):
    codec = pieces.Codec(pieces.load())
    texts = pa.array([" ".join(map(str, range(k, k + 2000))) for k in range(100_000, 130_000, 2000)])
    _ids(codec, pa.array(["1 2"]))
    wordscan.POWERS.clear()
    gc.collect()
    tracemalloc.start()
    found = [len(x) for x in _ids(codec, texts)]
    wordscan.POWERS.clear()
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(codec.keys) > 30_000 and held < 100 * 30_000 and min(found) > 2000
    few = pa.array(["one two  three", "", None, "zwölf three\ttwo", "one"])
    told = _ids(codec, few)
    monkeypatch.setattr(pieces, "MEMO", 1)  # all is forgotten at each turn
    assert _ids(codec, few) == _ids(codec, few) == told == _ids(pieces.Codec(pieces.load()), few)


def test_hashers_share_powers_for_a_task_and_give_them_back():
    data = np.frombuffer(b"some words ", np.uint8)
    at = np.array([0, 5]), np.array([4, 10])

    def run(batches):
        for _ in batches:
            yield wordscan.Hasher(1).words(data, *at), wordscan.Hasher(1).words(data, *at)

    (a, b), *_ = shared.frugal(run)(iter([1]))
    assert (a == b).all() and not wordscan.POWERS


def test_whole_copies_send_no_windows(spark, monkeypatch):
    """Copies of a text are told by its digest: neither their anchors are stored nor their windows sent."""

    def none_left(window, gram):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    raise AssertionError("windows were asked for")
                yield from ()

        return run

    monkeypatch.setattr(substring, "_window_rows", none_left)
    text, other = " ".join(map(str, range(100))), " ".join(map(str, range(200, 240)))
    rows = [(None, other), (1, "too short"), (2, text), (3, text), (4, other), (5, None), (6, "too short"), (7, text), (8, "")]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], buckets=4).collect()
    told = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in found}
    assert len(found) == len(rows) and told[3] == told[7] == (100, 100, "") and told[4] == (40, 40, "")
    assert {k for k, v in told.items() if v[1] == 0} == {None, 1, 2, 5, 6, 8} and told[6] == (2, 0, "too short")


def test_copies_among_rows_that_share_an_id(spark):
    text, other = " ".join(map(str, range(100))), " ".join(map(str, range(200, 240)))
    rows = [(1, text), (2, text), (2, other), (3, other), (3, other), (4, other + " " + text), (1, other)]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], buckets=4).collect()
    told = sorted((r.row.doc_id, r.n_words, r.n_removed) for r in found)
    assert [x for x in told if x[0] in (1, 3)] == [(1, 40, 0), (1, 100, 0), (3, 40, 40), (3, 40, 40)] and told[-1] == (4, 140, 140)
