"""Toxicity: a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

Instances are words, folded to a small alphabet: lower case, punctuation inside dropped, runs of single letters joined ("s t u ..."),
digits read as the letters they stand for.  The kernel counts common subsequences of three symbols that span up to ``SPAN``
symbols, each weighted by ``DECAY`` to the span, so inserted characters cost weight but don't break a match.  It is scaled by
word length.  The machine is trained on landmark features; as its decision is linear in the subsequences, it is then summed
into one weight for each subsequence, which gives the same scores at the cost of a few table look-ups a character.

A document is scored from its words' decisions by a logistic function.  Only documents have labels, so training is by multiple
instances: in a toxic document its highest words count as toxic, in a clean one every word is clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, frugal, give_back, row_of
from .wordscan import PLAIN_WORDS, Chunk, Hasher, chunks, edges

SPAN = 6
DECAY = 0.7
LANDMARKS = 256
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 2000
"""Labelled documents of either class that are fitted on at most, chosen by a hash of the id."""
TRAIN_CHARS = 20_000
"""Longer documents are scored, but not fitted on."""
PER_DOC = 2
"""Words of a toxic document that count as toxic in training."""
PART = 128
"""Documents that are folded and hashed at once in training: numbers of a word take far more memory than its text."""
ROUNDS = 5
TRAIN_WORDS = 12_000
"""Clean words fitted on at random, and half as many that the round before took for the most toxic."""
COST = 3.0
"""Cost of an error on one word of one document, against the machine's norm."""

OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
HASHES = Hasher(0x70C1C)


def alphabet() -> np.ndarray:
    """Bytes to 64 symbols; 0 is dropped.  A continuation byte stands for its character, whose case is a bit that goes."""
    out = np.zeros(256, np.uint8)
    out[97:123] = out[65:91] = np.arange(1, 27)
    for digit, letter in zip("0134578", "oieastb", strict=True):
        out[ord(digit)] = ord(letter) - 96
    for k, digit in enumerate("269"):
        out[ord(digit)] = 27 + k
    out[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    return out


SYMBOLS = alphabet()


@dataclass
class Units:
    """Folded words end to end: symbols, where each word starts, and the first word of each row."""

    symbols: np.ndarray
    starts: np.ndarray
    rows: np.ndarray


def units(chunk: Chunk) -> Units:
    """The folded words of a chunk's rows; words that fold to nothing are left out."""
    _, starts, ends, rows = edges(chunk, PLAIN_WORDS)
    symbols = SYMBOLS[chunk.data]
    sums = np.concatenate(([0], np.cumsum(symbols > 0)))
    lengths = sums[ends] - sums[starts]
    single = lengths == 1
    row = np.searchsorted(rows, np.arange(len(starts)), side="right")
    kept = np.flatnonzero(lengths)
    new = np.ones(len(kept), bool)
    if len(kept) > 1:
        new[1:] = ~(single[kept[1:]] & single[kept[:-1]]) | (row[kept[1:]] != row[kept[:-1]])
    first = kept[new]
    at = np.searchsorted(first, rows)
    return Units(symbols[symbols > 0], sums[starts[first]], at)


def _codes(u: Units, a: int, b: int) -> np.ndarray:
    """For each symbol that has one b places on: the code of itself, the one a places on and that."""
    s, n = u.symbols.astype(np.int32), len(u.symbols)
    return (s[: n - b] << 12) | (s[a : n - b + a] << 6) | s[b:] if n > b else s[:0]


def _left(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol: how many are left to its word's end, itself included; and the length of each word."""
    ends = np.append(u.starts[1:], len(u.symbols))
    return np.repeat(ends, ends - u.starts) - np.arange(len(u.symbols)), ends - u.starts


def decisions(u: Units, table: np.ndarray) -> np.ndarray:
    """For each word: the decayed sum of ``table`` over its subsequences, scaled by length."""
    if not len(u.starts):
        return np.zeros(0, np.float32)
    total = np.zeros(len(u.symbols), np.float32)
    left, lengths = _left(u)
    for a, b in OFFSETS:
        at = slice(0, max(len(u.symbols) - b, 0))
        total[at] += table[_codes(u, a, b)] * np.where(left[at] > b, np.float32(DECAY ** (b - 1)), np.float32(0))
    return np.add.reduceat(total, u.starts) / scale(lengths)


def scale(lengths: np.ndarray) -> np.ndarray:
    """The norm that a word of this length has if no subsequence comes twice; 1 for words too short for any."""
    square = sum(np.maximum(lengths - b, 0) * DECAY ** (2 * (b - 1)) for _, b in OFFSETS)
    return np.sqrt(np.where(square > 0, square, 1.0))


def feature_table(symbols: np.ndarray) -> np.ndarray:
    """The subsequence features of one word, as a table."""
    out = np.zeros(1 << 18, np.float32)
    symbols, n = symbols.astype(np.int32), len(symbols)
    for a, b in OFFSETS:
        if n > b:
            np.add.at(out, (symbols[: n - b] << 12) | (symbols[a : n - b + a] << 6) | symbols[b:], DECAY ** (b - 1))
    return out / scale(np.array([n]))[0]


class Landmarks:
    """Nyström features: a word's kernel to each landmark, times the inverse root of the landmarks' own kernel.

    Only the subsequences that some landmark has are kept, a row each in ``values``; the last row, of zeros, is for all others.
    """

    def __init__(self, words: list[np.ndarray]):
        held = []
        for w in words:
            table = feature_table(w)
            at = np.flatnonzero(table)
            held.append((at, table[at]))
        self.codes = np.unique(np.concatenate([at for at, _ in held]))
        self.row = np.full(1 << 18, len(self.codes), np.int32)
        self.row[self.codes] = np.arange(len(self.codes))
        self.values = np.zeros((len(self.codes) + 1, len(words)), np.float32)
        for n, (at, of) in enumerate(held):
            self.values[self.row[at], n] = of
        values, vectors = np.linalg.eigh((self.values.T @ self.values).astype(np.float64))
        good = values > 1e-4 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, u: Units) -> np.ndarray:
        """A row for each word: its kernel to every landmark."""
        total = np.zeros((len(u.symbols), self.values.shape[1]), np.float32)
        left, lengths = _left(u)
        for a, b in OFFSETS:
            row = self.row[_codes(u, a, b)]
            at = np.flatnonzero((left[: len(row)] > b) & (row < len(self.codes)))
            for lo in range(0, len(at), 1 << 12):
                part = at[lo : lo + (1 << 12)]
                total[part] += self.values[row[part]] * np.float32(DECAY ** (b - 1))
        return np.add.reduceat(total, u.starts, axis=0) / scale(lengths)[:, None]

    def features(self, u: Units) -> np.ndarray:
        return self.kernel(u) @ self.root.astype(np.float32)

    def table(self, weights: np.ndarray) -> np.ndarray:
        """One weight for each subsequence, of a machine with these weights on the features."""
        out = np.zeros(1 << 18, np.float32)
        out[self.codes] = self.values[:-1] @ (self.root @ weights).astype(np.float32)
        return out


@dataclass
class Model:
    """``table`` and ``bias`` decide on words; ``doc`` weighs a document's three measures and a constant."""

    table: np.ndarray
    bias: float
    doc: np.ndarray


def measures(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row: its highest word decision, its second highest (each within -1.5 to 1.5) and the log of 1 + its words over 0."""
    n = np.diff(rows)
    out = np.full((len(n), 3), -1.5)
    out[:, 2] = 0
    for r in np.flatnonzero(n).tolist():
        d = words[rows[r] : rows[r + 1]]
        top = np.partition(d, -2)[-2:] if len(d) > 1 else np.array([-1.5, d[0]])
        out[r] = max(-1.5, min(1.5, top[1])), max(-1.5, min(1.5, top[0])), np.log1p((d > 0).sum())
    return out


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    done = []
    for chunk in chunks(texts):
        u = units(chunk)
        m = measures(decisions(u, model.table) + model.bias, u.rows)
        done.append(1 / (1 + np.exp(-np.clip(m @ model.doc[:3] + model.doc[3], -30, 30))))
    return np.concatenate(done) if done else np.zeros(0)


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray | None = None, steps: int = 8) -> np.ndarray:
    """Squared-hinge linear machine on ``rows`` of x with a bias in the last, constant feature, by Newton's method."""
    w = np.zeros(x.shape[1]) if w is None else w
    for _ in range(steps):
        g, h = w.copy(), np.eye(len(w))
        for lo in range(0, len(rows), 4096):
            part = x[rows[lo : lo + 4096]].astype(np.float64)
            margin = 1 - y[lo : lo + 4096] * (part @ w)
            on = margin > 0
            part, weight = part[on], c[lo : lo + 4096][on]
            g -= 2 * part.T @ (weight * y[lo : lo + 4096][on] * margin[on])
            h += 2 * (part * weight[:, None]).T @ part
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-3 * np.abs(w).max():
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _words_machine(parts: list[Units], labels: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """The table and bias that decide on words."""
    symbols, held, texts, base = np.concatenate([p.symbols for p in parts]), [], 0, 0
    for p in parts:  # each word once in a document, before the parts' words meet
        n = np.diff(p.rows)
        ends = np.append(p.starts[1:], len(p.symbols))[: len(p.starts)]
        known, first, kind = np.unique(HASHES.words(p.symbols, p.starts, ends), return_index=True, return_inverse=True)
        pairs = np.unique(np.repeat(np.arange(len(n)), n) << 32 | kind)
        own = first[pairs & 0xFFFFFFFF]
        held.append((((pairs >> 32) + texts).astype(np.int32), known[pairs & 0xFFFFFFFF], (p.starts[own] + base).astype(np.int32), (ends - p.starts)[own].astype(np.int32)))
        texts, base = texts + len(n), base + len(p.symbols)
    doc, key, at, length = map(np.concatenate, zip(*held, strict=True))
    del held
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    toxic = labels[doc] > 0
    n1, n0 = (np.bincount(kind[t], minlength=len(first)).astype(float) for t in (toxic, ~toxic))
    d1, d0 = labels.sum(), (1 - labels).sum()
    p = (n1 + n0) / (d1 + d0)
    z = (n1 / d1 - n0 / d0) / np.sqrt(p * (1 - p) * (1 / d1 + 1 / d0) + 1e-12)

    at, length = at[first].astype(np.int64), length[first].astype(np.int64)
    del key

    def some_words(which: np.ndarray) -> Units:
        n = length[which]
        to = np.cumsum(n) - n
        return Units(symbols[np.repeat(at[which] - to, n) + np.arange(n.sum())], to, np.array([0, len(which)]))

    rng = np.random.Generator(np.random.PCG64(seed))
    ranked = np.argsort(-z, kind="stable")
    ranked = ranked[length[ranked] >= 3]
    top = LANDMARKS * 3 // 4
    chosen = np.concatenate([ranked[:top], rng.permutation(ranked[top:])[: LANDMARKS - top]])
    marks = Landmarks([symbols[at[k] : at[k] + length[k]] for k in chosen.tolist()])

    place, known = np.full(len(first), -1), np.zeros((0, marks.root.shape[1] + 1), np.float32)

    def learn(which: np.ndarray) -> np.ndarray:
        """Rows of ``known`` with the features of words; new ones are added in place, since a second copy is what takes most memory."""
        new = which[place[which] < 0]
        have = len(known)
        place[new] = have + np.arange(len(new))
        known.resize((have + len(new), known.shape[1]), refcheck=False)
        for k in range(0, len(new), 2048):
            some = new[k : k + 2048]
            known[have + k : have + k + len(some), :-1] = marks.features(some_words(some))
        known[have:, -1] = 1
        return place[which]

    clean, everything = np.flatnonzero(n0), np.arange(len(first))
    some = rng.permutation(clean)[:TRAIN_WORDS]
    decision, w = z, None
    for _ in range(ROUNDS):
        order = np.lexsort((-decision[kind[toxic]], doc[toxic]))
        d, k = doc[toxic][order], kind[toxic][order]
        pos = np.bincount(k[np.arange(len(d)) - np.searchsorted(d, d) < PER_DOC], minlength=len(first)).astype(float)
        hard = clean[np.argsort(-decision[clean], kind="stable")[: TRAIN_WORDS // 2]]
        rest = np.setdiff1d(some, hard)
        neg = np.concatenate([hard, rest])
        scale_up = max(n0.sum() - n0[hard].sum(), 0) / max(n0[rest].sum(), 1)
        use = np.flatnonzero(pos)
        y = np.concatenate([np.ones(len(use)), -np.ones(len(neg))])
        c = np.concatenate([pos[use], n0[hard] + 1, (n0[rest] + 1) * scale_up]) * COST
        rows = learn(np.concatenate([use, neg]))
        w = _svm(known, rows, y, c, w)
        table = marks.table(w[:-1])
        decision = np.concatenate([decisions(some_words(everything[k : k + (1 << 14)]), table) for k in range(0, len(everything), 1 << 14)]) + w[-1]
    return table, float(w[-1])


def fit(texts: list[str] | pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Train on documents.  With fewer than four of a class every text gets the share of toxic ones, 0.01 without labels.

    The document weights are fitted on decisions by a machine that was trained on the other half of the documents.
    """
    labels, texts = np.asarray(labels, np.float64), pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    share = (labels.sum() + 0.01) / (len(labels) + 1)
    if min(labels.sum(), (1 - labels).sum()) < 4:
        return Model(np.zeros(1 << 18, np.float32), -1.0, np.array([0, 0, 0, np.log(share / (1 - share))]))
    half = np.empty(len(labels), bool)
    for c in (0, 1):
        half[labels == c] = np.arange((labels == c).sum()) % 2 == 0

    def parts(which: np.ndarray) -> list[Units]:
        own = np.flatnonzero(which)
        return [units(c) for lo in range(0, len(own), PART) for c in chunks(texts.take(pa.array(own[lo : lo + PART])))]

    m, y = [], []
    for own in (half, ~half):
        table, bias = _words_machine(parts(own), labels[own], seed)
        m += [measures(decisions(p, table) + bias, p.rows) for p in parts(~own)]
        y.append(labels[~own])
    m = np.concatenate(m)
    table, bias = _words_machine(parts(half | ~half), labels, seed)
    return Model(table, bias, _logistic(np.column_stack([m, np.ones(len(m))]), np.concatenate(y)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of up to TRAIN_TOXIC and TRAIN_CLEAN documents with up to TRAIN_CHARS characters, chosen by a hash of the id.

    A document with several labels counts as toxic if one says so; null ids and labels are left out.
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    learnt = told.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    ids = _some(learnt, 2)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= TRAIN_CHARS)
    found = texts.join(F.broadcast(ids), "id")  # at most twice TRAIN_TOXIC and TRAIN_CLEAN ids
    return _some(found.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), 1)


def _some(rows: DataFrame, times: int) -> DataFrame:
    """Of either class as many rows as are fitted on, or ``times`` as many, in the order of a hash of the id."""

    def of(toxic: bool, most: int) -> DataFrame:
        return rows.where(F.col("toxic") == F.lit(toxic)).orderBy(F.xxhash64("id"), "id").limit(times * most)

    return of(True, TRAIN_TOXIC).unionByName(of(False, TRAIN_CLEAN))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled documents whose crc32 of the id modulo 5 is not 0."""
    rows = training_rows(docs, labels, id_col, text_col).select(F.col("text"), F.col("toxic").cast("int").alias("toxic")).toArrow()
    rows = rows.sort_by([("text", "ascending"), ("toxic", "ascending")])
    model = fit(rows["text"].cast(pa.large_string()).combine_chunks(), rows["toxic"].to_numpy().astype(np.float64))
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: row (a struct of the columns ``carry``) and score, from 0 to 1, of its whole text.

    Null and empty texts get the score of a text without words.  Carried columns are in a struct of their own, so no name clashes.
    """
    rows, names, text_at = carried(docs, carry, text_col)
    table, bias, doc = model.table, model.bias, model.doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(table, bias, doc)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(scores(own, b.column(text_at)))], names=[*names, "score"])

    out = rows.mapInArrow(frugal(run), T.StructType([*list(rows.schema)[: len(names)], T.StructField("score", T.DoubleType())]))
    return out.select(row_of(carry, names), "score")
