"""SentencePiece encoding and decoding with a Viterbi pass that shares common prefixes.

A text is cut into marked words (a word with the mark of the space before it) at places no piece crosses.  The distinct marked
words are sorted, which walks their trie depth first: each word keeps the forward states of the prefix it shares with the one
before it and computes only the rest.

For a unigram model a forward state is the best score of a prefix and its last piece.  For a merge (BPE) model scores only
order the merges and don't add up, so a state is the last piece of the prefix's encoding alone.  It is the one piece that
ends there and whose merge with the piece before it leaves both as they are; whatever follows doesn't change that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import carried, frugal, give_back, once_per_worker, row_of
from .wordscan import Hasher, chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
HASHES = Hasher(0x51ECE)
CHUNK_BYTES = 1 << 20
MEMO = 300_000
"""Words, and pairs of pieces, that a task remembers at most before it starts afresh."""


@dataclass
class Vocabulary:
    """Pieces with ids and scores; ``bytes_`` are the ids of the 256 byte pieces, ``raw`` what each id decodes to."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    raw: list[bytes]
    merges: bool
    longest: int


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver.  Only models with byte fallback and without a normaliser are supported."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, norm = model.trainer_spec, model.normalizer_spec
    if spec.model_type not in (1, 2) or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError(f"{path}: this kind of model is not supported")
    kinds = pb.ModelProto.SentencePiece
    ids, scores, bytes_, raw = {}, {}, [0] * 256, []
    for k, p in enumerate(model.pieces):
        if p.type == kinds.BYTE:
            bytes_[int(p.piece[1:-1], 16)] = k
            raw.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type == kinds.NORMAL:
            if MARK in p.piece.lstrip(MARK):
                raise ValueError(f"{path}: a piece crosses words")
            ids[p.piece], scores[p.piece] = k, p.score
            raw.append(p.piece.replace(MARK, " ").encode())
        else:
            raw.append(b"")
    return Vocabulary(ids, scores, bytes_, raw, spec.model_type == 2, max(map(len, ids)))


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Plain merging: join the neighbours whose union has the highest score, the leftmost if equal, until none is a piece."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            s = scores.get(parts[k] + parts[k + 1])
            if s is not None and (best is None or s > best):
                best, at = s, k
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes sorted marked words; remembers which pairs of pieces stand side by side."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.beside: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.least = min(vocabulary.scores.values(), default=0.0) - 10
        lengths: dict[str, set[int]] = {}
        for piece in vocabulary.ids:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], {1}).add(len(piece))
        self.lengths = {end: sorted(n, reverse=True) for end, n in lengths.items()}

    def _side_by_side(self, left: str, right: str) -> bool:
        if self.pairs >= MEMO:
            self.beside.clear()
            self.pairs = 0
        self.pairs += 1
        known = left + right not in self.v.scores or not left
        known = known and merge(left + right, self.v.scores) == ([left, right] if left else [right])
        self.beside.setdefault(left, {})[right] = known
        return known

    def _one(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece, or of the bytes of a character that is none."""
        k = self.v.ids.get(piece)
        return (k,) if k is not None else tuple(self.v.bytes_[x] for x in piece.encode())

    def words(self, sorted_words: Iterable[str]) -> Iterator[tuple[int, ...]]:
        """The ids of each word.  ``last`` and ``best`` are the forward states of the prefixes of the word before: the last piece, from which the
        pieces before it are found backwards, and the score."""
        merges, one, none = self.v.merges, [1], {}
        last, best = [""], [0.0]
        before = ""
        for word in sorted_words:
            if merges and word.startswith(MARK * 2):  # pieces of marks alone have equal scores: which merges first depends on place
                yield tuple(k for p in _merge_marks(word, self.v.scores) for k in self._one(p))
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            before = word
            for end in range(shared + 1, len(word) + 1):
                found = None
                for n in self.lengths.get(word[max(0, end - 2) : end], one):
                    if n > end:
                        continue
                    piece = word[end - n : end]
                    if n > 1 and piece not in self.v.ids:
                        continue
                    if merges:
                        left = last[end - n]
                        fits = self.beside.get(left, none).get(piece)
                        if fits or (fits is None and self._side_by_side(left, piece)):
                            found = piece, 0.0
                            break
                    else:
                        score = best[end - n] + self.v.scores.get(piece, self.least)
                        if found is None or score > found[1]:
                            found = piece, score
                last.append(found[0])
                best.append(found[1])
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            yield tuple(k for p in reversed(pieces) for k in self._one(p))


def _merge_marks(word: str, scores: dict[str, float]) -> list[str]:
    """A word after several marks, by plain merging; a long run of marks first loses the longest pieces of marks from the left, if
    that is what merging makes of such a run."""
    marks = len(word) - len(word.lstrip(MARK))
    longest = max((len(p) for p in scores if set(p) == {MARK}), default=1) if marks > 64 else 0
    head: list[str] = []
    if marks > 64 and merge(MARK * 4 * longest, scores) == [MARK * longest] * 4:
        head = [MARK * longest] * ((marks - 4 * longest) // longest)
    return head + merge(word[longest * len(head) :], scores)


def marked_words(data: np.ndarray, rows: np.ndarray, breaks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where marked words start and end in bytes whose rows start at ``rows``: at a row, at the first of some spaces, and around
    ``breaks``, line breaks and tabs if no piece joins them to others."""
    space, alone = data == 32, np.isin(data, np.frombuffer(breaks, np.uint8))
    new = space | alone
    new[1:] &= ~(space[1:] & space[:-1])
    new[1:] |= alone[:-1]
    cuts = rows[:-1][np.diff(rows) > 0]
    new[cuts] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(data))


class Codec:
    """Encodes and decodes columns of texts, remembering words between batches: ``keys`` are their 64-bit hashes in order, by which words are
    told apart, and ``flat`` has the ids of each from ``begin`` on, ``count`` of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.encoder = vocabulary, Encoder(vocabulary)
        self.breaks = bytes(x for x in b"\n\t" if not any(chr(x) in p for p in vocabulary.ids if len(p) > 1))
        self._forget()
        self.sizes = np.array([len(x) for x in vocabulary.raw], np.int64)
        self.bytes_ = np.frombuffer(b"".join(vocabulary.raw), np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def _forget(self) -> None:
        self.keys, self.begin, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, new: list[bytes]) -> None:
        """Remember words of these hashes, which are in order and not known yet."""
        marked = [x.decode().replace(" ", MARK) for x in new]
        texts = sorted(set(marked))
        got = dict(zip(texts, self.encoder.words(texts), strict=True))
        each = [got[x] for x in marked]
        count = np.fromiter(map(len, each), np.int32, len(each))
        flat = np.fromiter((k for x in each for k in x), np.int32, int(count.sum()))
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(count, dtype=np.int64) - count)
        self.keys, self.count, self.flat = np.insert(self.keys, at, keys), np.insert(self.count, at, count), np.concatenate([self.flat, flat])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each chunk of texts: ids, where each row's ids start, the rows' bytes with the mark put before, where each starts."""
        for chunk in chunks(texts, CHUNK_BYTES):
            size = np.diff(chunk.offsets)
            data = np.insert(chunk.data, chunk.offsets[:-1][size > 0], 32)
            rows = np.concatenate(([0], np.cumsum(size + (size > 0))))
            starts, ends = marked_words(data, rows, self.breaks)
            if not len(starts):
                yield np.zeros(0, np.int32), np.zeros(len(rows), np.int64), data, rows
                continue
            keys, first, kind = np.unique(HASHES.words(data, starts, ends), return_index=True, return_inverse=True)
            if len(self.keys) > MEMO:
                self._forget()
            at = np.searchsorted(self.keys, keys)
            met = at < len(self.keys)
            met[met] = self.keys[at[met]] == keys[met]
            new = np.flatnonzero(~met)
            if len(new):
                raw = data.tobytes()
                self._learn(keys[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)[kind]
            n = self.count[at]
            to = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
            ids = self.flat[np.repeat(self.begin[at] - to[:-1], n) + np.arange(to[-1])]
            yield ids, to[np.searchsorted(starts, rows)], data, rows

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids, each with the mark before it, and where each starts."""
        n = self.sizes[ids]
        to = np.concatenate(([0], np.cumsum(n)))
        return self.bytes_[np.repeat(self.at[ids] - to[:-1], n) + np.arange(to[-1])], to[rows]


def encode_documents(docs: DataFrame, carry: list[str], text_col: str = "text", model: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of the columns ``carry``), n_ids, ids (only if ``keep_ids``), ids_sha256 (of the
    ids as 32-bit little-endian numbers), decoded_sha256 (of the text decoded again) and round_trip: whether it equals the text.

    Ids are those that the sentencepiece library gives.  Null and empty texts have no ids and decode to an empty text.  A text that
    holds the mark character itself decodes to a space in its place, as in that library, so round_trip is false.  Repeated rows
    give repeated rows.  Carried columns are in a struct of their own, so no name clashes.
    """
    vocabulary = load(model)
    key = ("codec", hashlib.sha256(repr((vocabulary.ids, vocabulary.scores)).encode()).hexdigest())
    rows, names, text_at = carried(docs, carry, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once_per_worker(key, lambda: Codec(vocabulary))
        for b in batches:
            done = 0
            for ids, at, data, starts in codec.encode(b.column(text_at)):
                back, back_at = codec.decode(ids, at)
                n = len(at) - 1
                ids_sha, text_sha, same = [], [], []
                raw, out, source = ids.astype("<i4").tobytes(), back.tobytes(), data.tobytes()
                for i in range(n):
                    text = out[back_at[i] + 1 : back_at[i + 1]]
                    ids_sha.append(hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest())
                    text_sha.append(hashlib.sha256(text).hexdigest())
                    same.append(text == source[starts[i] + 1 : starts[i + 1]])
                made = [pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
                if keep_ids:
                    made.insert(1, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                kept = [c.slice(done, n) for c in b.columns[: len(names)]]
                done += n
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)
                del ids, at, data, starts, back, back_at, raw, out, source, made, kept
                give_back()

    made = [T.StructField("n_ids", T.LongType())]
    if keep_ids:
        made.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    made += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*list(rows.schema)[: len(names)], *made])
    out = rows.mapInArrow(frugal(run), schema)
    return out.select(row_of(carry, names), *(f.name for f in made))
