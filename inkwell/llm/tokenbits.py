"""Token ids in binary files: canonical, length-limited Huffman codes from global counts, in blocks that decode on their own.

A file holds whole documents.  Its ids, end to end, are cut into blocks of BLOCK ids.  A block begins at a multiple of eight bytes
and has the bit offset of every LANE-th id, so that all its lanes, and those of other blocks, are decoded side by side by table
look-up.  Layout, all numbers little-endian:

    header      magic, 8 bytes; number of documents, of ids, of blocks, and the header's own length, 8 bytes each
                then, compressed: known (1 byte) and id (8 bytes) of each document, its number of ids (8), the byte offset of each block (8)
    blocks      for each: the bit offset (4 bytes) of every LANE-th id within the codes; the codes, highest bit first, 32 zero bits or more at the end

Codes are fixed by the length of each id's code, which stands in one file ``code`` beside the others.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Workspace, once_per_worker
from .wordscan import Hasher, chunks

MAGIC = b"INKBITS1"
LONGEST = 18
"""Bits of a code at most, unless the ids are too many for it."""
LANE, BLOCK = 256, 1 << 16
GROUP = 32
"""Blocks that are encoded or decoded at a time."""
CHUNK_BYTES = 2 << 20
MEMO = 1_000_000
"""Words that a task remembers at most before it starts afresh."""
HASHES = Hasher(0xB17)
END = 1


# --- codes ------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The length of each id's code, 0 for ids that don't occur: the shortest total with no code over ``longest`` bits (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    longest = max(longest, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    single, merged = [], weights
    for k in range(longest):
        if k:
            pairs = merged[: len(merged) // 2 * 2]
            merged = np.concatenate((weights, pairs[0::2] + pairs[1::2]))
        at = np.argsort(merged, kind="stable")
        merged = merged[at]
        single.append(at < n)
    lengths, need = np.zeros(n, np.uint8), 2 * n - 2
    for is_single in reversed(single):
        taken = int(is_single[:need].sum())
        lengths[:taken] += 1
        need = 2 * (need - taken)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: shorter ones first, ids in order among equal lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.longest = max(1, int(self.lengths.max(initial=0)))
        self.order = np.argsort(np.where(self.lengths > 0, self.lengths, 99), kind="stable")[: int((self.lengths > 0).sum())]
        spans = np.uint64(1) << (self.longest - self.lengths[self.order]).astype(np.uint64)
        first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spans)[:-1])) if len(spans) else np.zeros(0, np.uint64)
        self.codes = np.zeros(len(lengths), np.uint64)  # at the top of ``longest`` bits
        self.codes[self.order] = first
        self.spans = spans
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next ``longest`` bits: the id, and the length of its code."""
        if self._table is None:
            ids, lengths = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.uint8)
            n = int(self.spans.sum())
            ids[:n] = np.repeat(self.order, self.spans.astype(np.int64))
            lengths[:n] = np.repeat(self.lengths[self.order], self.spans.astype(np.int64))
            self._table = ids, lengths
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of at most a block of ids as bytes, and the bit offset of every LANE-th id."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        starts = ends - n
        words = np.zeros((int(ends[-1]) + 95) // 64 + 1 if len(ids) else 1, np.uint64)
        if len(ids):
            at, room = starts >> 6, 64 - (starts & 63)
            left = self.codes[ids] << np.uint64(64 - self.longest)  # at the top of 64 bits
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] = np.bitwise_or.reduceat(left >> (64 - room).astype(np.uint64), first)
            over = np.flatnonzero(n > room)
            words[at[over] + 1] |= left[over] << room[over].astype(np.uint64)
        return words.astype(">u8").view(np.uint8), starts[::LANE].astype(np.uint32)

    def decode(self, data: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of lanes that begin at ``bits`` of ``data``, whose last 8 bytes belong to no code, and have ``n`` ids each."""
        ids, lengths = self.table()
        out = np.zeros((len(bits), LANE), np.uint32)
        words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        at, lanes, last = bits.astype(np.int64), np.arange(len(bits)), len(words) - 1
        shift = np.uint64(64 - self.longest)
        short = set(n.tolist())
        for k in range(int(n.max(initial=0))):
            if k in short:
                lanes = np.flatnonzero(n > k)
            here = at[lanes]
            word = words[np.minimum(here >> 3, last)].astype(np.uint64) << (here & 7).astype(np.uint64)
            key = word >> shift
            out[lanes, k] = ids[key]
            at[lanes] = here + lengths[key]
        return out[np.arange(LANE) < n[:, None]]


# --- files ------------------------------------------------------------------------------------------------------------


def write_file(out: BinaryIO, code: Code, keys: list[int | None], ids: list[np.ndarray]) -> tuple[int, int]:
    """Write documents, by key and ids, as one file; gives the number of ids and of bytes."""
    sizes = np.array([len(x) for x in ids], np.int64)
    total = int(sizes.sum())
    blocks, offset, offsets = [], 0, []
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    for lo in range(0, total, BLOCK):
        codes, lanes = code.encode(flat[lo : lo + BLOCK])
        pad = np.zeros(-(4 * len(lanes)) % 8, np.uint8)
        block = np.concatenate((lanes.view(np.uint8), pad, codes))
        offsets.append(offset)
        offset += len(block)
        blocks.append(block.tobytes())
    known = np.array([k is not None for k in keys], np.uint8)
    table = known.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + sizes.astype("<i8").tobytes() + np.array([*offsets, offset], "<i8").tobytes()
    packed = zlib.compress(table, 1)
    packed += bytes(-len(packed) % 8)
    head = MAGIC + np.array([len(keys), total, len(blocks), 40 + len(packed)], "<i8").tobytes() + packed
    out.write(head)
    for block in blocks:
        out.write(block)
    return total, len(head) + offset


class TokenFile:
    """An open file: ``keys`` and ``sizes`` of its documents, and ids by block."""

    def __init__(self, source: BinaryIO, code: Code):
        self.source, self.code = source, code
        head = source.read(40)
        if head[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        docs, self.n_ids, self.n_blocks, self.base = (int(x) for x in np.frombuffer(head[8:], "<i8"))
        table = zlib.decompressobj().decompress(source.read(self.base - 40))
        known = np.frombuffer(table, np.uint8, docs)
        ids, self.sizes = np.frombuffer(table, "<i8", docs, docs), np.frombuffer(table, "<i8", docs, 9 * docs)
        self.keys = [int(k) if has else None for k, has in zip(ids, known, strict=True)]
        self.offsets = np.frombuffer(table, "<i8", self.n_blocks + 1, 17 * docs)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks [first, last), whatever came before them."""
        self.source.seek(self.base + int(self.offsets[first]))
        data = np.frombuffer(self.source.read(int(self.offsets[last] - self.offsets[first])), np.uint8)
        bits, sizes = [], []
        for k in range(first, last):
            n = min(BLOCK, self.n_ids - k * BLOCK)
            lanes, at = -(-n // LANE), int(self.offsets[k] - self.offsets[first])
            codes = at + 4 * lanes + -(4 * lanes) % 8
            bits.append(np.frombuffer(data, "<u4", lanes, at).astype(np.int64) + 8 * codes)
            sizes.append(np.minimum(LANE, n - LANE * np.arange(lanes)))
        return self.code.decode(data, np.concatenate(bits), np.concatenate(sizes)) if bits else np.zeros(0, np.uint32)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file; only their blocks are read."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]

    def __iter__(self) -> Iterator[np.ndarray]:
        """All ids in order, some blocks at a time."""
        for k in range(0, self.n_blocks, GROUP):
            yield self.blocks(k, min(k + GROUP, self.n_blocks))


# --- encoding ---------------------------------------------------------------------------------------------------------


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never cross white space, remembering the ids of words.

    A text is cut at ASCII white space, and between an ASCII letter and ASCII punctuation or a digit unless that is an apostrophe or in a
    special token; no piece crosses such a cut.  Words of ASCII letters are lower-cased first, as the tokenizer does.  Words are told apart by a
    64-bit hash.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        self.tokenizer = Tokenizer.from_str(model)
        spec = json.loads(model)
        self.ends = np.zeros(max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1, bool)
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends[[k for t, k in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        glued = {"'", *(c for t in spec["added_tokens"] for c in t["content"] if not c.isalnum())}
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = True
        self.letter = letters
        self.space = np.isin(np.arange(256), [32, *range(9, 14)])
        self.other = (np.arange(256) < 128) & ~letters & ~self.space & ~np.isin(np.arange(256), [ord(c) for c in glued if ord(c) < 128])
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.clear()

    def clear(self) -> None:
        self.known, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _new(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words: those of letters only are encoded as one text and told apart by the pieces that end words."""
        texts = [w.decode() for w in words]
        out: list[list[int] | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        for lo in range(0, len(plain), 2048):
            part = plain[lo : lo + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in part)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):  # else some letter became several words, and each is encoded alone
                for k, x in zip(part, np.split(ids, cuts[:-1]), strict=True):
                    out[k] = x.tolist()
        rest = [k for k, x in enumerate(out) if x is None]
        for lo in range(0, len(rest), 2048):
            part = rest[lo : lo + 2048]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> None:
        got = self._new([bytes(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, np.fromiter((k for x in got for k in x), np.uint32, int(size.sum()))))
        known, start, sizes = (np.concatenate(x) for x in ((self.known, hashes), (self.start, at), (self.size, size)))
        order = np.argsort(known, kind="stable")
        self.known, self.start, self.size = known[order], start[order], sizes[order]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk of texts: their ids end to end, and where each text's begin."""
        for chunk in chunks(texts, CHUNK_BYTES):
            data = chunk.data
            if not len(data):
                yield np.zeros(0, np.uint32), np.zeros(len(chunk.offsets), np.int64)
                continue
            letter, other, space = self.letter[data], self.other[data], self.space[data]
            new = ~space
            new[1:] &= space[:-1] | (letter[1:] & other[:-1]) | (other[1:] & letter[:-1])
            cuts = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
            new[cuts] = ~space[cuts]
            starts = np.flatnonzero(new)
            gap = space.copy()
            gap[starts] = True
            gap[cuts] = True
            stops = np.flatnonzero(gap)
            ends = np.append(stops, len(data))[np.searchsorted(stops, starts, side="right")]
            if not len(starts):
                yield np.zeros(0, np.uint32), np.zeros(len(chunk.offsets), np.int64)
                continue
            upto = np.concatenate(([0], np.cumsum(letter)))
            plain = (upto[ends] - upto[starts]) == ends - starts
            low = data.copy()
            big = np.flatnonzero((data >= 65) & (data <= 90))
            word = np.searchsorted(starts, big, side="right") - 1
            low[big[plain[word]]] += 32
            hashes, first, kind = np.unique(HASHES.words(low, starts, ends), return_index=True, return_inverse=True)
            if len(self.known) > MEMO:
                self.clear()
            at = np.searchsorted(self.known, hashes)
            have = np.zeros(len(hashes), bool)
            inside = at < len(self.known)
            have[inside] = self.known[at[inside]] == hashes[inside]
            if not have.all():
                missing = first[~have]
                self._learn(hashes[~have], memoryview(low), starts[missing], ends[missing])
                at = np.searchsorted(self.known, hashes)
            n = self.size[at][kind]
            to = np.concatenate(([0], np.cumsum(n)))
            ids = self.flat[np.repeat(self.start[at][kind] - to[:-1], n) + np.arange(to[-1])]
            yield ids, to[np.searchsorted(starts, chunk.offsets)]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id, n, ids) of each document: the number of its ids, and the ids as little-endian numbers, ``end`` last; null texts are empty.

    ``model`` is the path of a tokenizer's JSON file.  Only tokenizers with word ends, lower case and white space between words are supported.
    """
    with open(model, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    if not spec["model"].get("end_of_word_suffix") or kinds != ["NFC", "Replace", "Lowercase"] or any(t["content"].isalpha() or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{model}: this kind of tokenizer is not supported")
    width = width_of(model)
    kind = f"<u{width}"
    key = ("words", hashlib.sha256(text.encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(key, lambda: WordEncoder(text))
        for b in batches:
            done = 0
            for ids, at in encoder.encode(b.column(1)):
                n = len(at) - 1
                flat = np.insert(ids, at[1:], end).astype(kind).tobytes()
                bounds = (at + np.arange(n + 1)) * width
                values = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, n), pa.array(np.diff(at) + 1), values], names=["id", "n", "ids"])
                done += n

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, ids binary")


def width_of(model: str) -> int:
    """Bytes of an id in ``encoded``."""
    with open(model, encoding="utf-8") as f:
        spec = json.load(f)
    return 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else 4


# --- Spark ------------------------------------------------------------------------------------------------------------


def counts_of(table: DataFrame, width: int) -> np.ndarray:
    """How often each id comes in a table ``encoded``: summed in each task, then over all.  As many rows as the vocabulary has ids are collected."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    rows = table.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows.token.max()) + 1 if len(rows) else 1, np.int64)
    out[rows.token.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def save_code(folder: str, lengths: np.ndarray) -> None:
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/code") as f:
        f.write(zlib.compress(lengths.astype(np.uint8).tobytes()))


def load_code(folder: str) -> Code:
    """The code of the files in a folder, read once in a worker."""

    def build() -> Code:
        fs, path = _open(folder)
        with fs.open_input_file(f"{path}/code") as f:
            return Code(np.frombuffer(zlib.decompress(f.read()), np.uint8))

    return once_per_worker(("code", folder), build)


FILE_IDS = 1 << 22
"""Ids of a file, about: a task begins another one then."""


def write_files(table: DataFrame, folder: str, width: int) -> DataFrame:
    """Write a table ``encoded``, in ascending order of its ids, into files of ``folder`` (a URI that executors share), whose code is there.

    Gives a row (part, turn, file, n_docs, n_ids, n_bytes) for each file; part and turn order them.  Null ids come first; documents of one id come
    in the order of their numbers of ids and a hash of these.  Evaluate it once and keep the result: another evaluation writes other files.
    """
    kind = f"<u{width}"
    order = ["id", "n", "hash", "row"]  # rows alike but for the last are the same, and many of them can be parted
    rows = table.withColumns({"hash": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = load_code(folder)
        fs, path = _open(folder)
        keys, ids, held, turn, part = [], [], 0, 0, None

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.bits"  # a new name for each attempt: one that fails leaves no trace in the manifest
            with fs.open_output_stream(f"{path}/{name}") as out:
                n_ids, n_bytes = write_file(out, code, keys, ids)
            made = {"part": part, "turn": turn, "file": name, "n_docs": len(keys), "n_ids": n_ids, "n_bytes": n_bytes}
            return pa.RecordBatch.from_pylist([made], schema=pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in made]))

        for b in batches:
            for p, key, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = p
                keys.append(key)
                ids.append(np.frombuffer(raw, kind).astype(np.uint32))
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield flush()
                    keys, ids, held, turn = [], [], 0, turn + 1
        if keys:
            yield flush()

    return rows.mapInArrow(run, "part bigint, turn bigint, file string, n_docs bigint, n_ids bigint, n_bytes bigint")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files of ``manifest`` back: one row (id, start, n_tokens, ids) for each document.

    ``start`` is the number of ids in all documents before it, ``ids`` are 32-bit little-endian numbers.  A file is decoded some blocks at a time.
    """
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part", "turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("start", before).select("file", "start")  # a row for each file
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def documents(file: TokenFile, start: int) -> Iterator[pa.RecordBatch]:
        done, pieces = 0, []
        ends = np.cumsum(file.sizes)
        for ids in file if file.n_ids else [np.zeros(0, np.uint32)]:
            pieces.append(ids)
            at = int(ends[done - 1]) if done else 0
            last = int(np.searchsorted(ends, at + sum(map(len, pieces)), side="right"))
            if last == done:
                continue
            flat = np.concatenate(pieces)
            cuts = np.concatenate(([at], ends[done:last])) - at
            values = pa.Array.from_buffers(pa.large_binary(), last - done, [None, pa.py_buffer((4 * cuts).astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.keys[done:last], pa.int64()), pa.array(start + at + cuts[:-1]), pa.array(np.diff(cuts)), values.cast(pa.binary())], names=["id", "start", "n_tokens", "ids"]
            )
            pieces, done = [flat[cuts[-1] :]], last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = load_code(folder)
        fs, path = _open(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as source:
                    yield from documents(TokenFile(source, code), start)

    return files.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary")


def write_and_read(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """One row (id, start, n_tokens, ids) for each row of ``docs``, read back from files of coded ids in ascending order of the documents' ids.

    Each document ends with ``end``.  Null and empty texts have that id alone.  Null ids come first, as if smallest; repeated ids are documents like any
    other, the ones with fewer tokens first.  No other column is read.  An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "token-bits")
    table, folder, width = work.keep(encoded(docs, model, id_col, text_col, end), "ids"), f"{work.path}/files", width_of(model)
    save_code(folder, code_lengths(counts_of(table, width)))
    manifest = work.keep(write_files(table, folder, width), "manifest")
    return read_files(manifest, folder)
