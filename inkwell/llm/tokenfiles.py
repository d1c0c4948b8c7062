"""Token counts of documents in flat token files, found by scanning for the end-of-document identifier.

A flat file is token ids of a fixed width, each document followed by the separator, and nothing else: no index, no lengths.
Blocks of the files are scanned on their own; a prefix scan over each file's blocks then tells how many documents ended before a
block and how many tokens of an open document reach into it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Workspace, once_per_worker

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: how the byte_bpe_50k vocabulary splits texts."""
SEPARATOR = 50256
WIDTH = 2
BLOCK_BYTES = 4 << 20


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write_tokens(folder: str, ranks: bytes):
    key = ("tokens", hashlib.sha256(ranks).hexdigest())

    def build() -> tiktoken.Encoding:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = once_per_worker(key, build)
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.tokens", 0, None  # a new name for each attempt: one that fails leaves no trace in the manifest
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                out = out or fs.open_output_stream(f"{path}/{name}")
                column = b.column(1)
                for lo in range(0, b.num_rows, 256):
                    texts = [t or "" for t in column.slice(lo, 256).to_pylist()]
                    out.write(b"".join(np.array([*ids, SEPARATOR], "<u2").tobytes() for ids in map(encoding.encode_ordinary, texts)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(np.arange(n, n + b.num_rows)), b.column(0)], names=["file", "ordinal", "id"])
                n += b.num_rows
        finally:
            if out is not None:
                out.close()

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Write the documents' tokens as one flat file for each task into ``folder`` (a URI that executors share).

    Gives rows (file, ordinal, id) that tell which document is which in a file.  Evaluate it once and keep the result: another
    evaluation writes other files.  Null texts are empty documents.
    """
    with open(ranks, "rb") as f:
        table = f.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_write_tokens(folder, table), f"file string, ordinal bigint, id {rows.schema['id'].dataType.simpleString()}")


def _plan_blocks(folder: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                n = -(-fs.get_file_info(f"{path}/{name}").size // block)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n))], names=["file", "block"])

    return run


def find_separators(data: bytes, separator: int = SEPARATOR, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The number of tokens before each separator of a block, back to the one before or the block's start, and of those after the last."""
    tokens = np.frombuffer(data, f"<u{width}")
    at = np.flatnonzero(tokens == separator)
    if not len(at):
        return at, len(tokens)
    return np.diff(at, prepend=-1) - 1, len(tokens) - 1 - int(at[-1])


def _scan_blocks(folder: str, block: int, separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for b in batches:
            for name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    lengths, tail = find_separators(f.read_at(min(block, f.size() - k * block), k * block), separator, width)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([tail], pa.int64())], names=["file", "block", "lengths", "tail"])

    return run


def count_tokens(files: DataFrame, folder: str, work: Workspace, block_bytes: int = BLOCK_BYTES, separator: int = SEPARATOR, width: int = WIDTH, step: str = "blocks") -> DataFrame:
    """Rows (file, ordinal, n_tokens), one for each document in the flat files named by the column ``file``.

    Tokens after a file's last separator are a last, unclosed document if there are any.  An empty file has no documents.
    ``block_bytes`` must be a multiple of ``width``.
    """
    blocks = files.select("file").distinct().mapInArrow(_plan_blocks(folder, block_bytes), "file string, block bigint")
    blocks = blocks.repartition("file", "block")
    scanned = work.keep(blocks.mapInArrow(_scan_blocks(folder, block_bytes, separator, width), "file string, block bigint, lengths array<bigint>, tail bigint"), step)

    in_file = W.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("n") > 0
    sums = scanned.select("file", "block", F.size("lengths").cast("long").alias("n"), "tail")
    sums = sums.select("file", "block", "n", "tail", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("tails"))
    open_ = F.col("tails") - F.coalesce(F.last(F.when(ends, F.col("tails")), ignorenulls=True).over(before), F.lit(0))
    sums = sums.withColumn("carry", open_).withColumn("last", F.lead("block").over(in_file).isNull())
    # by merge: the lengths grow with the corpus, even where Spark's estimate lets them be broadcast
    found = scanned.select("file", "block", "lengths").hint("merge").join(sums.select("file", "block", "base", "carry"), ["file", "block"])
    found = found.select("file", "base", "carry", F.posexplode("lengths").alias("k", "length"))
    closed = found.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    rest = F.col("tail") + F.when(ends, F.lit(0)).otherwise(F.col("carry"))
    unclosed = sums.where(F.col("last") & (rest > 0)).select("file", (F.col("base") + F.col("n")).alias("ordinal"), rest.alias("n_tokens"))
    return closed.unionByName(unclosed)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, waves: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, n_tokens) for each row of ``docs``, counted by writing flat token files and scanning them.

    Documents go in ``waves`` dealt by a hash of the id, whose files are removed once counted, so that token files of only a part of
    the corpus exist at a time.  Null and empty texts have no tokens; repeated rows and null ids are rows like any other; no
    other column is read; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "tokens")
    out = None
    for k in range(waves):
        part, folder = docs.where(F.pmod(F.xxhash64(id_col), F.lit(waves)) == k), f"{work.path}/files-{k}"
        names = work.keep(write_token_files(part, folder, id_col, text_col, ranks), f"names-{k}")
        counts = count_tokens(names, folder, work, block_bytes, step=f"blocks-{k}")
        # by merge: the names grow with the corpus, even where Spark's estimate lets them be broadcast
        counts = work.keep(names.hint("merge").join(counts, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "n_tokens"), f"counts-{k}")
        work.drop(f"files-{k}")
        out = counts if out is None else out.unionByName(counts)
    return out
