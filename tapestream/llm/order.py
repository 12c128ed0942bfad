"""Training-order materialisation.

Documents are put in an order that only their ids and texts decide. Their token ids form one stream per
range of that order, which is cut into sequences of equal length. A keyed Feistel network over the
sequence numbers, walked on until it lands among them, gives every sequence its slot: a permutation that
any task computes by itself. Slots are dealt to tasks by range; each task writes the shards of its range,
files of fixed-size records that are read from any slot on.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import dropped, folder, shuffle_files_freed, written
from .text import as_bytes, mixed, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary cuts texts before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
LENGTH = 1024
#: Sequences of one shard: 4096 records of 2 KiB.
SHARD_ROWS = 4096
KEY = 20240229
#: Documents of one range of the order, unless that makes more ranges than MOST_PARTS; the same bound holds for tasks that write shards.
RANGE_DOCS, MOST_PARTS = 8192, 20_000
#: Shards are written in so many waves, so that only the shuffle files of one wave's slots are on disk at a time.
WAVES = 2


class Tokenizer:
    """Ids of texts, each text ended by END_OF_TEXT."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = np.array([END_OF_TEXT], "<u2")

    def of(self, texts: list[bytes | None]) -> np.ndarray:
        """The stream of several texts, as 16-bit numbers."""
        encode, out = self.encoding.encode_to_numpy, []
        for text in texts:
            out += [encode((text or b"").decode("utf-8", "replace"), disallowed_special=()), self.end]
        return np.concatenate(out).astype("<u2")


def feistel(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = 4) -> np.ndarray:
    """Slots of sequence numbers below ``n``: a permutation of 0 .. n-1 that the key decides.

    The network permutes the smallest range of 4**b numbers that holds ``n``; a number that leaves
    0 .. n-1 is sent through again (cycle walking), under four times on average.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]
    values = numbers.astype(np.uint64)
    out = np.zeros(len(values), np.uint64)
    open_ = np.arange(len(values))
    while len(open_):
        left, right = values >> np.uint64(half), values & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        values = (left << np.uint64(half)) | right
        done = values < n
        out[open_[done]] = values[done]
        open_, values = open_[~done], values[~done]
    return out.astype(np.int64)


def in_ranges(documents: DataFrame) -> DataFrame:
    """part and text, dealt by ranges of a hash of id and text and sorted by it within each range."""
    parts = min(MOST_PARTS, max(1, -(-documents.count() // RANGE_DOCS)))
    doc_id = F.col("doc_id").cast("string")
    keyed = documents.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col("text").cast("string")).alias("h"), as_bytes("text"))
    part = F.shiftright((F.shiftright("h", 32) + 2**31) * parts, 32).cast("int")
    return keyed.withColumn("part", part).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h", "doc_id").select("part", "text")


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: bytes, length: int) -> Iterator[pa.RecordBatch]:
    """Sequences of each part's stream; the last one of a part is filled up with END_OF_TEXT."""
    tokenizer = Tokenizer(vocabulary)
    part, k, left = None, 0, np.zeros(0, "<u2")

    def rows(stream: np.ndarray) -> pa.RecordBatch:
        n = -(-len(stream) // length)
        sizes = np.minimum(length, len(stream) - length * np.arange(n)).astype(np.int32)
        filled = np.full(n * length, END_OF_TEXT, "<u2")
        filled[: len(stream)] = stream
        records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), n, [None, pa.py_buffer(filled)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(k + np.arange(n)), pa.array(sizes), records], ["part", "k", "n_tokens", "record"])

    for batch in slices(batches):
        parts = np.array(batch.column("part").to_pylist())
        bounds = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        texts = batch.column("text").to_pylist()
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if parts[start] != part:
                if len(left):
                    yield rows(left)
                part, k, left = int(parts[start]), 0, left[:0]
            stream = np.concatenate([left, tokenizer.of(texts[start:end])])
            whole = len(stream) // length
            if whole:
                yield rows(stream[: whole * length])
            k, left = k + whole, stream[whole * length :]
    if len(left):
        yield rows(left)


def sequences(documents: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """The written sequences: part, k (number within the part), n_tokens and record (``length`` ids of 2 bytes).

    The table fixes them: whatever reads it again after a failure gets the same. The vocabulary's
    bytes are sent to the tasks; their size is fixed.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    found = in_ranges(documents).mapInArrow(lambda b: _cut(b, shared.value, length), "part int, k long, n_tokens int, record binary")
    with shuffle_files_freed(spark):
        return written(found, "sequences", compression="zstd")


def slotted(cut: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """Adds seq and slot to written sequences, and tells how many there are. One count per part reaches the driver."""
    base, n = {}, 0
    for row in cut.groupBy("part").count().orderBy("part").collect():
        base[row["part"]] = n
        n += row["count"]

    @F.pandas_udf("long")
    def number(part: pd.Series, k: pd.Series) -> pd.Series:
        return part.map(base) + k

    @F.pandas_udf("long")
    def slot(seq: pd.Series) -> pd.Series:
        return pd.Series(feistel(seq.to_numpy(), n, key))

    return cut.withColumn("seq", number("part", "k")).withColumn("slot", slot("seq")), n


def shard_of(slot: Column, shard_rows: int = SHARD_ROWS) -> Column:
    return F.floor(slot / shard_rows).cast("long")


MANIFEST = "slot long, shard long, byte_offset long, seq long, n_tokens int, record_sha256 string, shard_sha256 string, path string"


def _write(batches: Iterator[pa.RecordBatch], uri: str, length: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Writes the shards of records that arrive by slot; each file appears whole or not at all, and a repeated task writes the same bytes."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    shard, file, held, whole = None, None, [], hashlib.sha256()

    def closed() -> pa.RecordBatch:
        path = f"{place}/shard-{shard:09d}.bin"
        file.close()
        store.move(attempt, path)
        slot, seq, n_tokens, digest = zip(*held, strict=True)
        same = len(held)
        columns = [pa.array(slot), pa.array([shard] * same), pa.array([(s - shard * shard_rows) * 2 * length for s in slot]), pa.array(seq), pa.array(n_tokens, pa.int32()), pa.array(digest), pa.array([whole.hexdigest()] * same), pa.array([path] * same)]
        return pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "seq", "n_tokens", "record_sha256", "shard_sha256", "path"])

    for batch in batches:
        for slot, seq, n_tokens, record in zip(*(batch.column(k).to_pylist() for k in ("slot", "seq", "n_tokens", "record")), strict=True):
            if slot // shard_rows != shard:
                if file is not None:
                    yield closed()
                store.create_dir(place, recursive=True)
                attempt = f"{place}/.attempt-{uuid.uuid4().hex}"
                shard, file, held, whole = slot // shard_rows, store.open_output_stream(attempt), [], hashlib.sha256()
            file.write(record)
            whole.update(record)
            held.append((slot, seq, n_tokens, hashlib.sha256(record).hexdigest()))
    if file is not None:
        yield closed()


def training_order(documents: DataFrame, uri: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, vocabulary: str = VOCABULARY, waves: int = WAVES) -> DataFrame:
    """Writes ``documents`` in training order as shards below ``uri`` (any store that pyarrow opens; else the shared folder).

    Returns the manifest, one row per record: slot, shard, byte_offset within the shard, seq (number
    before the permutation), n_tokens, the digests of the record and of its shard, and the shard's path. The
    manifest is written last, so it names whole shards only.

    The same rows give the same shards, however the table is dealt to files and tasks. A null or empty
    text is one END_OF_TEXT. A row without an id is placed by its text. Rows that repeat an id and its
    text are all taken; being equal, their order doesn't matter, but they fall into one range. Other
    columns are ignored. An empty table gives an empty manifest and no shards.
    """
    target = uri or f"{folder(documents.sparkSession)}/shards-{uuid.uuid4().hex}"
    if target.startswith("file:"):
        target = "/" + target.removeprefix("file:").lstrip("/")
    cut = sequences(documents, length, vocabulary)
    placed, n = slotted(cut, key)
    shards = max(1, -(-n // shard_rows))
    manifests = []
    for first in range(0, shards, -(-shards // waves)):
        last = min(shards, first + -(-shards // waves))
        together = -(-(last - first) // MOST_PARTS)  # shards that one task writes
        parts = -(-(last - first) // together)
        dealt = placed.where(F.col("slot").between(first * shard_rows, last * shard_rows - 1)).select("slot", "seq", "n_tokens", "record")
        dealt = dealt.repartitionById(parts, F.floor((shard_of(F.col("slot"), shard_rows) - first) / together).cast("int")).sortWithinPartitions("slot")
        with shuffle_files_freed(documents.sparkSession):
            manifests.append(written(dealt.mapInArrow(lambda b: _write(b, target, length, shard_rows), MANIFEST), "manifest"))
    dropped(cut)
    return reduce(DataFrame.union, manifests)


def read_slots(path: str, first: int, count: int, length: int = LENGTH) -> np.ndarray:
    """Records ``first`` .. of one shard file: the stride is fixed, so a reader resumes by seeking."""
    with open(path, "rb") as file:
        file.seek(first * length * 2)
        return np.frombuffer(file.read(count * length * 2), "<u2").reshape(-1, length)


def op5_training_order(spark, sf_dir: str) -> DataFrame:
    return training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
