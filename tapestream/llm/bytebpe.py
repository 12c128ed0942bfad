"""Byte-level BPE encoding and decoding with padded matrices.

A pattern splits texts into pieces. The distinct pieces of a batch that a task hasn't met yet are dealt
to buckets by their number of bytes; a bucket is a matrix with a row of token ids per piece. In each round
every row merges its leftmost pair of least rank: ranks come from a hashed table of pairs, the columns
behind the merged pair close up, and rows without a pair that merges leave the matrix.

Pieces longer than the widest bucket are merged one by one, all the occurrences at once that merging
from the left would take one after the other (``merged_long``), so their work grows with their length
times the number of different merges, not with its square.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .text import as_bytes, slices

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that the rank file belongs to.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Greatest lengths in bytes of the buckets' pieces.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64)
#: Rows of one matrix, and pieces whose ids a task remembers; it forgets all beyond that, which changes no result.
ROWS, REMEMBERED = 50_000, 400_000
NEVER = np.int32(2**31 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """Token that a pair of tokens becomes, which is its rank too: an open-addressing table of numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64(2**bits - 1)
        self.keys, self.tokens = np.zeros(2**bits, np.uint64), np.full(2**bits, NEVER, np.int32)
        left, right = (np.fromiter((k[i] for k in pairs), np.int64, len(pairs)) for i in (0, 1))
        keys, tokens = self.keyed(left, right), np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self.slots(keys)
        while len(keys):  # those whose slot is taken go on to the next one
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.tokens[slots[placed]] = tokens[placed]
            keys, tokens, slots = keys[~placed], tokens[~placed], (slots[~placed] + np.uint64(1)) & self.mask

    @staticmethod
    def keyed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Never 0, which marks a free slot; ids of -1 (padding) are in no pair of the table."""
        return (left.astype(np.uint64) << np.uint64(32)) + (right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) + np.uint64(1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * SPREAD) >> self.shift

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NEVER where it doesn't merge."""
        keys = self.keyed(left.ravel(), right.ravel())
        found, slots, open_ = np.full(len(keys), NEVER, np.int32), self.slots(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slots]
            hit = there == keys
            found[open_[hit]] = self.tokens[slots[hit]]
            on = ~hit & (there != 0)
            open_, keys, slots = open_[on], keys[on], (slots[on] + np.uint64(1)) & self.mask
        return found.reshape(left.shape)


@lru_cache(maxsize=4)
def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Token bytes and their ids of a rank file, as plain objects (bounded by the vocabulary)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


@lru_cache(maxsize=4)
def newer(pattern: str = PATTERN) -> str:
    """Code points that the pattern's classes hold by this process's ``regex``, but not by the tokenizer library's own, older Unicode tables; mostly letters of the latest versions."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    at: set[int] = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        if name in pattern:
            single = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            at |= set(map(ord, regex.findall(name, every))) ^ set(map(ord, single.decode(single.encode_ordinary(every))))
    return "".join(map(chr, sorted(at)))


class Splitter:
    """Pieces of a text as the library splits it: ``regex`` with the newer code points taken out of the classes where a text has any."""

    def __init__(self, pattern: str, newer_: str):
        self.plain = regex.compile(pattern).findall
        self.newer = frozenset(newer_)
        listed = "".join(f"\\U{ord(c):08X}" for c in newer_)
        without = regex.sub(r"\\p\{[LN]\}|\\s", lambda m: f"[{m[0]}--[{listed}]]", pattern) if newer_ else pattern
        self.exact = regex.compile(f"(?V1){without}").findall

    def __call__(self, text: str) -> list[str]:
        known = text.isascii() or self.newer.isdisjoint(text)
        return self.plain(text) if known else self.exact(text)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, newer_: str):
        self.ranks = ranks
        self.split = Splitter(pattern, newer_)
        self.pairs = Pairs({(ranks[t[:i]], ranks[t[i:]]): rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks})
        self.longest = max(map(len, ranks), default=1)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("a byte-level vocabulary has a token for each byte")
        size = max(ranks.values()) + 1
        self.bytes_of, self.decimal = [b""] * size, [b"%d" % i for i in range(size)]
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.lengths[rank] = len(token)
        self.known: dict[str, bytes] = {}

    def merged(self, rows: list[bytes]) -> list[bytes]:
        """Ids (little-endian int32) of pieces of one bucket."""
        out: list[bytes] = [b""] * len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(lengths.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        at = np.arange(len(rows))
        while len(at):
            n = np.arange(len(at))
            if ids.shape[1] > 1:
                least = ranks.argmin(axis=1)  # the leftmost of equal ranks
                best = ranks[n, least]
            else:
                best = np.full(len(at), NEVER)
            done = best == NEVER
            for i, row, size in zip(at[done].tolist(), ids[done], (ids[done] >= 0).sum(axis=1).tolist(), strict=True):
                out[i] = row[:size].tobytes()
            if done.all():
                break
            on = ~done
            at, ids, ranks, least, best, n = at[on], ids[on], ranks[on], least[on], best[on], n[: int(on.sum())]
            ids[n, least] = best
            width = ids.shape[1] - 1  # each row is one id shorter now
            columns = np.arange(width)
            ids = np.take_along_axis(ids, columns + (columns > least[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= least[:, None]), axis=1)
            left, right = np.flatnonzero(least > 0), np.flatnonzero(least < width - 1)
            ranks[left, least[left] - 1] = self.pairs(ids[left, least[left] - 1], ids[left, least[left]])
            ranks[right, least[right]] = self.pairs(ids[right, least[right]], ids[right, least[right] + 1])
        return out

    def merged_long(self, piece: bytes) -> bytes:
        """Ids of one long piece.

        A round takes occurrences of the least rank, from the left and without overlap. Between two of
        them, merging one at a time would only do something else if the new token at once formed a
        better pair with a neighbour. Occurrences after such a one wait for the next round, unless they
        lie further from it than the longest token, where it can't reach them.
        """
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ids) > 1:
            best = ranks.min()
            if best == NEVER:
                break
            at = np.flatnonzero(ranks == best)
            run = np.cumsum(np.concatenate([[0], np.diff(at) != 1]))  # occurrences that overlap the one before; every second of them merges
            first = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            token = np.full(len(at), best, np.int32)
            follows = np.concatenate([[False], at[1:] == at[:-1] + 2])
            before = np.where(follows, best, ids[np.maximum(at - 1, 0)])
            better = (at > 0) & (self.pairs(before, token) < best)
            after = np.minimum(at + 2, len(ids) - 1)
            better |= (at + 2 < len(ids)) & (self.pairs(token, ids[after]) < best)
            if better.any():
                starts = np.concatenate([[0], np.cumsum(self.lengths[ids])])
                far = np.concatenate([[True], starts[at[1:]] - starts[at[:-1] + 2] > self.longest])
                group = np.cumsum(far) - 1
                worse = np.cumsum(better) - better  # better ones before
                kept = worse == worse[np.flatnonzero(far)][group]
                gone[at[~kept] + 1] = False
                at = at[kept]
            ids = ids.copy()
            ids[at] = best
            ids = ids[~gone]
            ranks = self.pairs(ids[:-1], ids[1:])
        return ids.tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Remembers the ids of pieces that aren't known."""
        buckets: list[list[tuple[str, bytes]]] = [[] for _ in WIDTHS]
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogateescape")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = np.int32(whole).tobytes()
            elif len(raw) > WIDTHS[-1]:
                self.known[piece] = self.merged_long(raw)
            else:
                buckets[bisect_left(WIDTHS, len(raw))].append((piece, raw))
        for bucket in buckets:
            for k in range(0, len(bucket), ROWS):
                part = bucket[k : k + ROWS]
                self.known.update(zip((p for p, _ in part), self.merged([raw for _, raw in part]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        split = [self.split(t) for t in texts]
        distinct = set(chain.from_iterable(split))
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        self.learn(distinct.difference(self.known))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def _encoder(shared) -> Encoder:
    """The encoder of a broadcast (ranks, pattern, newer code points); a worker's next tasks find it, and the pieces it knows, again."""
    return Encoder(*shared.value)


def _shared(df: DataFrame, path: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast((load_ranks(path), pattern, newer(pattern)))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "surrogateescape") for t in batch.column("text").to_pylist()]


def encode(documents: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids and n_tokens of each document; ids are those of the tiktoken library without special tokens.

    A null or empty text has no ids. Repeated rows each give a row, doc_id keeps its type, other columns
    are ignored, and an empty table gives an empty one. Texts are encoded whole, one document within one
    task. Ranks and pattern are read on the driver and sent to the tasks: their size is the vocabulary's.
    """
    shared = _shared(documents, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in slices(batches):
            found = encoder.encode(_texts(batch))
            offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(np.diff(offsets).astype(np.int64))], ["doc_id", "ids", "n_tokens"])

    schema = StructType([documents.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])
    return documents.select("doc_id", as_bytes("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id and raw (the bytes; a text, unless ids were cut within a code point) of rows with doc_id and ids; null or no ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            raw = [b"".join(map(bytes_of.__getitem__, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, StructType([encoded.schema["doc_id"], StructField("raw", BinaryType())]))


def digests(documents: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the bytes that the ids decode to); rows as ``encode`` gives them, whose ids stay within the task."""
    shared = _shared(documents, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in slices(batches):
            found = [ids.tolist() for ids in encoder.encode(_texts(batch))]
            listed = [hashlib.sha256(b",".join(map(encoder.decimal.__getitem__, ids))).hexdigest() for ids in found]
            decoded = [hashlib.sha256(encoder.decode(ids)).hexdigest() for ids in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = StructType([documents.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return documents.select("doc_id", as_bytes("text")).mapInArrow(run, schema)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
