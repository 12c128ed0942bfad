"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

Texts are cut into words, each marked by the space before it. The distinct words of a batch are
sorted, which is a depth-first walk through their trie: a word keeps the forward states of the
prefix it shares with the word before it, and only the rest is searched.

The scores of a merge vocabulary are the ranks of its merges, not probabilities; their sum means
nothing. What a path must satisfy instead is that merging leaves each of its joints alone: a step
from one piece to the next is open if encoding the two pieces' characters together gives just these
two. Exactly one path to each prefix is open throughout, and it is the one that merging takes, so the
search gives the pieces of the SentencePiece library.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose pieces a task remembers, and joints it has looked at; it forgets all beyond that, which changes no result.
REMEMBERED, JOINTS = 400_000, 2_000_000
#: When no merge ends a symbol.
NEVER = float("inf")


def merged(symbols: str, ranks: dict[str, float]) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """Plain merging: the best-ranked neighbours first, the leftmost among equals. Returns the pieces and how each merged one was made."""
    parts, made = list(symbols), {}
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        made[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, made


def load_model(path: str = MODEL) -> dict:
    """Pieces of a model file with their ids, ranks and halves, as plain lists and dictionaries (bounded by the vocabulary).

    Pieces that merging never makes are left out. Pieces of several marks are kept apart: they have the
    worst score of all, so marks run together when all words are done.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    normal = {model.id_to_piece(i): i for i in ids}
    words = {p: i for p, i in normal.items() if MARK not in p[1:]}
    ranks = {p: -model.get_score(i) for p, i in words.items() if len(p) > 1}
    halves = {}
    for piece in ranks:
        parts, made = merged(piece, ranks)
        if len(parts) == 1:
            halves[piece] = made[piece]
    return {
        "size": model.vocab_size(),
        "pieces": normal,
        "bytes": {int(model.id_to_piece(i)[3:-1], 16): i for i in range(model.vocab_size()) if model.is_byte(i)},
        "ranks": ranks,
        "halves": halves,
    }


class Encoder:
    def __init__(self, model: dict):
        pieces, self.ranks, self.halves = model["pieces"], model["ranks"], model["halves"]
        reached = {p: i for p, i in pieces.items() if len(p) == 1 or p in self.halves}
        self.names = {i: p for p, i in reached.items()}
        #: Pieces at a word's start (their mark cut off), pieces within a word, and pieces of marks alone by length, longest first.
        self.initial = {p[1:]: i for p, i in reached.items() if p[0] == MARK and len(p) > 1}
        self.inner = {p: i for p, i in reached.items() if p[0] != MARK}
        self.marks = sorted(((len(p), i) for p, i in pieces.items() if not p.strip(MARK)), reverse=True)
        self.mark = pieces.get(MARK, -1)
        self.beginning, self.inside = self.branches(self.initial), self.branches(self.inner)
        self.of_byte = model["bytes"]
        self.known: dict[str, bytes] = {}
        self.joints: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list] = {}
        self.piece_bytes = [b""] * model["size"]
        self.is_byte = np.zeros(model["size"], bool)
        for piece, i in pieces.items():
            self.piece_bytes[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.of_byte.items():
            self.piece_bytes[i] = bytes([byte])
            self.is_byte[i] = True

    def born(self, piece: str) -> float:
        """When merging makes a piece; a character is there from the start."""
        if piece not in self.halves:
            return -NEVER
        left, right = self.halves[piece]
        return max(self.ranks[piece], self.born(left), self.born(right))

    def spine(self, piece: int, side: int) -> list[tuple[str, float, float]]:
        """The symbols that stand at one end of a piece while it is made (0: its beginning, 1: its end), from when until when."""
        found = self.spines.get((piece, side))
        if found is None:
            name, dies, found = self.names[piece], NEVER, []
            while True:
                born = self.born(name)
                found.append((name, born, dies))
                if name not in self.halves:
                    break
                name, dies = self.halves[name][side], born
            self.spines[piece, side] = found
        return found

    def open(self, a: int, b: int) -> bool:
        """Whether merging leaves the joint of two pieces: no symbols that meet there become one before their own pieces take them in.

        At equal ranks the left merge is first. Characters without a piece (-1) merge with nothing.
        """
        if a < 0 or b < 0:
            return True
        found = self.joints.get((a, b))
        if found is None:
            if len(self.joints) >= JOINTS:
                self.joints.clear()
            found = True
            for x, x_born, x_dies in self.spine(a, 1):
                for y, y_born, y_dies in self.spine(b, 0):
                    rank = self.ranks.get(x + y)
                    if rank is not None and x_dies > max(rank, x_born, y_born) <= y_dies:
                        found = False
            self.joints[a, b] = found
        return found

    @staticmethod
    def branches(pieces: dict[str, int]) -> dict:
        """Nested dictionaries by character; under the empty key, the id of the piece that ends there."""
        root: dict = {}
        for piece, found in pieces.items():
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found
        return root

    def search(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Pieces of each word with its mark. Sort ``words`` to share most.

        Position 0 is before the mark, position k + 1 after the word's first k characters. ``back[k]``
        has start and id of the last piece of the only open path to there (-1: a character's bytes),
        ``active[k]`` the pieces begun before and still possible; both are kept for the prefix that the
        next word shares.
        """
        inside, joints, is_open = self.inside, self.joints, self.open
        back: list[tuple[int, int]] = [(0, -1), (0, self.mark)]
        active: list[list] = [[(0, self.beginning), (1, inside)]]
        last = ""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del back[shared + 2 :], active[shared + 1 :]
            for k in range(shared, len(word)):
                c, step, alive = word[k], None, []
                for start, node in active[k]:
                    node = node.get(c)
                    if node is not None:
                        alive.append((start, node))
                        if step is None and "" in node:
                            piece, before = node[""], back[start][1]
                            held = joints.get((before, piece)) if start else True
                            if held or (held is None and is_open(before, piece)):
                                step = (start, piece)
                alive.append((k + 2, inside))
                back.append(step or (k + 1, -1))
                active.append(alive)
            last = word
            at, steps = len(word) + 1, []
            while at > 0:
                start, piece = back[at]
                if piece >= 0:
                    steps.append(piece)
                else:
                    raw = (word[at - 2] if at > 1 else " ").encode("utf-8", "surrogateescape")
                    steps.extend([self.of_byte[b] for b in reversed(raw)])
                at = start
            yield word, steps[::-1]

    def run(self, n: int) -> list[int]:
        """Pieces of ``n`` marks: the longest first, as merging from the left gives them."""
        out = []
        for size, piece in self.marks:
            out += [piece] * (n // size)
            n %= size
        return out

    def spaced(self, words: list[str]) -> bytes:
        """Pieces of a text with marks that no word follows; they run together, also with a mark that its word leaves alone."""
        out, marks = [], 0
        for word in words:
            if not word:
                marks += 1
                continue
            ids = self.known[word]
            if marks:
                alone = ids[:4] == array("i", [self.mark]).tobytes()
                out.append(array("i", self.run(marks + alone)).tobytes())
                ids, marks = ids[4 * alone :], 0
            out.append(ids)
        out.append(array("i", self.run(marks)).tobytes())
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; an empty text has none."""
        split = [t.split(" ") if t else [] for t in texts]
        distinct = set(chain.from_iterable(split))
        distinct.discard("")
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        known = self.known
        for word, ids in self.search(sorted(distinct.difference(known))):
            known[word] = array("i", ids).tobytes()
        return [np.frombuffer(self.spaced(words) if "" in words else b"".join(map(known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        """The text of piece ids: marks become spaces, but for the first."""
        return b"".join(map(self.piece_bytes.__getitem__, ids))[1:]


def _encoded(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model)
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        found = encoder.encode([t.decode("utf-8", "surrogateescape") for t in texts])
        offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))),
                pa.array([len(ids) for ids in found], pa.int64()),
                pa.array([int(encoder.is_byte[ids].sum()) for ids in found], pa.int64()),
                pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids in found]),
                pa.array([encoder.decode(ids.tolist()) == text for ids, text in zip(found, texts, strict=True)]),
            ],
            ["doc_id", "ids", "n_pieces", "n_bytes", "ids_sha256", "round_trip"],
        )


def encode(documents: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes (pieces that are single bytes), ids_sha256 (of little-endian int32) and round_trip.

    The ids are the SentencePiece library's. Spaces and only spaces begin words; any other character that
    no piece holds, line ends among them, becomes its UTF-8 bytes, so decoding gives back the text exactly
    (round_trip says whether it does). One departure: the mark itself in a text becomes bytes and not a
    space, which the library would not give back. A null or empty text has no pieces. Repeated rows each give a row. The model's pieces
    are read on the driver and sent to the tasks: their number is fixed.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_model(model_path))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text")).mapInArrow(
        lambda batches: _encoded(batches, shared.value), "doc_id long, ids array<int>, n_pieces long, n_bytes long, ids_sha256 string, round_trip boolean"
    )


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null or no ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decoded, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
