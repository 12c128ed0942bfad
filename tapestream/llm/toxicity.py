"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Texts become sets of hashed features in parallel; the learner goes through a bounded sample of
labelled rows; L1 leaves few weights, which go to every task in one array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import FOLD
from .text import WordHashes, as_bytes, mixed, slices

#: The weights are one array of 2**BITS numbers.
BITS = 20
#: A stem is a word's first bytes; stems stand for unseen inflections.
STEM = 5
#: Text hashed at once; its features take some fifty times as much memory.
SLICE_BYTES = 1_000_000
#: Labelled rows to learn from at most (about; chosen by hash).
MAX_TRAIN_ROWS = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3.0, 0.1, 3
THRESHOLD = 0.3


class Hasher:
    """Feature numbers of words, stems, bigrams and one-word skip-grams."""

    def __init__(self) -> None:
        self.words, self.stems = WordHashes(200_000), WordHashes(100_000)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Documents (positions in ``texts``) and features, repeats included."""
        split = [t.translate(FOLD).split() for t in texts]
        flat = [w for doc in split for w in doc]
        docs = np.repeat(np.arange(len(texts), dtype=np.int64), [len(d) for d in split])
        hashes = self.words.of(flat)
        stems = self.stems.of([w[:STEM] for w in flat])
        found = [(docs, hashes), (docs, mixed(stems + np.uint64(1)))]
        for gap, salt in ((1, 2), (2, 3)):
            together = docs[:-gap] == docs[gap:]
            pairs = mixed(hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:] + np.uint64(salt))
            found.append((docs[:-gap][together], pairs[together]))
        return np.concatenate([d for d, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)).astype(np.int64)


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in slices(batches, most_bytes=SLICE_BYTES):
        docs, features = hasher.of([t or b"" for t in batch.column("text").to_pylist()])
        keys = np.unique((docs << BITS) | features)
        bounds = np.searchsorted(keys, np.arange(len(batch) + 1) << BITS)
        low = (keys & ((1 << BITS) - 1)).astype(np.int32)
        sets = [low[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array(sets, pa.binary())], ["order", "toxic", "features"])


def ftrl(rows: list[tuple[int, int, np.ndarray]], alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights learned from (order, label, features) in that order; each coordinate has its own rate."""
    z, n = np.zeros(2**BITS), np.zeros(2**BITS)
    bias = bias_n = 0.0
    rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2])))

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for _, label, at in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + bias_n**0.5)
    return float(bias), weights(np.arange(2**BITS))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(o, t, np.frombuffer(f, np.int32)) for b in batches for o, t, f in zip(*(b.column(k).to_pylist() for k in ("order", "toxic", "features")), strict=True)]
    if rows:
        bias, weights = ftrl(rows)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *weights[at].tolist()], pa.float64())], ["feature", "weight"])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out. A null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def training_rows(labels: DataFrame, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic and an order for about ``most`` labelled ids that aren't held out; an id with several labels is toxic if one says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = known.count()
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    chosen = known.withColumn("order", order)
    return chosen.where(F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * most / count)) if count > most else chosen


def learn(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS) -> tuple[float, np.ndarray] | None:
    """Bias and weights (2**BITS numbers, the driver's share) from a bounded sample; None without labelled texts."""
    sample = F.broadcast(training_rows(labels, most))  # at most about ``most`` rows of 20 bytes
    texts = documents.select("doc_id", as_bytes("text")).join(sample, "doc_id").select("order", "toxic", "text")
    sets = texts.mapInArrow(_feature_sets, "order long, toxic int, features binary")
    found = sets.repartition(1).mapInArrow(_learn, "feature long, weight double").toArrow()
    if not found.num_rows:
        return None
    at, values = found.column("feature").to_numpy(), found.column("weight").to_numpy()
    weights = np.zeros(2**BITS, np.float32)
    weights[at[at >= 0]] = values[at >= 0]
    return float(values[at < 0][0]), weights


def score(documents: DataFrame, model: tuple[float, np.ndarray] | None, column: str = "toxicity") -> DataFrame:
    """All columns of ``documents`` and the score (0 to 1) as ``column``; without a model it is 0. A null or empty text gets the bias alone."""
    if model is None:
        return documents.withColumn(column, F.lit(0.0))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        bias, weights = shared.value
        hasher, out = Hasher(), []
        text = pa.array(texts, pa.binary())
        for part in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), most_bytes=SLICE_BYTES):
            docs, features = hasher.of([t or b"" for t in part.column("text").to_pylist()])
            used = weights[features] != 0
            keys = np.unique((docs[used] << BITS) | features[used])
            sums = np.bincount(keys >> BITS, weights[keys & ((1 << BITS) - 1)].astype(np.float64), len(part)) if len(keys) else np.zeros(len(part))
            out.append(1 / (1 + np.exp(-np.clip(bias + sums, -35, 35))))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return documents.withColumn(column, scored(F.col("text").cast("binary")))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only text is scored; of ``labels``, doc_id and toxic are read, and held-out ids never. Rows that
    repeat a doc_id each give a row; a null doc_id isn't held out and has no label.
    """
    texts = documents.select("doc_id", "text")
    scored = score(texts, learn(texts, labels, most))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
