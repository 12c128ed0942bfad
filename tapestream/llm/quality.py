"""Quality rules with host-level verdicts.

Each document gets its own rule flags; failures are aggregated by host, each host's failure rate is
shrunk towards a beta prior that the hosts themselves give, and hosts whose shrunken rate is high
lose their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written
from .text import BLANKS, CONTINUATION, as_bytes, slices

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
FEATURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def _repeat_words(codes: np.ndarray, docs: np.ndarray, n_codes: int) -> np.ndarray:
    """Marks each word that lies in a 3-word window which its document has twice or more."""
    marked = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return marked
    pairs = codes[:-1] * n_codes + codes[1:]
    if n_codes >= 2**21:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * n_codes + codes[2:]
    at = np.flatnonzero(docs[:-2] == docs[2:])
    at = at[np.argsort(windows[at], kind="stable")]  # positions, and so documents, stay in order within equal windows
    same = (windows[at][1:] == windows[at][:-1]) & (docs[at][1:] == docs[at][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k in range(3):
        marked[at[twice] + k] = True
    return marked


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        words = [t.split() for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        ids: dict[bytes, int] = {}
        codes = np.array([ids.setdefault(w, len(ids)) for doc in words for w in doc], np.int64)
        docs = np.repeat(np.arange(len(texts)), counts)
        repeats = np.bincount(docs, _repeat_words(codes, docs, max(len(ids), 1)), len(texts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("host"),
                pa.array(counts),
                pa.array([len(t.translate(None, BLANKS + CONTINUATION)) for t in texts], pa.int64()),
                pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], pa.int64()),
                pa.array([_dup_lines(t) for t in texts], pa.int64()),
                pa.array(repeats),
            ],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def features(documents: DataFrame, host: str = "source") -> DataFrame:
    """One row per document with its counts; a null text has no words."""
    return documents.select("doc_id", F.col(host).cast("string").alias("host"), as_bytes("text")).mapInArrow(_features, FEATURES)


def rules() -> dict[str, Column]:
    """Document-level rules: name to the condition on ``features`` under which a document fails."""
    repeats = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": repeats,
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > F.col("n_words") / 10),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    }


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Prior of the hosts' failure rates by moments; ``hosts`` has n_docs and n_failed. Two numbers reach the driver."""
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("h"), F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("r")).first()
    if not total or not total["n"]:
        return 1.0, 1.0
    mean = min(max(total["k"] / total["n"], 1e-3), 1 - 1e-3)
    noise = mean * (1 - mean) * total["r"]
    spread = max((total["v"] or 0.0) - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
    return mean * strength, (1 - mean) * strength


def host_verdicts(flagged: DataFrame, reject_rate: float = 0.75) -> DataFrame:
    """One row per host: n_docs, failures by rule, n_failed, its shrunken rate, and whether it is rejected."""
    by_rule = [F.count_if(F.col(f"fails_{name}")).alias(f"n_{name}") for name in rules()]
    hosts = written(flagged.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("fails").alias("n_failed"), *by_rule), "hosts")
    a, b = beta_prior(hosts)
    shrunken = (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", shrunken).withColumn("host_rejected", F.col("host_rate") >= reject_rate)


def quality(documents: DataFrame, host: str = "source", reject_rate: float = 0.75) -> DataFrame:
    """Counts, rule flags, host rate and verdict of every document.

    ``documents`` needs doc_id, text and the host column; others are ignored. A null or empty text has
    no words and fails. Documents without a host form one host of their own. Repeated rows each give
    a row. An empty table gives an empty table. kept: neither ``base_failed`` nor of a rejected host.
    """
    flagged = features(documents, host)
    for name, fails in rules().items():
        flagged = flagged.withColumn(f"fails_{name}", fails)
    flagged = flagged.withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats"))
    flagged = written(flagged.withColumn("fails", F.greatest(*(F.col(f"fails_{name}") for name in rules()))), "quality")
    hosts = host_verdicts(flagged, reject_rate).select(F.col("host").alias("of_host"), "n_docs", "n_failed", "host_rate", "host_rejected")
    joined = flagged.join(hosts, flagged.host.eqNullSafe(hosts.of_host), "left").drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *(f"fails_{name}" for name in rules()), F.round("host_rate", 6).alias("host_rate"), "host_rejected",
    )


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM windows) WHERE k > 1) GROUP BY doc_id
), features AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN repeats r ON r.doc_id = d.doc_id
), flagged AS (
  SELECT *, n_words < 50 AS fails_short, 100 * n_repeat_words > 50 * n_words AS fails_repeats, 10 * n_symbols > n_words AS fails_symbols,
         n_dup_lines >= 3 AND 10 * n_dup_lines > n_words / 10 AS fails_dup_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS fails_word_length FROM features
), hosts AS (
  SELECT host, count(*) AS n_docs, count(*) FILTER (fails_short OR fails_repeats OR fails_symbols OR fails_dup_lines OR fails_word_length) AS n_failed FROM flagged GROUP BY host
), moments AS (
  SELECT least(greatest(sum(n_failed) / sum(n_docs), 1e-3), 1 - 1e-3) AS m, coalesce(var_samp(n_failed / n_docs), 0) AS v, avg(1 / n_docs) AS r FROM hosts
), prior AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * r, 1e-6) - 1, 1), 1e4) AS s FROM moments
), rated AS (
  SELECT host AS of_host, (n_failed + m * s) / (n_docs + s) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, fails_short OR fails_repeats AS base_failed,
       NOT (fails_short OR fails_repeats) AND rate < 0.75 AS kept, fails_short, fails_repeats, fails_symbols, fails_dup_lines, fails_word_length,
       round(rate, 6) AS host_rate, rate >= 0.75 AS host_rejected
FROM flagged JOIN rated ON host IS NOT DISTINCT FROM of_host
"""
