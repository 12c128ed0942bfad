"""Mixing sources to target weights, with DataFrame functions only.

Sizes are aggregated per source, targets give each source a repetition rate, and every document is
emitted floor(rate) times plus one more time with the remaining probability, drawn from a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written
from .text import word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every document; a null text has size 0."""
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row per source with its total size and its rank by code point, null last.

    Ranks come from range partitions: a rank within the partition plus the rows of those before it,
    so that no task sees all sources. Only one count per partition reaches the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for row in placed.groupBy("part").count().orderBy("part").collect():
        offsets += [F.lit(row["part"]), F.lit(before)]
        before += row["count"]
    offset = F.element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return placed.withColumn("rank", offset + within - 1).drop("part")


def weight_of(rank: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to ranked sources: shares of the total size by weight, none above its cap.

    What caps cut off is shared again by weight until no source is above its cap; each round is one
    aggregate of which three numbers reach the driver. Sources of size 0 get target 0.
    """
    weighed = written(sources.withColumn("weight", weight_of(F.col("rank"), weights)).withColumn("cap", F.col("source_size") * float(most_repeats)), "weights")
    total = weighed.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, held = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        row = weighed.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("cut"), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("open"), F.count_if(capped).alias("n")).first()
        if row["n"] == held or not row["open"]:
            break
        held, level = row["n"], (total - row["cut"]) / row["open"]
    return weighed.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def draw(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that only the keys and the seed decide: 52 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("-")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def mixed_counts(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """Every document with size, source_size, target, rate and copies (how often the mix takes it).

    A null source is a source of its own, the last one. Rows that repeat a doc_id draw alike. Empty
    texts have size 0; a source without words has rate 0. An empty table gives an empty table.
    """
    sizes = written(sized(documents), "sizes")
    shares = targets(ranked_sources(sizes), weights, most_repeats).select(F.col("source").alias("of_source"), "source_size", "target")
    joined = sizes.join(shares, sizes.source.eqNullSafe(shares.of_source), "left").drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    more = draw(F.col("doc_id"), seed=seed) < F.col("rate") - F.floor("rate")
    return joined.withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("long") + more.cast("long"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """The mixed corpus: rows of ``documents`` with all their columns, each as often as the mix takes it."""
    shares = targets(ranked_sources(written(sized(documents), "sizes")), weights, most_repeats)
    of_source, of_rate = "__mix_source", "__mix_rate"
    rates = shares.select(F.col("source").alias(of_source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(of_rate))
    joined = documents.join(rates, documents["source"].cast("string").eqNullSafe(rates[of_source]), "left")
    more = draw(documents["doc_id"], seed=seed) < F.col(of_rate) - F.floor(of_rate)
    copies = (F.floor(of_rate) + more.cast("long")).cast("int")
    return joined.withColumn(of_rate, F.explode(F.array_repeat(F.lit(0), copies))).drop(of_source, of_rate)


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixed_counts(documents)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM sources
), levels AS (
  SELECT a.k, (sum(b.source_size)::DOUBLE - coalesce(sum(b.cap) FILTER (b.k < a.k), 0)) / sum(b.weight) FILTER (b.k >= a.k) AS level
  FROM ordered a, ordered b GROUP BY a.k
), found AS (
  SELECT level FROM levels JOIN ordered USING (k) WHERE cap > weight * level ORDER BY k LIMIT 1
), shares AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM found), 0)) AS target FROM ordered
), rated AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sizes s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source
), drawn AS (
  SELECT *, (floor(rate) + (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '-')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate))::INT)::BIGINT AS copies
  FROM rated
)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM drawn
"""
