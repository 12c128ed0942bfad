"""Connected components over DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that links reach) of every node in ``edges`` (a, b: long).

    Alternates two steps until nothing changes: each node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Both shrink every component towards a star around its
    smallest node in a logarithmic number of rounds. Edges never leave the cluster, each round is a
    reliable checkpoint, and a node with very many edges is met by plain joins, which AQE splits.
    Loops and nulls are ignored; no edges give no rows.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    held = checkpointed(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        ways = held.select("u", "v").union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = held.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are still changing after {most_rounds} rounds")
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
