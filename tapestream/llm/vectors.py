"""Embedding near-dedup with a pivot-permutation index.

A bounded sample of vectors serves as pivots. Each vector is described by its nearest pivots in
order; inverted lists hold the vectors of every set of SHARED pivots among those, so two vectors meet
exactly when they share that many of their nearest pivots. What meets is verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import written

#: Pivots of a small table, at most, vectors up to which there are no more, and the cosine that two pivots stay below.
PIVOTS, MOST_PIVOTS, SMALL, PIVOT_COSINE = 192, 1023, 50_000, 0.7
#: How many of their nearest pivots two vectors must share to be compared.
SHARED = 3
#: Vectors of one block of an inverted list, about; a longer list is cut into tiles of two blocks.
BLOCK = 1024


def pivot_count(n: int) -> int:
    """Pivots for ``n`` vectors: with their cube root, so that the lists (one per SHARED pivots) stay as long as they are."""
    return min(MOST_PIVOTS, max(PIVOTS, int(PIVOTS * (n / SMALL) ** (1 / 3))))


def permutation_length(n_pivots: int) -> int:
    """Nearest pivots that describe a vector: more where pivots are dense, so that vectors of cosine 0.93 meet in 96 of 100 cases."""
    return 7 if n_pivots <= 2 * PIVOTS else 8


def usable(vector: str = "embedding"):
    """Neither null, empty nor zero, without null, NaN or infinite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` unit vectors that are far from those before: near copies would share a place in every permutation."""
    kept: list[np.ndarray] = []
    for v in x:
        if len(kept) < n and (not kept or (np.array(kept) @ v).max() < PIVOT_COSINE):
            kept.append(v)
    return np.array(kept)


def pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit pivots by dimension, out of the 4 * ``n`` vectors of each that hash lowest (a bounded sample)."""
    most = 4 * n
    hashed = vectors.select("uid", "dim", F.xxhash64(F.lit("pivot"), "x").alias("h"))
    counts = hashed.groupBy("dim").agg(F.count("*").alias("c"))
    # a few times as many as needed, by their hash, so that no task orders them all
    few = hashed.join(F.broadcast(counts), "dim").where(F.pmod("h", F.lit(1_000_000)) <= 2.0 * most / F.col("c") * 1_000_000)
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy("h", "uid"))).where(F.col("k") <= most).select("uid", "k")
    found: dict[int, list] = {}
    for row in vectors.join(F.broadcast(chosen), "uid").select("dim", "k", "x").orderBy("dim", "k").collect():
        found.setdefault(row["dim"], []).append(row["x"])
    return {d: spread(unit(np.array(x, np.float64)), n) for d, x in found.items()}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of unit vectors, nearest first; ties beyond nine digits go by number."""
    return np.argsort(-np.round(x @ pivot.T, 9), axis=1, kind="stable")[:, : permutation_length(len(pivot))]


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(batches: Iterator[pa.RecordBatch], pivot: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per vector and inverted list; the list's number spells its pivots, in base 1024."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            near = np.sort(nearest(unit(matrix(rows.column("x"), dim)), pivot[dim]), axis=1)
            ways = list(combinations(range(near.shape[1]), min(SHARED, near.shape[1])))
            cells = np.stack([sum(near[:, w].astype(np.int64) << 10 * k for k, w in enumerate(way)) for way in ways], axis=1)
            again = [pa.array(np.repeat(rows.column(k).to_numpy(), len(ways))) for k in ("uid", "label", "dim")]
            yield pa.RecordBatch.from_arrays([*again, pa.array(cells.ravel())], ["uid", "label", "dim", "cell"])


TILE = ("label", "dim", "cell", "low", "high")


def tile_links(key: tuple, rows: pa.RecordBatch, threshold: float, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors with links in a tile, one each is connected to there, and how many vectors it links with there.

    A pair counts in one list only: that of the first pivots it shares.
    """
    _, dim, cell, low, high = key
    uids, block, size = (rows.column(k).to_numpy() for k in ("uid", "block", "size"))
    x = unit(matrix(rows.column("x"), dim))
    near = nearest(x, pivot)
    shared = min(SHARED, near.shape[1])
    last = cell >> 10 * (shared - 1)
    has = np.zeros((len(uids), last + 1), np.float32)
    inside = near <= last
    has[np.nonzero(inside)[0], near[inside]] = 1
    linked = (x @ x.T >= threshold) & (has @ has.T == shared)
    np.fill_diagonal(linked, False)
    if low != high:
        linked &= block[:, None] != block[None, :]
    counts = linked @ size
    root, before = np.arange(len(uids)), None
    while before is None or (root != before).any():
        before = root.copy()
        for i in np.flatnonzero(counts).tolist():
            root[i] = min(root[i], root[linked[i]].min())
    at = np.flatnonzero(counts)
    return uids[at], uids[root[at]], counts[at]


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, pivot: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links of the tiles, whose rows arrive together."""
    key, held = None, []

    def closed() -> Iterator[pa.RecordBatch]:
        rows = pa.concat_batches(held) if held else None
        if rows is not None and rows.num_rows > 1:
            found = tile_links(key, rows, threshold, pivot[key[1]])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["a", "b", "links"])

    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in TILE], axis=1)
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end > start:
                new = tuple(keys[start].tolist())
                if new != key:
                    yield from closed()
                    key, held = new, []
                held.append(batch.slice(start, end - start).select(["uid", "block", "size", "x"]))
    yield from closed()


def links(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b, links of every vector with links; ``vectors`` has uid, label, dim, size (vectors it stands for) and x, all usable."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots(vectors, pivot_count(vectors.count())))
    kind = "label long, dim int"
    keys = written(vectors.select("uid", "label", "dim", "x").mapInArrow(lambda b: _lists(b, shared.value), f"uid long, {kind}, cell long"), "vector-lists")
    lists = keys.groupBy("label", "dim", "cell").agg(F.count("*").alias("m")).where("m > 1").select("label", "dim", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    blocked = keys.join(lists, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    tiled = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("uid", "label", "dim", "cell", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = tiled.join(vectors.select("uid", "size", "x"), "uid")
    return rows.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(lambda b: _verified(b, threshold, shared.value), "a long, b long, links long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label).

    Vectors of equal label and length are compared; equal ones link as one class and are never paired. A
    null id or label, and a vector that is null, zero or holds null or non-finite components, links with
    nothing; kept is then true. Rows that repeat an id are vectors of their own. An empty table gives an
    empty table.
    """
    table = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    table = table.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.coalesce(F.size("x"), F.lit(0)))
    compared = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("x")
    # two digests of a vector tell it from all others but for a chance of 2**-128
    table = written(table.withColumn("h1", F.when(compared, F.xxhash64("x"))).withColumn("h2", F.when(compared, F.xxhash64(F.lit(1), F.reverse("x")))), "vectors")
    alike = ["label", "dim", "h1", "h2"]
    classes = table.where("h1 is not null").groupBy(*alike).agg(F.min("uid").alias("rep"), F.count("*").alias("size"))
    classes = written(classes, "vector-classes")
    first = table.select("uid", "x").join(classes.select(F.col("rep").alias("uid"), "label", "dim", "size"), "uid")
    first = written(first, "vector-firsts")
    found = written(links(first, threshold), "vector-links")
    groups = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n"))
    of_class = classes.join(groups, "rep", "left").join(counts, "rep", "left").select(*alike, "size", "n", F.coalesce("component", "rep").alias("component"))
    joined = written(table.select("vec_id", *alike).join(of_class, alike, "left"), "vector-groups")
    least = joined.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = joined.join(least, "component", "left")
    component = F.coalesce("least", "vec_id")
    n_links = F.coalesce(F.col("size") - 1 + F.coalesce("n", F.lit(0)), F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL
), ways AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  WITH RECURSIVE r(node, root) USING KEY (node) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT w.b, min(r.root) FROM r JOIN ways w ON w.a = r.node JOIN recurring.r AS o ON o.node = w.b WHERE r.root < o.root GROUP BY w.b
  ) SELECT node, root FROM r
)
SELECT v.vec_id, (SELECT count(*) FROM ways w WHERE w.a = v.vec_id)::BIGINT AS n_links, root AS component_id, v.vec_id = root AS kept
FROM v JOIN reach ON node = v.vec_id
"""
