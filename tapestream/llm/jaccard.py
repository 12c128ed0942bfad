"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersections.

1. Every document becomes a set of hashed shingles; documents with one set form a class.
2. Each class emits signatures so that two linked classes are sure to share one (see ``signatures``).
3. Classes that share a signature are bounded from above by the bit counts of their hashed bitmaps, pair
   by pair where few share it, in tiles of salted blocks where many do; what passes joins them into groups.
4. A group is cut into blocks by size; two blocks whose sizes are compatible form a tile. Within a
   tile, bitmaps bound every overlap again and sorted arrays are intersected exactly.

Classes go by a key of their own, so rows that repeat a doc_id with another text stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import written
from .text import WordHashes, as_bytes, mixed, ngram_hashes, slices

#: Share of all documents from which on a shingle counts as frequent. At most (shingles a document) / SHARE are.
SHARE = 0.0005
#: Shingles that are counted together; a shingle frequent over all is frequent in one such block.
BLOCK_SHINGLES = 6_000_000
#: Frequent shingles that are told apart from rare ones at most (8 MB): the most frequent of them.
MOST_FREQUENT = 1_000_000
#: A signature that more classes share is looked at in tiles of bitmaps, from which a tree of pairs comes back instead of all.
MOST_PAIRED = 32
#: Classes of one block of such a signature.
SIGNATURE_ROWS = 1024
#: Work of one block of a tile: shingles, plus ROW_COST for each class.
BLOCK_COST, ROW_COST = 2**18, 512
#: Bits of the filter that finds the texts of candidates (a prime; 2 MB). More ids than that let more texts pass, no fewer.
FILTER_BITS = 16_777_213
#: Below this size each shingle is a bucket of its own.
LEAST_BUCKETED = 64
SKETCH = "doc_id long, n long, h1 long, h2 long, bitmap binary, sigs array<long>"
U = np.uint64


class Shingler:
    def __init__(self, width: int):
        self.width, self.words = width, WordHashes()

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes; fewer words than the width make one shingle, none make none."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        n = min(self.width, len(words))
        found = ngram_hashes(self.words.of(words), n)
        return np.unique(found if n == self.width else mixed(found + U(n)))


def most_different(n: int, percent: int) -> int:
    """How many shingles at most two linked sets differ by if one has ``n``: n * (100 - p) / p."""
    return n * (100 - percent) // percent


def bucket_count(band: int, percent: int) -> int:
    """Buckets of sets with 2**band to 2**(band+1) - 1 shingles; 0: each shingle is a bucket of its own."""
    return 0 if 2**band < LEAST_BUCKETED else int(1.3 * (most_different(2 ** (band + 1), percent) + 1))


def signatures(hashes: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the first filled buckets of a set, of which any linked set shares one.

    The space of shingles is cut into ordered buckets: ranges of the rare ones, then every frequent one
    by itself. Linked sets differ in at most d shingles (``most_different``), so at most d buckets
    differ; of the first d + 1 filled buckets of either set, one at least is filled alike. The cut depends on
    the size band, so a set that may link into the band below emits signatures for that band too.
    """
    n = len(hashes)
    d = most_different(n, percent)
    if d < 1:  # such sets link with equal sets only, and those are one class
        return np.zeros(0, np.int64)
    often = np.isin(hashes, frequent, assume_unique=True) if len(frequent) else np.zeros(n, bool)
    rare, often = hashes[~often], hashes[often]
    out = []
    band = n.bit_length() - 1
    for b in (band, band - 1):
        if b < band and n * percent > 100 * (2**band - 1):
            break  # no linked set is that small
        need = min(d, most_different(2 ** (b + 1) - 1, percent)) + 1
        k = bucket_count(b, percent)
        if k and len(rare):
            bucket = ((rare >> U(32)) * U(k)) >> U(32)  # grows with the hash, and the hashes are sorted
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[:need]
            ends = np.append(starts[1:], len(rare) if len(starts) < need else np.searchsorted(bucket, bucket[starts[-1]], "right"))
            held = np.add.reduceat(mixed(rare[: ends[-1]] + U(7)), starts)
            found = mixed(held + bucket[starts] * U(0x9E3779B97F4A7C15))
        else:
            found = mixed(rare[:need] + U(11))
        if len(found) < need:
            found = np.concatenate([found, mixed(often[: need - len(found)] + U(13))])
        out.append(mixed(found + U(1000 + b)))
    return np.concatenate(out).view(np.int64)


def class_sums(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's hashes; sets with equal sums are equal but for a chance of 2**-128."""
    return int(mixed(hashes + U(3)).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(hashes + U(5))).view(np.int64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit per shingle at its hash, in a power of two of bits, two per shingle at least (uint64 words)."""
    bits = max(512, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 512
    at = hashes & U(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap in fewer bits: its parts laid over each other."""
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


def overlap_bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """No more shingles than this are in both sets: each bit that one lacks stands for a shingle it lacks."""
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _frequent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingles that are frequent within a block of documents, with their counts there, and the block's documents (shingle null)."""
    shingler, held, size, docs = Shingler(width), [], 0, 0

    def counted() -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(2, SHARE * docs)
        return pa.RecordBatch.from_arrays([pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()), pa.array([docs, *counts[often].tolist()], pa.int64())], ["shingle", "count"])

    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            held.append(shingler.of(text))
            size, docs = size + len(held[-1]), docs + 1
            if size >= BLOCK_SHINGLES:
                yield counted()
                held, size, docs = [], 0, 0
    if docs:
        yield counted()


def frequent_shingles(documents: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that at least SHARE of all documents (and 16) hold.

    Their number is bounded by the documents' mean size / SHARE, whatever the number of documents, and by
    MOST_FREQUENT. They only order buckets: which shingles are in decides nothing about the result.
    """
    counts = documents.select(as_bytes("text")).mapInArrow(lambda b: _frequent(b, width), "shingle long, count long")
    summed = written(counts.groupBy("shingle").agg(F.sum("count").alias("count")), "frequent")
    n = summed.where("shingle is null").agg(F.sum("count")).first()[0] or 0
    often = summed.where(F.col("shingle").isNotNull() & (F.col("count") >= max(16, SHARE * n)))
    found = often.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch], width: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(width)
    for batch in slices(batches):
        sizes, h1, h2, maps, sigs = [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hashes = shingler.of(text)
            sizes.append(len(hashes))
            a, b = class_sums(hashes) if len(hashes) else (doc_id, 0)  # an empty set is a class of its own
            h1.append(a)
            h2.append(b)
            maps.append(bitmap(hashes).tobytes())
            sigs.append(signatures(hashes, frequent, percent))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sigs)))],
            ["doc_id", "n", "h1", "h2", "bitmap", "sigs"],
        )


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for a link."""
    for batch in batches:
        kept = []
        for n_a, n_b, a, b in zip(*(batch.column(k).to_pylist() for k in ("n_a", "n_b", "map_a", "map_b")), strict=True):
            most = overlap_bound(np.frombuffer(a, np.uint64), n_a, np.frombuffer(b, np.uint64), n_b)
            kept.append(100 * most >= percent * (n_a + n_b - most))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def id_filter(members: DataFrame) -> np.ndarray:
    """Bits of the ids in ``members`` by their remainder: FILTER_BITS at most, whatever their number."""
    at = F.pmod(F.col("rep"), F.lit(FILTER_BITS))
    words = members.groupBy(F.floor(at / 32).cast("int").alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), at % 32).cast("long")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32 + 1, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _arrays(batches: Iterator[pa.RecordBatch], width: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted shingle hashes of documents whose id passes the filter, with the two sums that name their class."""
    shingler = Shingler(width)
    for batch in slices(batches):
        at = np.array(batch.column("rep").to_pylist(), np.int64) % FILTER_BITS
        chosen = batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))
        found = [shingler.of(t) for t in chosen.column("text").to_pylist()]
        sums = [class_sums(h) if len(h) else (0, 0) for h in found]
        columns = [chosen.column("rep"), pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "h1", "h2", "hashes"])


def _tiles(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], columns: tuple[str, ...], of: Callable[[tuple, list[tuple]], list[tuple]]) -> Iterator[list[tuple]]:
    """What ``of`` gives for each tile of batches that are sorted by the columns ``names``; a tile of one row gives nothing."""
    key, held = None, []
    for batch in batches:
        out = []
        for at, row in zip(zip(*(batch.column(k).to_pylist() for k in names), strict=True), zip(*(batch.column(k).to_pylist() for k in columns), strict=True), strict=True):
            if at != key:
                if len(held) > 1:
                    out += of(key, held)
                key, held = at, []
            held.append(row)
        yield out
    if len(held) > 1:
        yield of(key, held)


def _ahead(i: int, low: int, high: int, block: np.ndarray) -> np.ndarray:
    """The rows of a tile that row ``i`` is to be compared with: later ones of its own block, or all of the other."""
    return np.arange(i + 1, len(block)) if low == high else np.flatnonzero(block == high)


def _may_link(i: int, others: np.ndarray, sizes: np.ndarray, maps: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` whose sizes and bitmaps leave room for a link with ``i``."""
    n = sizes[others]
    others = others[100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i])]
    n, mine, theirs = sizes[others], maps[i], maps[others]
    most = np.minimum(sizes[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), n - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
    return others[100 * most >= percent * (sizes[i] + n - most)]


def _stacked(maps: list[np.ndarray]) -> np.ndarray:
    width = min(map(len, maps))
    return np.stack([folded(m, width) for m in maps])


def _tied(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that tie together all classes of a signature's tile which might link, one less than classes at most."""

    def tile(key: tuple, rows: list[tuple]) -> list[tuple]:
        _, low, high = key
        names, block, sizes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        maps = _stacked([np.frombuffer(r[3], np.uint64) for r in rows])
        label = np.arange(len(rows))
        for i in range(len(rows)) if low == high else np.flatnonzero(block == low).tolist():
            others = _ahead(i, low, high, block)
            near = _may_link(i, others[label[others] != label[i]], sizes, maps, percent)
            if len(near):
                label[np.isin(label, label[near])] = label[i]
        bound = np.flatnonzero(label != np.arange(len(rows)))
        return list(zip(names[bound].tolist(), names[label[bound]].tolist(), strict=True))

    for found in _tiles(batches, ("sig", "low", "high"), ("key", "block", "n", "bitmap"), tile):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each class with links in a tile: one class of its part of the tile, and how many documents it links with."""

    def tile(key: tuple, rows: list[tuple]) -> list[tuple]:
        _, low, high = key
        unique = {r[0]: r for r in rows}  # rows that repeat a document's id and text
        rows = sorted(unique.values(), key=lambda r: (r[1], r[3], r[0]))
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes, block = np.array([len(s) for s in sets]), np.array([r[1] for r in rows])
        maps = _stacked([bitmap(s) for s in sets])
        links = [0] * len(rows)
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(rows)) if low == high else np.flatnonzero(block == low).tolist():
            for j in _may_link(i, _ahead(i, low, high, block), sizes, maps, percent).tolist():
                at = np.searchsorted(sets[i], sets[j])
                at[at == sizes[i]] = 0
                both = int((sets[i][at] == sets[j]).sum())
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    links[i] += rows[j][4]
                    links[j] += rows[i][4]
                    root[find(j)] = find(i)
        return [(rows[i][0], rows[find(i)][0], n) for i, n in enumerate(links) if n]

    for found in _tiles(batches, ("grp", "low", "high"), ("key", "block", "hashes", "n", "size"), tile):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["a", "b", "links"])


def shares_size(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def candidate_groups(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: edges that tie together all classes which might link."""
    sigs = classes.select("key", "n", F.explode("sigs").alias("sig"))
    counts = sigs.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1")
    shared = written(sigs.join(counts, "sig"), "shared-signatures")
    maps = classes.select("key", "bitmap")

    few = shared.where(F.col("m") <= MOST_PAIRED)
    a, b = few.select("sig", F.col("key").alias("a"), F.col("n").alias("n_a")), few.select("sig", F.col("key").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, (a.sig == b.sig) & (a.a < b.b) & shares_size(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b").distinct()
    pairs = pairs.join(maps.select(F.col("key").alias("a"), F.col("bitmap").alias("map_a")), "a").join(maps.select(F.col("key").alias("b"), F.col("bitmap").alias("map_b")), "b")
    bounded = pairs.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(lambda x: _bounded(x, percent), "a long, b long")

    blocks = F.ceil(F.col("m") / SIGNATURE_ROWS)
    many = shared.where(F.col("m") > MOST_PAIRED).withColumn("block", F.pmod(F.xxhash64("key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    many = many.select("sig", "key", "n", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).join(maps, "key")
    tied = many.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high").mapInArrow(lambda x: _tied(x, percent), "a long, b long")
    return bounded.union(tied)


def blocks_by_size(members: DataFrame, percent: int) -> DataFrame:
    """grp, n, first and last block of that size, and the blocks from ``lowest`` to ``highest`` that hold sizes which may link with it.

    Blocks follow the running cost of a group's sizes. Only the counts of its sizes meet in one task,
    as many rows as it has different sizes.
    """
    cost = F.col("count") * (F.col("n") + ROW_COST)
    so_far = F.sum(cost).over(Window.partitionBy("grp").orderBy("n"))
    sizes = members.groupBy("grp", "n").agg(F.count("*").alias("count"))
    sizes = sizes.select("grp", "n", F.floor((so_far - cost) / BLOCK_COST).alias("first"), F.floor((so_far - 1) / BLOCK_COST).alias("last"))
    fine = 1_000_000  # sizes on a logarithmic scale of whole numbers
    reach = math.ceil(fine * math.log(100 / percent)) + 1
    near = Window.partitionBy("grp").orderBy(F.floor(fine * F.log("n"))).rangeBetween(-reach, reach)
    return sizes.select("*", F.min("first").over(near).alias("lowest"), F.max("last").over(near).alias("highest"))


def verified_links(documents: DataFrame, classes: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, links: for classes with links, a class of the same component and the number of documents they link with, tile by tile."""
    members = written(groups.select(F.col("node").alias("key"), F.col("component").alias("grp")).join(classes.select("key", "rep", "n", "size", "h1", "h2"), "key"), "members")
    bits = documents.sparkSession.sparkContext.broadcast(id_filter(members))
    dealt = members.join(blocks_by_size(members, percent), ["grp", "n"])
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("key"), F.col("last") - F.col("first") + 1)).drop("first", "last")
    texts = documents.where("doc_id is not null").select(F.col("doc_id").alias("rep"), as_bytes("text"))
    arrays = texts.mapInArrow(lambda b: _arrays(b, width, bits.value), "rep long, h1 long, h2 long, hashes binary")
    rows = arrays.join(dealt, ["rep", "h1", "h2"]).withColumn("other", F.explode(F.sequence("lowest", "highest"))).drop("rep", "h1", "h2", "lowest", "highest")
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    tiles = rows.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
    return tiles.mapInArrow(lambda b: _verified(b, percent), "a long, b long, links long")


def jaccard_join(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_links and component_id of every document.

    Words are lower-cased (A-Z) and cut at blanks; two documents link when the Jaccard similarity of
    their shingle sets is ``percent`` / 100 or more. A null, empty or blank text has no shingles and no
    links. Rows that repeat a doc_id count as documents of their own with one id; a row without an id
    links with nothing and has a null component. Equal sets link as one class, so copies are never
    paired. An empty table gives an empty table.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(frequent_shingles(documents, width))
    sketches = documents.select("doc_id", as_bytes("text")).mapInArrow(lambda b: _sketches(b, width, percent, frequent.value), SKETCH)
    sketches = written(sketches, "sketches")
    known = sketches.where("doc_id is not null").groupBy("h1", "h2")
    classes = known.agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("sigs").alias("sigs"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    groups = components(candidate_groups(classes.where("n > 0"), percent))
    links = written(verified_links(documents, classes, groups, width, percent), "links")
    of_key = components(links.select("a", "b")).withColumnRenamed("node", "key").join(classes.select("key", "rep"), "key")
    least = of_key.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = of_key.select("key", "component").join(least, "component").drop("component")
    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("linked"))
    of_class = classes.select("h1", "h2", "rep", "size", "key").join(found, "key", "left").join(counts, "key", "left")
    out = sketches.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, 0).otherwise(F.col("size") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "rep")).alias("component_id"),
    )


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS rep, any_value(s) AS s, count(*) AS size, list(doc_id) AS docs FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), shingles AS (
  SELECT rep, len(s) AS n, unnest(s) AS g FROM classes
), shared AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  WITH RECURSIVE r(node, root) USING KEY (node) AS (
    SELECT rep, rep FROM classes
    UNION
    SELECT w.b, min(r.root) FROM r JOIN ways w ON w.a = r.node JOIN recurring.r AS o ON o.node = w.b WHERE r.root < o.root GROUP BY w.b
  ) SELECT node, root FROM r
), degrees AS (
  SELECT w.a, sum(c.size) AS d FROM ways w JOIN classes c ON c.rep = w.b GROUP BY w.a
), members AS (
  SELECT unnest(c.docs) AS doc_id, c.size - 1 + coalesce(d, 0) AS n_links, root FROM classes c JOIN reach ON node = c.rep LEFT JOIN degrees ON a = c.rep
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(root, s.doc_id) AS component_id
FROM sets s LEFT JOIN members m ON s.doc_id = m.doc_id AND len(s.s) > 0
"""
