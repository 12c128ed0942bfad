"""What filters of a corpus do to each other, in any order of application.

Words are counted in a sparse document-term matrix. Tasks build shards in compressed-row form over words
of their own; the words of all shards, each once per shard, make the global dictionary, whose terms go
back to the shards and replace their own. Row sums and nonzero counts of the matrix decide
the filters about words, the other flags go along with the rows, and only counts by part, set of
failed filters and labels are left of the documents when the orders are laid out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .runtime import dropped, shuffle_files_freed, written
from .text import CONTINUATION, as_bytes, mixed, slices

FILTERS = "ABCDE"
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
MIN_WORDS = 200
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 8_000_000
#: Attributes of a shard's rows, one list each.
ATTRIBUTES = {"parts": StringType(), "fails_c": BooleanType(), "fails_d": BooleanType(), "h1": LongType(), "h2": LongType()}


def _csr(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and row starts, word numbers and counts of the rows; words are split at exactly 0x20 and 0x09-0x0D."""
    listed = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))
    rows, words = pc.list_parent_indices(listed), pc.list_flatten(listed)
    there = pc.greater(pc.binary_length(words), 0)  # blanks at the ends of a text leave empty words
    coded = words.filter(there).view(pa.binary()).dictionary_encode()
    width = max(len(coded.dictionary), 1)
    cells, counts = np.unique(rows.filter(there).to_numpy().astype(np.int64) * width + coded.indices.to_numpy(), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(texts) + 1) * width)
    return coded.dictionary, starts, cells % width, counts


def _lists(values: pa.Array, starts=(0,)) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([*starts, len(values)], pa.int32()), values)


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers on their way through a shuffle."""
    return zstandard.compress(values.astype(np.int32).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.int32)


def _dealt(words: pa.Array, parts: int) -> pa.Array:
    """Distinct words by their part of the dictionary: p, words (sorted, joined by a blank) and their numbers."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(words) else np.empty(0, np.uint8)
    ends = ends - ends[0]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    hashes = mixed(np.add.reduceat(data * powers[place], ends[:-1])) if len(words) else np.empty(0, np.uint64)
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    part = (hashes % np.uint64(parts)).astype(np.int32)[order]
    within = np.argsort(part, kind="stable")
    order, part = order[within], part[within]
    starts = np.flatnonzero(np.diff(part, prepend=-1)).astype(np.int32)
    bounds = [*starts.tolist(), len(order)]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(order))), b" ")
    local = pa.array([_packed(order[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
    return pa.StructArray.from_arrays([pa.array(part[starts], pa.int32()), joined, local], ["p", "words", "local"])


def _shards(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for k, batch in enumerate(slices(batches, most_bytes=SHARD_BYTES)):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        words, *cells = _csr(batch.column("text"))
        capitals = [100 * (len(t) - len(t.translate(None, CAPITALS))) > 3 * len(t.translate(None, CONTINUATION)) for t in texts]
        hashes = [divmod(xxhash.xxh3_128_intdigest(t), 2**64) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([first + k], pa.int64()),
                _lists(batch.column("doc_id")),
                _lists(batch.column("part")),
                _lists(pa.array(capitals, pa.bool_())),
                _lists(pa.array([len(t.translate(None, SYMBOLS)) < len(t) for t in texts], pa.bool_())),
                *(_lists(pa.array([_signed(h[i]) for h in hashes], pa.int64())) for i in (0, 1)),
                _lists(_dealt(words, parts)),
                *(pa.array([_packed(a)], pa.binary()) for a in cells),
            ],
            ["shard", "doc_ids", *ATTRIBUTES, "own", "starts", "terms", "counts"],
        )


def shards(documents: DataFrame, part: str, parts: int) -> DataFrame:
    """Rows in compressed form over the words of their shard: shard, doc_ids, attributes, own, starts, terms, counts.

    ``own`` has the shard's words by the part of the dictionary they belong to (p, words: sorted and joined by the blank that
    none of them holds, local: their numbers within the shard); terms are such numbers.
    """
    own = StructType([StructField("p", IntegerType()), StructField("words", BinaryType()), StructField("local", BinaryType())])
    lists = {"doc_ids": documents.schema["doc_id"].dataType, **ATTRIBUTES, "own": own}
    schema = StructType([StructField("shard", LongType()), *(StructField(name, ArrayType(kind)) for name, kind in lists.items()), *(StructField(name, BinaryType()) for name in ("starts", "terms", "counts"))])
    named = F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    return documents.select("doc_id", named, as_bytes("text")).mapInArrow(lambda batches: _shards(batches, parts), schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the words within their part of the dictionary, in the order of the shards; holds one part's words."""
    part, numbers = None, {}
    for batch in batches:
        out = []
        for p, words, local in zip(*(batch.column(n).to_pylist() for n in ("p", "words", "local")), strict=True):
            if p != part:
                part, numbers = p, {}
            known, listed = len(numbers), words.split(b" ")
            found = np.fromiter((numbers.setdefault(w, len(numbers)) for w in listed), np.int64, len(listed))
            new = found >= known
            out.append((_packed(found), local, known, b" ".join(w for w, n in zip(listed, new.tolist(), strict=True) if n) if new.any() else None))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)] if out else []
        if columns:
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("p"), *columns], ["shard", "p", "number", "local", "known", "new"])


def _renumbered(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Shards over the words of the dictionary: a part's n-th word is term n * parts + part."""
    for batch in batches:
        for i in range(batch.num_rows):
            starts, local, counts = (_unpacked(batch.column(n)[i].as_py()) for n in ("starts", "terms", "counts"))
            of = [(p["p"], _unpacked(p["local"]), _unpacked(p["number"])) for p in batch.column("of")[i].as_py()]
            table = np.zeros(sum(len(own) for _, own, _ in of), np.int64)
            for p, own, number in of:
                table[own] = number.astype(np.int64) * parts + p
            terms = table[local]
            order = np.argsort(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * (terms.max(initial=0) + 1) + terms)
            kept = [batch.slice(i, 1).column(n) for n in ("shard", "doc_ids", *ATTRIBUTES)]
            yield pa.RecordBatch.from_arrays([*kept, *(_lists(pa.array(a)) for a in (starts, terms[order], counts[order]))], ["shard", "doc_ids", *ATTRIBUTES, "starts", "terms", "counts"])


def _split(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, known, new in zip(*(batch.column(n).to_pylist() for n in ("p", "known", "new")), strict=True):
            words = new.split(b" ")
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array((known + np.arange(len(words))) * parts + p)], ["word", "term"])


def matrix(documents: DataFrame, part: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of whole texts and its dictionary (word: binary, term: long).

    The matrix has a row per shard, in compressed-row form: shard, doc_ids and the attributes of its documents
    (lists of one length), starts (row i's cells are those from starts[i] to starts[i + 1]), terms and
    counts. Only a shard's distinct words and its cells are shuffled, not the texts. The dictionary is in as many parts
    as there are shuffle partitions, by a hash of the word; one task numbers one part's words and
    holds only these. Terms count through the parts in turn, so they have few gaps. Both results are
    tables below ``spark.checkpoint.dir``: no lost executor gives a word another term.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffle_files_freed(spark):
        local = written(shards(documents, part, parts), "matrix-local", "zstd")
        words = local.select("shard", F.explode("own").alias("o")).select("shard", "o.*")
        dealt = words.repartition(parts, "p").sortWithinPartitions("p", "shard")
        terms = written(dealt.mapInArrow(_numbered, "shard long, p int, number binary, local binary, known long, new binary"), "dictionary", "zstd")
        of = terms.groupBy("shard").agg(F.collect_list(F.struct("p", "local", "number")).alias("of"))  # bounded by a shard's words
        nothing = F.array().cast("array<struct<p:int,local:binary,number:binary>>")
        joined = local.drop("own").join(of, "shard", "left").withColumn("of", F.coalesce("of", nothing))
        kinds = {"starts": IntegerType(), "terms": LongType(), "counts": IntegerType()}
        schema = StructType([*(f for f in local.schema if f.name in ("shard", "doc_ids", *ATTRIBUTES)), *(StructField(n, ArrayType(k)) for n, k in kinds.items())])
        whole = written(joined.mapInArrow(lambda batches: _renumbered(batches, parts), schema), "matrix", "zstd")
    dropped(local)
    return whole, terms.select("p", "known", "new").where("new is not null").mapInArrow(lambda batches: _split(batches, parts), "word binary, term long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            starts, counts = (batch.column(n)[i].values.to_numpy() for n in ("starts", "counts"))
            sums = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[starts])
            attributes = [batch.column(n)[i].values for n in ("doc_ids", *ATTRIBUTES)]
            yield pa.RecordBatch.from_arrays([*attributes, pa.array(sums), pa.array(np.diff(starts).astype(np.int64))], ["doc_id", *ATTRIBUTES, "n_words", "n_distinct"])


def rows(whole: DataFrame) -> DataFrame:
    """doc_id, attributes, n_words (row sum) and n_distinct (nonzero cells) of each row of a matrix; its terms aren't read."""
    schema = StructType([StructField("doc_id", whole.schema["doc_ids"].dataType.elementType), *(StructField(n, k) for n, k in ATTRIBUTES.items()), StructField("n_words", LongType()), StructField("n_distinct", LongType())])
    return whole.select("doc_ids", *ATTRIBUTES, "starts", "counts").mapInArrow(_rows, schema)


def flagged(documents: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, n_words, n_distinct and fails_a to fails_e of every document.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals (A-Z) > 3 * code points; D: any of
    ``#$%&*|``; E: the text of a smaller doc_id, 128-bit hashes of texts standing for them. A null text
    is empty; a null doc_id is no smaller than any and has no smaller one; rows that repeat one id
    aren't smaller than each other. A null part is the empty string. Other columns are ignored.
    """
    counted = rows(matrix(documents, part)[0])
    first = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = counted.join(first, ["h1", "h2"], "left")
    return joined.select(
        "doc_id", F.col("parts").alias("part"), "n_words", "n_distinct", (F.col("n_words") < MIN_WORDS).alias("fails_a"), (100 * F.col("n_distinct") < 50 * F.col("n_words")).alias("fails_b"),
        "fails_c", "fails_d", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("fails_e"),
    )


def _layout() -> list[tuple[str, int, str, int, int]]:
    """filter_order, step, its filter, its bit, and the bits of those before."""
    found = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            found.append((order, step, letter, 1 << FILTERS.index(letter), before))
            before |= found[-1][3]
    return found


def interactions(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row, zeros included, per part, filter_order and step, with the counts that the filters' order gives there.

    kept (after this step), removed (here), redundant (failing its filter, removed earlier), unique_fails (failing it
    only), good_lost and toxic_lost (removed here with a label quality or toxic of 1), shapley (removed by
    this filter in all orders). A document with several labels is good or toxic if one of them says so; labels of
    null ids meet nothing. An empty table has no part and gives no row. What is laid out by orders is at
    most 32 rows per part, one for each set of failed filters.
    """
    mask = sum((F.col(f"fails_{letter.lower()}").cast("int") * (1 << i) for i, letter in enumerate(FILTERS)), F.lit(0))
    named = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counts = flagged(documents, part).select("doc_id", "part", mask.alias("mask")).join(named, "doc_id", "left")
    sets = counts.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    layout = [F.lit(list(column)).alias(name) for name, column in zip(("filter_order", "step", "filter", "bit", "before"), zip(*_layout(), strict=True), strict=True)]
    laid = sets.select("*", F.explode(F.arrays_zip(*layout)).alias("at")).select("part", "mask", "n", "good", "toxic", "at.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier

    def total(test, value: str = "n"):
        return F.sum(F.when(test, F.col(value)).otherwise(0)).cast("long")

    cells = laid.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~earlier).alias("kept"), total(here).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
    )
    shares = cells.groupBy("part", "filter").agg(F.sum("removed").cast("long").alias("shapley"))
    return cells.join(shares, ["part", "filter"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), named AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM docs LEFT JOIN named USING (doc_id)
), failed AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END) AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)
), laid AS (
  SELECT *, contains(failed, filter) AS fails, len(list_filter(string_split(failed, ''), lambda x: x <> '' AND contains(before, x))) > 0 AS earlier FROM failed, steps
), cells AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = filter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM laid GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM cells
"""
