"""Line dedup by pairwise alignment.

Documents that share a run of lines are paired, each pair is aligned with patience diff, and the
aligned common blocks go from the later document (the larger id). What an alignment leaves out
because it crosses or repeats is found by the pair's matching statistics, so a later document keeps
no common run of a pair.

Pairs are proposed by a document's shortest runs of lines with enough words to go (one line, if it is
long): each holder of a run is paired with the first one, so a run that a third of all documents hold
costs one pair for each of them. No other pair is needed: the shortest runs within a common run cover
it, and each goes in the pair with its own first holder.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written
from .text import word_count

#: Blocks of fewer words stay.
MIN_BLOCK_WORDS = 8
#: Of the runs' polynomial hashes.
PRIME, FACTOR = 2**127 - 1, 0x5851F42D4C957F2D14057B7EF767814F
#: Later documents, about, that one copy of an earlier document's lines is sent with.
TILE = 64
#: Rows that are Python lists at a time; changes no result.
SLICE = 256


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Lines that are unique in both, as the longest chain that rises in both."""
    once_a, once_b = Counter(a), Counter(b)
    where = {line: j for j, line in enumerate(b) if once_b[line] == 1}
    common = [(i, where[line]) for i, line in enumerate(a) if once_a[line] == 1 and line in where]
    tops: list[int] = []  # smallest last position in b of a chain of each length
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(common):
        at = bisect_left(tops, j)
        before.append(ends[at - 1] if at else -1)
        tops[at:] = [j, *tops[at + 1 :]]
        ends[at:] = [k, *ends[at + 1 :]]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(common[k])
        k = before[k]
    return chain[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two lists of lines: equal ends first, then unique lines, then what lies between those."""
    out = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = anchors(a[a0:a1], b[b0:b1])
        last = (a0, b0)
        for i, j in found:
            out.append((a0 + i, b0 + j))
            stack.append((last[0], a0 + i, last[1], b0 + j))
            last = (a0 + i + 1, b0 + j + 1)
        if found:
            stack.append((last[0], a1, last[1], b1))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Positions in the later document of blocks that stand together in both."""
    out: list[list[int]] = []
    last = None
    for i, j in pairs:
        if last == (i - 1, j - 1):
            out[-1].append(j)
        else:
            out.append([j])
        last = (i, j)
    return out


def automaton(a: list) -> tuple[list[dict], list[int], list[int]]:
    """Suffix automaton of a list: following states, links and lengths of its states."""
    following, link, length, last = [{}], [-1], [0], 0
    for x in a:
        state, above = len(link), last
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        while above >= 0 and x not in following[above]:
            following[above][x] = state
            above = link[above]
        if above >= 0:
            child = following[above][x]
            if length[child] > length[above] + 1:
                copy = len(link)
                following.append(dict(following[child]))
                link.append(link[child])
                length.append(length[above] + 1)
                link[child] = copy
                while above >= 0 and following[above].get(x) == child:
                    following[above][x] = copy
                    above = link[above]
                child = copy
            link[state] = child
        last = state
    return following, link, length


def repeats(a: list, b: list, words: list[int]) -> list[int]:
    """Positions in b of all runs of lines with enough words that stand in a as well, in whatever order and however often."""
    shared = set(a) & set(b)
    following, link, length = automaton([x if x in shared else None for x in a])
    before = [0, *accumulate(words)]
    out: list[int] = []
    state = held = done = 0
    for j, x in enumerate(b):
        while state and x not in following[state]:
            state = link[state]
            held = length[state]
        state, held = (following[state][x], held + 1) if x in following[state] else (0, 0)
        first = j + 1 - held  # of the longest run up to here; never falls
        if before[j + 1] - before[first] >= MIN_BLOCK_WORDS:
            out.extend(range(max(first, done), j + 1))
            done = j + 1
    return out


def removed(a: list, b: list, words: list[int]) -> list[int]:
    """Positions that b loses to a: the aligned blocks, and the common runs that one rising alignment leaves out (crossing or repeated lines)."""
    gone = {j for block in blocks(patience(a, b)) if sum(words[j] for j in block) >= MIN_BLOCK_WORDS for j in block}
    known = set(a)
    for common, run in groupby(range(len(b)), lambda j: b[j] in known):
        at = list(run) if common else []
        if sum(words[j] for j in at) >= MIN_BLOCK_WORDS and not gone.issuperset(at):
            gone.update(repeats(a, b, words))
            break
    return sorted(gone)


def shortest_runs(lines: list[bytes], words: list[int]) -> set[bytes]:
    """Hashes of the shortest runs with enough words from each line on and up to each line.

    Within any run of enough words, those of its shortest runs that begin or end at its lines cover all of it.
    """
    before, sums, powers = [0, *accumulate(words)], [0], [1]
    for x in lines:
        sums.append((sums[-1] * FACTOR + int.from_bytes(x, "big") + 1) % PRIME)
        powers.append(powers[-1] * FACTOR % PRIME)
    places, end, start = set(), 0, 0
    for i in range(len(lines)):
        while end < len(lines) and before[end] - before[i] < MIN_BLOCK_WORDS:
            end += 1
        if before[end] - before[i] >= MIN_BLOCK_WORDS:
            places.add((i, end))
        while before[i + 1] - before[start + 1] >= MIN_BLOCK_WORDS:
            start += 1
        if before[i + 1] - before[start] >= MIN_BLOCK_WORDS:
            places.add((start, i + 1))
    return {((sums[e] - sums[s] * powers[e - s]) % PRIME).to_bytes(16, "big") for s, e in places}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            ids, versions, runs = [], [], []
            for i, v, lines, words in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "version", "lines", "words")), strict=True):
                found = shortest_runs(lines, words)
                ids += [i] * len(found)
                versions += [v] * len(found)
                runs += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(runs, pa.binary())], ["doc_id", "version", "run"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles arrive row by row: first the earlier document's lines, then the later documents that are aligned with it."""
    earlier: list = []
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            ids, versions, gone = [], [], []
            for i, v, lines, words in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "version", "lines", "words")), strict=True):
                if words is None:
                    earlier = lines
                else:
                    ids.append(i)
                    versions.append(v)
                    gone.append(removed(earlier, lines, words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "version", "gone"])


def version(text: Column) -> Column:
    """Tells texts of one id apart; null stays null."""
    return F.xxhash64(text)


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, version and gone (positions of lines) of every document that loses lines."""
    lines = F.split("text", "\n")
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    known = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = known.select("doc_id", version(F.col("text")).alias("version"), F.transform(trimmed, lambda x: F.unhex(F.md5(x))).alias("lines"), F.transform(trimmed, lambda x: word_count(x).cast("int")).alias("words"))
    held = written(held.dropDuplicates(["doc_id", "version"]), "lines")
    doc = F.struct("doc_id", "version").alias("doc")
    places = written(held.select("doc_id", "version", "lines", "words").mapInArrow(_runs, "doc_id long, version long, run binary"), "runs").select("run", doc)
    holders = places.groupBy("run").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1")
    pairs = places.join(holders, "run").where("doc <> first").select(F.col("first").alias("a"), F.col("doc.doc_id").alias("doc_id"), F.col("doc.version").alias("version")).distinct()
    pairs = written(pairs, "line-pairs")
    tiles = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    later = pairs.join(tiles, "a").withColumn("tile", F.pmod(F.xxhash64("doc_id", "version"), F.col("tiles")).cast("int")).drop("tiles")
    later = later.join(held, ["doc_id", "version"]).select("a", "tile", "doc_id", "version", "lines", "words")
    none = F.lit(None)
    first = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).join(held.select(doc.alias("a"), "lines"), "a")
    first = first.select("a", "tile", none.cast("long").alias("doc_id"), none.cast("long").alias("version"), "lines", none.cast("array<int>").alias("words"))
    dealt = first.union(later).repartition("a", "tile").sortWithinPartitions("a", "tile", F.col("doc_id").asc_nulls_first())
    found = dealt.select("doc_id", "version", "lines", "words").mapInArrow(_aligned, "doc_id long, version long, gone array<int>")
    return found.where(F.size("gone") > 0).groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with their text less the lines that an earlier document has, and __lines and __removed (numbers of lines; columns of these names are replaced).

    A document is later if its doc_id is larger, or equal with another text. Lines are equal if they
    are so without the blanks around them. Rows that repeat an id and its text are one document:
    none loses to another. A null id or text loses nothing; a null or empty text has 0 lines. An empty
    table gives an empty table.
    """
    key_id, key_version = "__line_doc", "__line_version"
    gone = removals(documents).select(F.col("doc_id").alias(key_id), F.col("version").alias(key_version), F.col("gone").alias("__gone"))
    text = documents["text"].cast("string")
    joined = documents.join(gone, (documents["doc_id"].cast("long") == gone[key_id]) & (version(text) == gone[key_version]), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    counted = joined.withColumn("__lines", F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(lines)).otherwise(0)).withColumn("__removed", F.coalesce(F.size("__gone"), F.lit(0)))
    return counted.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)).drop(key_id, key_version, "__gone")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), word_count(F.col("text")).alias("n_words_left"), F.sha2(F.col("text"), 256).alias("text_sha256"))
