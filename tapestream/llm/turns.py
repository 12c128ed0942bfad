"""Damage to conversations, its audit, and their cheapest repair to alternating turns.

A repair keeps, reroles or deletes each turn and may insert turns. It is a path through a lattice of
(turn, state of the role grammar) with small integer costs. Auction steps find it: a path grows from
its origin along the arc that its last node prices best, or gives up that node after raising its
price. Once the path arrives, the prices are a dual solution, every arc of every cheapest path is tight
in them, and following the tight arcs by the least letter gives the least of the cheapest edits.

Turns are cut into blocks of bounded length, whose lattices are solved apart from each other, so one conversation
may spread over the whole cluster: first for the costs between a block's states, then, once these are
carried back through the conversation, for the tight arcs. Only blocks' costs, and at the very end the
repaired turns for their hash, pass through one task per conversation, as streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .runtime import shuffle_files_freed, written

#: Rows of a block; an auction's work may grow with the square of its rows.
BLOCK = 64
#: Blanks of the contract's character class.
BLANK = " \t\n\x0b\x0c\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = 4
#: Where a turn of each initial leads from each state, and the turn that rerole and insert give there.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
MADE, ROLES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Edits behind the last turn by state, and their costs.
ENDING = ("", "II", "I", "")
END_COSTS = tuple(INSERT * len(e) for e in ENDING)
NEVER = 1 << 60
LEGAL = ("su", "ua", "au")


@lru_cache(maxsize=100_000)
def auction(symbols: str, exits: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """Costs from each state before a block to its end, the least of the cheapest edits, and the state each ends in.

    ``symbols`` has a letter per row: its role's initial s, u, a or o (another), a capital if the row is truncated,
    b or d if it must go. ``exits`` prices the states behind the block, NEVER for none. A state that no
    exit is reached from costs NEVER.
    """
    n = len(symbols)
    goal = STATES * (n + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(goal)]
    for q in range(STATES):
        if exits[q] < NEVER:
            arcs[STATES * n + q].append(("", exits[q], goal))
    open_ = [bool(arcs[STATES * n + q]) if i == n else False for i in range(n + 1) for q in range(STATES)]
    for i in reversed(range(n)):
        here, after, symbol = STATES * i, STATES * (i + 1), symbols[i]
        extra = TRUNCATED if symbol.isupper() else 0
        for q in range(STATES):
            to = [("D", DELETE, after + q), ("I", INSERT, here + MADE[q])]
            if symbol not in "bd":
                kept = KEPT.get(symbol.lower(), (None,) * STATES)[q]
                to += [("K", KEEP + extra, after + kept)] if kept is not None else []
                to += [("R", REROLE + extra, after + MADE[q])]
            arcs[here + q] = to
            open_[here + q] = any(open_[j] for _, _, j in to if j >= after)
        for _ in range(2):  # what only inserts reach an exit from
            for q in range(STATES):
                open_[here + q] = open_[here + q] or open_[here + MADE[q]]
    for node in range(goal):
        arcs[node] = [arc for arc in arcs[node] if arc[2] == goal or open_[arc[2]]]
    prices = [0] * (goal + 1)
    for origin in range(STATES):
        if not open_[origin]:
            continue
        path = [origin]
        while path[-1] != goal:
            last = path[-1]
            best, to = min((cost + prices[j], j) for _, cost, j in arcs[last])
            if prices[last] < best:
                prices[last] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    tight = [[(letter, j) for letter, cost, j in arcs[node] if prices[node] == cost + prices[j]] if open_[node] else [] for node in range(goal)]
    leads = [False] * goal + [True]
    for i in reversed(range(n + 1)):
        for _ in range(3):  # inserts stay within a row and don't circle: their arcs cost something
            for node in range(STATES * i, STATES * (i + 1)):
                leads[node] = leads[node] or any(leads[j] for _, j in tight[node])
    costs, edits, ends = [], [], []
    for origin in range(STATES):
        letters, node = [], origin
        while open_[origin] and node < STATES * n:
            letter, node = min((letter, j) for letter, j in tight[node] if leads[j])
            letters.append(letter)
        costs.append(prices[origin] if open_[origin] else NEVER)
        edits.append("".join(letters))
        ends.append(node - STATES * n if open_[origin] else 0)
    return tuple(costs), tuple(edits), tuple(ends)


def crossing(symbols: str) -> list[int]:
    """Costs from each state before a block to each behind it, row by row."""
    alone = [auction(symbols, tuple(0 if q == x else NEVER for q in range(STATES)))[0] for x in range(STATES)]
    return [alone[x][e] for e in range(STATES) for x in range(STATES)]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, as conv_id, turn, role, text and dropped; rows that are dropped stay, marked.

    crc32 of ``conv_id:turn`` modulo 20 says what happens: 0 drops a row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes its role user. A null is one space in the key, as role and as text.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _digest() -> Column:
    """128 bits that name conversation, role and text."""
    named = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.length("role").cast("string"), "role", "text")
    return F.unhex(F.md5(named.cast("binary")))


def ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows with ``pos``, which orders those of a conversation by turn (nulls first), role and text, and ``block``.

    Ranges of conversation, turn, role and the text's beginning are dealt to tasks, so neither a long
    conversation nor many rows of one turn meet in one; whole texts are compared within a task.
    """
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    placed = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("pos", F.monotonically_increasing_id())
    return placed.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def blocks(rows: DataFrame) -> DataFrame:
    """conv_id, block and symbols (``auction``) of the rows that ``ordered`` gave; dropped rows have no symbol.

    A row's first fault counts: blank, else duplicate (its role and text stand before it), else truncated.
    """
    ending = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    shown = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    mark = F.when(F.col("dropped"), "").when(ending == "", "b").when(F.right(ending, F.lit(1)).isin(".", "!", "?"), shown).otherwise(F.upper(shown))
    marked = rows.select("conv_id", "block", "pos", mark.alias("mark"), F.when(~F.col("dropped") & (ending != ""), _digest()).alias("digest"))
    first = marked.where("digest is not null").groupBy("digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    keyed = marked.withColumn("digest", F.coalesce("digest", F.unhex(F.hex("pos"))))  # 8 bytes, which no digest has: rows without one don't meet in a task
    seen = keyed.join(first, "digest", "left").withColumn("mark", F.when(F.col("pos") > F.col("first"), "d").otherwise(F.col("mark")))
    listed = F.array_sort(F.collect_list(F.struct("pos", "mark")))  # a block's rows at most
    return seen.groupBy("conv_id", "block").agg(F.array_join(F.transform(listed, lambda r: r["mark"]), "").alias("symbols"))


def _with_crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("costs", pa.array([crossing(s) for s in batch.column("symbols").to_pylist()], pa.list_(pa.int64())))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices behind each block; a conversation's blocks come from its last to its first."""
    of, prices = object(), END_COSTS
    for batch in batches:
        exits = []
        for conv, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            if conv != of:
                of, prices = conv, END_COSTS
            least = min(prices)
            exits.append([p - least for p in prices])
            prices = tuple(min(costs[STATES * e + x] + prices[x] for x in range(STATES)) for e in range(STATES))
        kept = [batch.column(n) for n in ("conv_id", "block", "symbols")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(exits, pa.list_(pa.int64()))], ["conv_id", "block", "symbols", "exits"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [auction(s, tuple(e)) for s, e in zip(batch.column("symbols").to_pylist(), batch.column("exits").to_pylist(), strict=True)]
        kept = [batch.column(n) for n in ("conv_id", "block", "symbols")]
        edits, ends = pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept, edits, ends], ["conv_id", "block", "symbols", "edits", "ends"])


def edits(of: DataFrame) -> DataFrame:
    """conv_id, block, symbols, and for each state before the block its edits and the state behind it, cheapest for the whole conversation."""
    keys = [of.schema["conv_id"], StructField("block", LongType()), StructField("symbols", StringType())]
    costs = of.mapInArrow(_with_crossing, StructType([*keys, StructField("costs", ArrayType(LongType()))]))
    backwards = costs.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc(), F.col("block").desc())
    priced = backwards.mapInArrow(_carried, StructType([*keys, StructField("exits", ArrayType(LongType()))]))
    return priced.repartition("conv_id", "block").mapInArrow(_traced, StructType([*keys, StructField("edits", ArrayType(StringType())), StructField("ends", ArrayType(IntegerType()))]))


class Repair:
    """One conversation as its blocks and rows come by; holds its edits, but none of its texts."""

    COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.hash, self.written = conv, 0, [], hashlib.sha256(), False
        self.counts = dict.fromkeys(self.COUNTS, 0)
        self.letters, self.at, self.least, self.most, self.turns, self.initial = "", 0, None, None, 0, None

    def block(self, symbols: str, edits: list[str], ends: list[int]) -> None:
        self.letters, self.at = edits[self.state], 0
        self.audit.append(self.letters)
        self.state, self.before = ends[self.state], self.state
        marks = {m: symbols.count(m) for m in set(symbols)}
        self.counts["blank"] += marks.get("b", 0)
        self.counts["duplicate"] += marks.get("d", 0)
        self.counts["truncated"] += sum(n for m, n in marks.items() if m.isupper())
        rows = self.letters.replace("I", "")
        self.counts["cost"] += INSERT * self.letters.count("I") + DELETE * rows.count("D") + REROLE * rows.count("R")
        self.counts["cost"] += TRUNCATED * sum(s.isupper() and e != "D" for s, e in zip(symbols, rows, strict=True))

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written = True

    def insert(self) -> None:
        self.put(ROLES[self.before], "")
        self.before = MADE[self.before]

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = role[:1]
        while self.letters[self.at] == "I":
            self.insert()
            self.at += 1
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "K":
            self.put(role, text)
            self.before = KEPT[role[:1]][self.before]
        elif letter == "R":
            self.put(ROLES[self.before], text)
            self.before = MADE[self.before]

    def end(self) -> dict:
        rest = ENDING[self.state]
        self.before = self.state
        for _ in rest:
            self.insert()
        if self.turns:
            self.counts["gaps"] = self.most - self.least + 1 - self.turns
        return {"conv_id": self.conv, **self.counts, "cost": self.counts["cost"] + INSERT * len(rest), "audit": "".join([*self.audit, rest]), "repaired_sha256": self.hash.hexdigest()}


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of rows and blocks in order; each block stands before its rows."""
    one = None
    for batch in batches:
        done, kind = [], batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if one is None or r["conv_id"] != one.conv:
                done += [one.end()] if one else []
                one = Repair(r["conv_id"])
            if r["symbols"] is not None:
                one.block(r["symbols"], r["edits"], r["ends"])
            elif not r["dropped"]:
                one.row(r["turn"], r["role"], r["text"])
        yield _finished(done, kind)
    if one:
        yield _finished([one.end()], kind)


def _finished(done: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv_id": kind, **dict.fromkeys(Repair.COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in kinds.items()], list(kinds))


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored. It is damaged first (``damaged``).
    Rows of one turn are ordered by role and text, so a repeat is next to its row; a null conv_id is a
    conversation. A role with another or no initial can't be kept. gaps ignores null turns. A conversation that lost all rows has zeros, an empty audit and the empty
    string's hash. An empty table gives an empty one. The hash of a conversation is one stream by its nature: a task holds its
    audit, the others' memory is bounded whatever a conversation's length.
    """
    with shuffle_files_freed(conversations.sparkSession):
        rows = written(ordered(damaged(conversations)), "turns", "zstd")
    decided = edits(blocks(rows)).withColumn("pos", F.lit(-1).cast("long"))
    stream = rows.unionByName(decided, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    counts = [StructField(n, LongType()) for n in Repair.COUNTS]
    return stream.mapInArrow(_repaired, StructType([conversations.schema["conv_id"], *counts, StructField("audit", StringType()), StructField("repaired_sha256", StringType())]))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    """The repair by recursion over rows from the last to the first: for each state the least (cost, edits, repaired text)."""

    def put(next_: str, cost: str, letter: str, text: str = "''") -> str:
        """An edit before what follows."""
        return f"{{'c': ({next_}).c + {cost}, 'a': '{letter}' || ({next_}).a, 'r': {text} || ({next_}).r}}"

    def insert(next_: str, role: str) -> str:
        return put(next_, "2", "I", f"chr(10) || '{role}:'")

    kept = {"n": "CASE i0 WHEN 's' THEN p.s WHEN 'u' THEN p.u END", "s": "CASE WHEN i0 = 'u' THEN p.u END", "u": "CASE WHEN i0 = 'a' THEN p.a END", "a": "CASE WHEN i0 = 'u' THEN p.u END"}
    made = {"n": ("p.u", "user"), "s": ("p.u", "user"), "u": ("p.a", "assistant"), "a": ("p.u", "user")}
    base = ", ".join(
        f"""least({put(f"p.{q}", "3", "D")}, CASE WHEN fault NOT IN ('b', 'd') AND ({kept[q]}) IS NOT NULL THEN {put(kept[q], "extra", "K", "chr(10) || role || ':' || text")} END,
      CASE WHEN fault NOT IN ('b', 'd') THEN {put(made[q][0], "(2 + extra)", "R", f"chr(10) || '{made[q][1]}:' || text")} END) AS {q}"""
        for q in kept
    )
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
             lambda h, b: list_reduce(list_concat([xor(h, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending, left(role, 1) AS i0 FROM damaged
), faults AS (
  SELECT *, CASE WHEN ending = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(ending, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
         lag(i0) OVER (PARTITION BY conv_id ORDER BY i) || i0 NOT IN ('su', 'ua', 'au') AS illegal FROM numbered
), turns AS (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS extra FROM faults
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id
), paths AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS n, {{'c': 4::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
         {{'c': 2::BIGINT, 'a': 'I', 'r': chr(10) || 'assistant:'}} AS u, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS a FROM sums
  UNION ALL
  SELECT conv_id, i, least(n, {insert('u2', 'user')}), least(s, {insert('u2', 'user')}), u2, least(a, {insert('u', 'user')})
  FROM (SELECT *, least(u, {insert('a', 'assistant')}) AS u2 FROM (
    SELECT t.conv_id, t.i, {base} FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i - 1))
), best AS (SELECT conv_id, n AS best FROM paths WHERE i = 1
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substring(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP13_SQL = _sql()
