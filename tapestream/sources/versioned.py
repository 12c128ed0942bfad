"""A table of (series, ts, ...) that grows by increments: versions in a manifest, merged on read, compacted in levels.

Each commit writes its rows once, in order of time, and then a new manifest, which names the folders of
rows with their range of times. A reader takes the newest manifest and only the folders that overlap what
it asks for; where folders overlap each other, the newest row of each (series, ts) wins. When a level has
``FANOUT`` folders, they become one of the next level, so a table of n commits has some FANOUT * log(n)
folders. A manifest is never written twice: of two writers, one fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["series", "ts"]
#: Folders of a level before they become one; manifests kept for readers that began before; rows of a file.
FANOUT, KEPT, FILE_ROWS = 8, 5, 2_000_000


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this commit counts."""


@dataclass(frozen=True)
class Part:
    """A folder of rows: the version they are of, its level, rows, and the first and last microsecond."""

    folder: str
    version: int
    level: int
    rows: int
    first: int
    last: int

    def overlaps(self, first: int, last: int) -> bool:
        return self.first <= last and first <= self.last


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batch: int = -1
    parts: tuple[Part, ...] = ()
    extra: dict = field(default_factory=dict)


def _micros(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


class FactorTable:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    # Small files; they go through Hadoop's file systems, as the rows do.

    def _at(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, store = self._at(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and n[:1].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one for a new table."""
        known = self._versions()
        if version is None and not known:
            return Manifest()
        place, store = self._at("manifest", f"{known[-1] if version is None else version:012d}.json")
        stream = store.open(place)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(found["version"], found["batch"], tuple(Part(**p) for p in found["parts"]), found["extra"])

    def _publish(self, new: Manifest) -> None:
        place, store = self._at("manifest", f"{new.version:012d}.json")
        draft, _ = self._at("manifest", f"_{uuid.uuid4().hex}")
        stream = store.create(draft, True)
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        if store.exists(place) or not store.rename(draft, place):
            store.delete(draft, False)
            raise Conflict(f"version {new.version} of {self.path} is there already")

    # Rows.

    def _written(self, rows: DataFrame, version: int, level: int) -> Part:
        """Writes rows in order of time into a folder of their own; it may have none."""
        folder = f"data/{version:012d}-{level}-{uuid.uuid4().hex[:8]}"
        rows.sortWithinPartitions("ts", "series").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/{folder}")
        n, first, last = self._rows([folder]).agg(F.count("*"), F.min(_micros()), F.max(_micros())).first()  # reads the times of what was just written
        return Part(folder, version, level, n, first or 0, last or 0)

    def _read(self, parts: list[Part]) -> DataFrame:
        """Rows of some parts: those whose times no other part has are read as they are, the others merged."""
        groups: list[list[Part]] = []
        end = None
        for p in sorted(parts, key=lambda p: p.first):
            if end is None or p.first > end:
                groups.append([])
                end = p.last
            groups[-1].append(p)
            end = max(end, p.last)
        alone = [g[0] for g in groups if len(g) == 1]
        found = self._rows([p.folder for p in alone]) if alone else None
        for group in (g for g in groups if len(g) > 1):
            together = None
            for p in group:
                rows = self._rows([p.folder]).withColumn("__version", F.lit(p.version))
                together = rows if together is None else together.unionByName(rows, allowMissingColumns=True)
            values = [c for c in together.columns if c not in (*KEYS, "__version")]
            newest = together.groupBy(*KEYS).agg(F.max_by(F.struct(*values), "__version").alias("__new")).select(*KEYS, "__new.*")
            found = newest if found is None else found.unionByName(newest, allowMissingColumns=True)
        return found

    def _rows(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{f}" for f in folders))
        return rows.where("coalesce(__own, true)").drop("__own", "__state") if "__own" in rows.columns else rows  # merged folders have it no more

    def read(self, since=None, until=None, version: int | None = None) -> DataFrame:
        """Rows from ``since`` on and before ``until``, of the newest version or of one that is still kept; only folders that overlap are opened."""
        first, last = self._bound(since, -(2**63)), self._bound(until, 2**63 - 1)
        parts = [p for p in self.manifest(version).parts if p.overlaps(first, last)]
        if not parts:
            raise LookupError(f"{self.path} has no rows there")
        rows = self._read(parts)
        kind = rows.schema["ts"].dataType
        rows = rows if since is None else rows.where(F.col("ts") >= F.lit(since).cast(kind))
        return rows if until is None else rows.where(F.col("ts") < F.lit(until).cast(kind))

    def _bound(self, time, otherwise: int) -> int:
        if time is None:
            return otherwise
        return self.spark.range(1).select(F.unix_micros(F.lit(time).cast("timestamp_ntz").cast("timestamp"))).first()[0]

    def has_rows(self) -> bool:
        return bool(self.manifest().parts)

    # Commits.

    def commit(self, rows: DataFrame, batch: int | None = None) -> Manifest:
        """Upserts rows (one per series and ts). A batch whose number isn't above the last one's was committed before, and nothing happens.

        Rows with the columns ``__own`` and ``__state`` (``stateful.continued``) are the table's where they are its
        own; their states become the table's with the same manifest.
        """
        held = self.manifest()
        if batch is not None and batch <= held.batch:
            return held
        part = self._written(rows, held.version + 1, 0)
        state = {"state_folder": part.folder} if "__state" in rows.columns else {}
        new = replace(held, version=held.version + 1, batch=held.batch if batch is None else batch, parts=held.parts + ((part,) if part.rows else ()), extra=held.extra | state)
        self._publish(new)
        return self._settled(new)

    def states(self) -> DataFrame | None:
        """series, last and state of the newest commit that had states."""
        folder = self.manifest().extra.get("state_folder")
        return self.spark.read.parquet(f"{self.path}/{folder}").where("__state is not null").select("series", "__state.*") if folder else None

    def _settled(self, held: Manifest) -> Manifest:
        """Compacts levels that are full, the lowest first, and deletes what no kept manifest names."""
        level = 0
        while any(p.level >= level for p in held.parts):
            full = [p for p in held.parts if p.level == level]
            if len(full) >= self.fanout:
                rows = sum(p.rows for p in full)
                merged = self._read(full)
                n = max(1, -(-rows // FILE_ROWS))
                one = replace(self._written(merged.repartitionByRange(n, "ts"), held.version + 1, level + 1), version=max(p.version for p in full))
                held = replace(held, version=held.version + 1, parts=(*(p for p in held.parts if p.level != level), one))
                self._publish(held)
            level += 1
        self._vacuum()
        return held

    def _vacuum(self) -> None:
        known = self._versions()
        kept = [self.manifest(v) for v in known[-KEPT:]]
        named = {p.folder for m in kept for p in m.parts} | {m.extra.get("state_folder") for m in kept}
        newest = f"{kept[-1].version:012d}" if kept else ""
        for name in self._names("data"):
            if f"data/{name}" not in named and name[:12] < newest:  # folders of a version to come belong to a writer that hasn't published yet
                place, store = self._at("data", name)
                store.delete(place, True)
        for v in known[:-KEPT]:
            place, store = self._at("manifest", f"{v:012d}.json")
            store.delete(place, False)
