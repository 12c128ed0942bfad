"""Databases: partitioned reads, and writes that may be repeated.

Reads are Spark's JDBC scans, cut into partitions by ranges of a number, date or time, or by predicates.
Writes go through a staging table: tasks append to it in parallel, and one transaction replaces the
target's rows of the same keys by the distinct staged ones. A task or a whole job that is repeated stages
rows twice and changes nothing; one that fails leaves the target as it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.align import latest_per_key

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?\Z")


def _plain(*names: str) -> None:
    """Names of tables and columns go into statements as they are."""
    for name in names:
        if not _NAME.match(name):
            raise ValueError(f"not a plain name: {name!r}")


def _lower(rows: DataFrame) -> DataFrame:
    return rows.toDF(*map(str.lower, rows.columns))


@dataclass(frozen=True)
class Database:
    """A JDBC address and its properties (user, password, driver); ``staging_ddl`` makes an empty table like a target, ``index_ddl`` its index."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    staging_ddl: str = "CREATE TABLE {staging} AS SELECT {columns} FROM {table} WITH NO DATA"
    index_ddl: str = "CREATE INDEX {staging}_k ON {staging} ({columns})"

    def options(self) -> dict[str, str]:
        return {"url": self.url, **self.properties}

    # Reading.

    def scan(self, spark: SparkSession, query: str, column: str | None = None, partitions: int = 1, bounds: tuple | None = None, fetch: int = 10_000) -> DataFrame:
        """A query's rows. With ``column``, in ``partitions`` ranges of it between ``bounds``; unless given, the database is asked for its least and greatest value.

        Bounds only deal the rows: those outside and nulls come with the first or the last range. Column names
        come in lower case, whatever the database does to them.
        """
        reader = spark.read.format("jdbc").options(**self.options()).option("fetchsize", fetch)
        if column is None:
            return _lower(reader.option("query", query).load())
        if bounds is None:
            ends = spark.read.format("jdbc").options(**self.options()).option("query", f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM ({query}) ends_").load().first()
            bounds = (ends[0], ends[1])
        if bounds[0] is None:  # no values, and so nothing to deal
            return _lower(reader.option("query", query).load())
        return _lower(reader.option("dbtable", f"({query}) ranged_").options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)).load())

    def scan_predicates(self, spark: SparkSession, query: str, predicates: list[str], fetch: int = 10_000) -> DataFrame:
        """One partition per predicate; they must not overlap and must cover what is wanted."""
        return _lower(spark.read.jdbc(self.url, f"({query}) parts_", predicates=predicates, properties={**self.properties, "fetchsize": str(fetch)}))

    def first_with_rows(self, spark: SparkSession, queries: Iterable[str], **scan) -> DataFrame:
        """The first of several queries that has a row (else the last); asking costs one row of each."""
        last = None
        for query in queries:
            last = self.scan(spark, query, **scan)
            if not last.isEmpty():
                return last
        if last is None:
            raise ValueError("no query")
        return last

    # Writing.

    def _connection(self, spark: SparkSession):
        """One connection of the driver; the table's rows don't go through it."""
        jvm = spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for name, value in self.properties.items():
            given.setProperty(name, value)
        if "driver" in self.properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.properties["driver"])
        return jvm.java.sql.DriverManager.getConnection(self.url, given)

    def execute(self, spark: SparkSession, *statements: str) -> list[int]:
        """Statements in one transaction; how many rows each changed. An error takes all of them back."""
        connection = self._connection(spark)
        try:
            connection.setAutoCommit(False)
            changed = []
            for text in statements:
                statement = connection.createStatement()
                changed.append(statement.executeUpdate(text))
                statement.close()
            connection.commit()
            return changed
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _staged(self, rows: DataFrame, table: str, batch: str | None, then: Callable[[str], list[str]], looked_up: list[str] | None = None) -> list[int]:
        """Stages rows and runs what ``then`` makes of the staging table's name in one transaction. Staged rows that it looks up by ``looked_up`` get an index."""
        _plain(table, *rows.columns)
        spark = rows.sparkSession
        staging = f"{table}_staged_{batch or uuid.uuid4().hex[:12]}"
        _plain(staging)
        self._drop(spark, staging)  # what an attempt of the same batch left
        self.execute(spark, self.staging_ddl.format(staging=staging, columns=", ".join(rows.columns), table=table))
        try:
            rows.write.jdbc(self.url, staging, mode="append", properties={**self.properties, "batchsize": "5000"})
            if looked_up:  # else each row of the target scans all staged ones
                self.execute(spark, self.index_ddl.format(staging=staging, columns=", ".join(looked_up)))
            return self.execute(spark, *then(staging))
        finally:
            self._drop(spark, staging)

    def _drop(self, spark: SparkSession, table: str) -> None:
        from py4j.protocol import Py4JJavaError

        try:
            self.execute(spark, f"DROP TABLE {table}")
        except Py4JJavaError as error:
            if "SQLException" not in error.java_exception.getClass().getName() and "SQL" not in error.java_exception.getClass().getSimpleName():
                raise

    def upsert(self, rows: DataFrame, table: str, keys: list[str], newest: str | None = None, batch: str | None = None) -> tuple[int, int]:
        """Replaces or adds rows by their keys (not null); how many rows were replaced, and how many are there now for the keys.

        Keys that repeat need ``newest``, the column whose greatest value wins. Columns of ``table`` that ``rows`` lack get their
        defaults. ``batch`` names the staging table, so a repeated batch cleans up after the one before.
        """
        if not keys:
            raise ValueError("an upsert needs keys")
        _plain(*keys)
        one = latest_per_key(rows, keys, newest) if newest else rows.dropDuplicates()
        columns = ", ".join(rows.columns)
        nowhere = " OR ".join(f"{k} IS NULL" for k in keys)
        same = " AND ".join(f"s.{k} = {table}.{k}" for k in keys)
        if not one.where(nowhere).isEmpty():
            raise ValueError(f"a key among {keys} is null")
        changed = self._staged(one, table, batch, lambda s: [f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {s} s WHERE {same})", f"INSERT INTO {table} ({columns}) SELECT DISTINCT {columns} FROM {s}"], keys)
        return changed[0], changed[1]

    def add(self, rows: DataFrame, table: str, keys: list[str], batch: str | None = None) -> int:
        """Adds the rows whose keys (not null) the table doesn't have yet; how many."""
        _plain(*keys)
        columns, same = ", ".join(rows.columns), " AND ".join(f"t.{k} = s.{k}" for k in keys)
        return self._staged(rows.dropDuplicates(keys), table, batch, lambda s: [f"INSERT INTO {table} ({columns}) SELECT DISTINCT {columns} FROM {s} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})"])[0]

    def mark(self, keys: DataFrame, table: str, column: str, value: int, batch: str | None = None) -> int:
        """Sets a column of the rows whose keys ``keys`` lists; how many."""
        _plain(column)
        same = " AND ".join(f"s.{k} = {table}.{k}" for k in keys.columns)
        return self._staged(keys.distinct(), table, batch, lambda s: [f"UPDATE {table} SET {column} = {int(value)} WHERE EXISTS (SELECT 1 FROM {s} s WHERE {same})"], keys.columns)[0]


# The tables of daily updates.

STATUS_KEYS = ["author", "object", "data_ts"]
POSITION_KEYS = ["acname", "stockdate", "symbol"]


def write_status(db: Database, rows: DataFrame, table: str = "daily_update", batch: str | None = None) -> tuple[int, int]:
    """Status rows (author, object, data_ts, status): one per key, the one of the latest ``timestamp``, which is now unless given."""
    stamped = rows if "timestamp" in rows.columns else rows.withColumn("timestamp", F.current_timestamp())
    return db.upsert(stamped.withColumnRenamed("timestamp", "updated"), table, STATUS_KEYS, "updated", batch)


def read_status(db: Database, spark: SparkSession, author: str, object_: str, since, table: str = "daily_update") -> DataFrame:
    """data_ts and status of an author's object from a time on; the filter goes to the database."""
    rows = db.scan(spark, f"SELECT author, object, data_ts, status FROM {table}")
    return rows.where((F.col("author") == author) & (F.col("object") == object_) & (F.col("data_ts") >= F.lit(since))).select("data_ts", "status")


def send_messages(db: Database, rows: DataFrame, table: str = "daily_update_msg", batch: str | None = None) -> int:
    """Messages (message_key, author, level, title, msg), not alerted yet; one that is sent again, by its key, isn't added again. The database gives ids."""
    return db.add(rows.withColumn("alerted", F.lit(0)), table, ["message_key"], batch)


def open_messages(db: Database, spark: SparkSession, levels: list[str], among: bool = True, table: str = "daily_update_msg") -> DataFrame:
    """Messages not alerted yet whose level is (or isn't) among ``levels``; filtered by the database."""
    listed = F.col("level").isin(*levels)
    return db.scan(spark, f"SELECT id, author, level, title, msg, alerted FROM {table}").where((F.col("alerted") == 0) & (listed if among else ~listed))


def mark_alerted(db: Database, ids: DataFrame, table: str = "daily_update_msg", batch: str | None = None) -> int:
    return db.mark(ids.select("id"), table, "alerted", 1, batch)


def write_positions(db: Database, rows: DataFrame, table: str = "trade_positions", batch: str | None = None) -> tuple[int, int]:
    """Positions (acname, stockdate, symbol, position), as ``tables.positions`` makes them of a wide table."""
    return db.upsert(rows.withColumn("inserted", F.current_timestamp()), table, POSITION_KEYS, batch=batch)


def keep_upserted(db: Database, stream: DataFrame, table: str, keys: list[str], newest: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream batch by batch; a batch that is repeated after a failure changes nothing."""

    def write(rows: DataFrame, number: int) -> None:
        db.upsert(rows, table, keys, newest, batch=f"b{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
