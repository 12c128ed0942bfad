"""Database reads and writes against an embedded database (whose dialect in Spark can't write null strings)."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tapestream.sources import jdbc, tables

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "log"))
    found = jdbc.Database(f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", {"driver": DRIVER})
    found.execute(
        spark,
        "CREATE TABLE daily_update (author VARCHAR(40), object VARCHAR(40), data_ts TIMESTAMP, status INT, updated TIMESTAMP, PRIMARY KEY (author, object, data_ts))",
        "CREATE TABLE daily_update_msg (id INT GENERATED ALWAYS AS IDENTITY, message_key VARCHAR(60) UNIQUE, author VARCHAR(40), level VARCHAR(10), title VARCHAR(80), msg VARCHAR(400), alerted INT)",
        "CREATE TABLE trade_positions (acname VARCHAR(40), stockdate DATE, symbol VARCHAR(20), position DOUBLE, inserted TIMESTAMP, PRIMARY KEY (acname, stockdate, symbol))",
        "CREATE TABLE numbers (id INT, held DATE, name VARCHAR(20))",
        "CREATE TABLE nothing (id INT, name VARCHAR(20))",
        "CREATE TABLE pairs (k INT PRIMARY KEY, v INT)",
    )
    spark.range(500).select(F.col("id").cast("int").alias("id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias("held"), F.concat(F.lit("n"), "id").alias("name")).write.jdbc(found.url, "numbers", mode="append", properties=found.properties)
    return found


def staged(db, spark):
    return db.scan(spark, "SELECT tablename FROM sys.systables WHERE tablename LIKE '%STAGED%'").count()


def test_scans_in_ranges_and_predicates(spark, db):
    query = "SELECT id, held, name FROM numbers"
    whole = sorted(db.scan(spark, query).collect())
    assert len(whole) == 500
    for found, parts in ((db.scan(spark, query, "id", 5), 5), (db.scan(spark, query, "held", 4), 4), (db.scan(spark, query, "id", 3, (100, 200)), 3), (db.scan_predicates(spark, query, ["id < 100", "id >= 100 AND id < 450", "id >= 450"]), 3)):
        assert sorted(found.collect()) == whole and found.rdd.getNumPartitions() == parts
    sizes = [len(p) for p in db.scan(spark, query, "id", 5).rdd.glom().collect()]
    assert max(sizes) <= 110, "ranges share the rows out"
    plan = db.scan(spark, query, "id", 5).where("id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(ID,7)" in plan.replace("*", "")


def test_empty_table_in_ranges(spark, db):
    assert db.scan(spark, "SELECT * FROM nothing", "id", 4).collect() == []


def test_fallback(spark, db):
    queries = ["SELECT id, name FROM nothing", "SELECT id, name FROM numbers WHERE id < 3", "SELECT id, name FROM numbers"]
    assert db.first_with_rows(spark, queries).count() == 3
    assert db.first_with_rows(spark, queries[:1]).count() == 0
    with pytest.raises(ValueError):
        db.first_with_rows(spark, [])


def test_status(spark, db):
    t0, t1 = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2)
    schema = "author string, object string, data_ts timestamp, status int, timestamp timestamp"
    rows = spark.createDataFrame([("me", "f", t0, 0, t0), ("me", "f", t0, 1, t1), ("me", "g", t1, 1, t1), ("you", "f", t1, 0, t1)], schema)
    assert jdbc.write_status(db, rows) == (0, 3)
    assert jdbc.write_status(db, rows) == (3, 3), "a repeated write changes nothing"
    assert [tuple(r) for r in jdbc.read_status(db, spark, "me", "f", t0).collect()] == [(t0, 1)]
    assert jdbc.read_status(db, spark, "me", "f", t1).collect() == []
    jdbc.write_status(db, spark.createDataFrame([("me", "f", t0, 2)], "author string, object string, data_ts timestamp, status int"), batch="b1")
    assert jdbc.read_status(db, spark, "me", "f", t0).first().status == 2
    assert db.scan(spark, "SELECT * FROM daily_update").count() == 3 and staged(db, spark) == 0
    assert tables.is_ready(db.scan(spark, "SELECT data_ts, status FROM daily_update"), t1.date()).first().ready


def test_messages(spark, db):
    schema = "message_key string, author string, level string, title string, msg string"
    first = spark.createDataFrame([("a1", "me", "P", "late", "x"), ("a2", "me", "N", "fine", "-")], schema)
    assert jdbc.send_messages(db, first) == 2
    assert jdbc.send_messages(db, first.union(spark.createDataFrame([("a3", "me", "P", "later", "y")], schema))) == 1
    found = jdbc.open_messages(db, spark, ["P"])
    assert sorted(r.title for r in found.collect()) == ["late", "later"]
    assert [r.title for r in jdbc.open_messages(db, spark, ["P"], among=False).collect()] == ["fine"]
    late = spark.createDataFrame([(r.id,) for r in found.where("title = 'late'").collect()] * 2, "id int")
    for _ in range(2):
        assert jdbc.mark_alerted(db, late) == 1
    assert [r.title for r in jdbc.open_messages(db, spark, ["P"]).collect()] == ["later"]


def test_positions(spark, db):
    wide = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, None), (dt.date(2024, 1, 3), 2.0, -3.0)], "stockdate date, a double, b double")
    assert jdbc.write_positions(db, tables.positions(wide, "acc")) == (0, 4)
    assert jdbc.write_positions(db, tables.positions(wide.withColumn("a", F.lit(9.0)), "acc")) == (4, 4)
    rows = {(str(r.stockdate), r.symbol): r.position for r in db.scan(spark, "SELECT stockdate, symbol, position FROM trade_positions").collect()}
    assert rows == {("2024-01-02", "a"): 9, ("2024-01-03", "a"): 9, ("2024-01-02", "b"): None, ("2024-01-03", "b"): -3}


def test_repeated_tasks_change_nothing(spark, db, monkeypatch):
    """A staging table that got every row twice gives the same target as one that got them once."""
    rows = spark.createDataFrame([(k, k * 10) for k in range(50)], "k int, v int").repartition(4)
    db.upsert(rows, "pairs", ["k"])
    again = rows.withColumn("v", F.col("v") + 1)
    real = jdbc.Database.execute

    def twice(self, session, *statements):
        if statements[0].startswith("DELETE"):
            staging = statements[1].rsplit(" ", 1)[1]
            real(self, session, f"INSERT INTO {staging} SELECT * FROM {staging}")
        return real(self, session, *statements)

    monkeypatch.setattr(jdbc.Database, "execute", twice)
    assert db.upsert(again, "pairs", ["k"]) == (50, 50)
    assert sorted(tuple(r) for r in db.scan(spark, "SELECT k, v FROM pairs").collect()) == [(k, k * 10 + 1) for k in range(50)]


def test_staged_keys_are_looked_up_by_an_index(spark, db, monkeypatch):
    """Else marking or replacing n rows may compare n * n keys."""
    real, seen = jdbc.Database.execute, []

    def looked(self, session, *statements):
        if statements[0].startswith(("UPDATE", "DELETE")):
            found = db.scan(session, "SELECT t.tablename AS name FROM sys.sysconglomerates c JOIN sys.systables t ON c.tableid = t.tableid WHERE c.isindex")
            seen.append(found.where("name LIKE '%STAGED%'").count())
        return real(self, session, *statements)

    db.execute(spark, "CREATE TABLE many (id INT, alerted INT)")
    rows = spark.range(20_000).selectExpr("cast(id as int) AS id", "0 AS alerted")
    db.add(rows, "many", ["id"])
    monkeypatch.setattr(jdbc.Database, "execute", looked)
    assert db.mark(rows.where("id % 2 = 0").select("id"), "many", "alerted", 1) == 10_000
    assert db.upsert(rows.withColumn("alerted", 1 - F.col("id") % 2), "many", ["id"]) == (20_000, 20_000)
    assert seen == [1, 1] and staged(db, spark) == 0
    assert db.scan(spark, "SELECT id, alerted FROM many").where("alerted = 1 - id % 2").count() == 20_000


def test_a_failed_write_leaves_the_table(spark, db):
    before = sorted(db.scan(spark, "SELECT k, v FROM pairs").collect())
    failing = spark.range(10).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") < 9, F.lit(-1)).otherwise(F.raise_error("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        db.upsert(failing, "pairs", ["k"])
    assert sorted(db.scan(spark, "SELECT k, v FROM pairs").collect()) == before and staged(db, spark) == 0
    with pytest.raises(Exception):
        db.execute(spark, "DELETE FROM pairs", "DELETE FROM not_there")
    assert sorted(db.scan(spark, "SELECT k, v FROM pairs").collect()) == before


def test_keys_and_names_are_checked(spark, db):
    rows = spark.createDataFrame([(None, 1)], "k int, v int")
    for bad in (lambda: db.upsert(rows, "pairs", ["k"]), lambda: db.upsert(rows, "pairs; drop", ["k"]), lambda: db.upsert(rows, "pairs", [])):
        with pytest.raises(ValueError):
            bad()


def test_stream(spark, db, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(100, k, k), (101 + k, k, k)], "k int, v int, n int").write.mode("append").parquet(source)
    stream = spark.readStream.schema("k int, v int, n int").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        jdbc.keep_upserted(db, stream.selectExpr("k", "v"), "pairs", ["k"], "v", str(tmp_path / "state")).awaitTermination()
    assert {r.k: r.v for r in db.scan(spark, "SELECT k, v FROM pairs WHERE k >= 100").collect()}.keys() == {100, 101, 102, 103}
