import corpus_pipeline as pipeline
from tapestream.llm import toxicity

from .data import documents, empty

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in before.select("doc_id").collect()}, name
        before = after
    assert pipeline.run(spark, SF).count() == before.count()
    assert all(r.round_trip for r in before.select("round_trip").collect())


def test_near_duplicates_stage(spark):
    words = [f"w{i}" for i in range(120)]
    table = [(i, " ".join(words[: 118 + i % 3]), "en", "s", 0) for i in range(10)] + [(20 + i, f"clean text {i} " + " ".join(f"c{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(10)] + [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {0, None, *range(20, 30)}


def test_line_stage_keeps_clean_documents(spark):
    own = [f"document {i} says " + " ".join(f"d{i}w{k}" for k in range(20)) for i in range(5)]
    table = [(i, own[i], "en", "s", len(own[i])) for i in range(5)] + [(9, own[0], "en", "s", 1), (10, own[1] + "\nand more", "en", "s", 1), (11, "", "en", "s", 0), (12, None, "en", "s", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 10, 11, 12} and all(out[i].text == own[i] for i in range(5))
    assert out[10].text == "and more" and out[10].n_chars == 8


def test_toxicity_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where(f"toxicity >= {toxicity.THRESHOLD}").collect()}
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, docs, SF).collect()}
    assert bad and not bad & kept and len(bad | kept) == docs.count()


def test_stages_on_awkward_and_empty_tables(spark):
    """Nulls, repeated rows, clashing names, no n_chars; then no rows."""
    for docs in (documents(spark).drop("n_chars"), empty(spark)):
        for k, (name, stage) in enumerate(pipeline.STAGES):
            after = stage(spark, docs, SF)
            assert k == 4 or after.columns == docs.columns, name
            assert (after.count() == 0) == (docs.count() == 0), name
