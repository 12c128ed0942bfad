"""The filter audit against brute force, and its matrix against counted words."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tapestream.llm import audit

from .data import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(docs, labels):
    texts = [(d.doc_id, d.lang or "", d.text or "") for d in docs]
    least = {}
    for doc_id, _, text in texts:
        if doc_id is not None:
            least[text] = min(least.get(text, doc_id), doc_id)
    good, toxic = ({row.doc_id for row in labels if row[k] == 1 and row.doc_id is not None} for k in ("quality", "toxic"))
    parts = {}
    for doc_id, part, text in texts:
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and least[text] < doc_id}
        parts.setdefault(part, []).append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out = Counter()
    for part, rows in parts.items():
        cells, shapley = [], Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                earlier = set(order[:k])
                removed = [r for r in rows if f in r[0] and not r[0] & earlier]
                shapley[f] += len(removed)
                cells.append(("".join(order), k + 1, f, sum(not r[0] & (earlier | {f}) for r in rows), len(removed), sum(f in r[0] and bool(r[0] & earlier) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed)))
        out.update((part, order, k, *rest, shapley[f]) for order, k, f, *rest in cells)
    return out


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    more = [(100, long), (101, long), (102, "UPPER " + long), (103, long + " # |"), (104, "same " * 250), (105, "same " * 250), (106, long), (107, None)]
    docs = documents(spark).unionByName(spark.createDataFrame([(i, t, None if i % 2 else "fr") for i, t in more], "doc_id long, text string, lang string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(100, 1, 0, "x"), (101, 1, 1, "x"), (101, 0, 0, "x"), (3, None, 1, "x"), (None, 1, 1, "x"), (106, 1, None, "x")], LABELS)
    found = audit.interactions(docs, labels)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found.columns == columns
    assert Counter(map(tuple, found.collect())) == brute(docs.select("doc_id", "lang", "text").collect(), labels.collect())
    assert audit.interactions(empty(spark), labels).collect() == []


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("a", "x y", "en"), ("b", "x y", "en")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    rows = {(r.filter_order, r.step): r for r in audit.interactions(docs, labels).collect()}
    assert len(rows) == 600 and rows["EABCD", 1].removed == 1 and rows["EABCD", 1].good_lost == 1


def test_matrix_holds_the_words(spark):
    docs = documents(spark).repartition(3)
    whole, terms = audit.matrix(docs)
    words = {r.term: bytes(r.word) for r in terms.collect()}
    assert len(words) == terms.count() and len(set(words.values())) == len(words)
    found = Counter()
    for r in whole.collect():
        for i, doc_id in enumerate(r.doc_ids):
            cells = range(r.starts[i], r.starts[i + 1])
            listed = [r.terms[c] for c in cells]
            assert listed == sorted(set(listed)), "a row's terms are in order and each there once"
            found[doc_id, frozenset((words[r.terms[c]], r.counts[c]) for c in cells)] += 1
    expected = Counter((d.doc_id, frozenset(Counter((d.text or "").encode().split()).items())) for d in docs.select("doc_id", "text").collect())
    assert found == expected


def test_matrix_shards_share_one_dictionary(spark):
    docs = spark.range(4000, numPartitions=6).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("every"), F.concat(F.lit("own"), F.col("id") % 900)).alias("text"), F.lit("en").alias("lang"))
    whole, terms = audit.matrix(docs)
    assert whole.count() == 6 and terms.count() == terms.select("word").distinct().count() == 901
    out = audit.rows(whole).collect()
    assert len(out) == 4000 and all((r.n_words, r.n_distinct) == (2, 2) for r in out)


def test_words_split_at_exactly_six_characters():
    import pyarrow as pa

    texts = ["a\x0bb\x0cc\x1cd\x1fe\x85f g h \t\r\n i  ", "", " ", "x", "\x00y z\x7f w x x"]
    words, starts, terms, counts = audit._csr(pa.array([t.encode() for t in texts]))
    for i, text in enumerate(texts):
        cells = range(starts[i], starts[i + 1])
        assert {words[int(terms[c])].as_py().decode(): counts[c] for c in cells} == Counter(WORD.findall(text))
