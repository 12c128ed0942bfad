"""Operators that give a row for each document, against brute force on small tables."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapestream.llm import licenses, mixing, order, pieces, pii, quality, toxicity

from .data import SF, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def both(spark, columns=("doc_id", "text", "source")):
    """The awkward rows and the smallest given table."""
    yield documents(spark)
    yield spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_quality_counts(spark):
    for docs in both(spark):
        expected = Counter()
        for d in docs.select("doc_id", "text").collect():
            text = d.text or ""
            words = WORD.findall(text)
            windows = Counter(zip(words, words[1:], words[2:]))
            repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
            lines = [line for line in text.split("\n") if WORD.search(line)]
            expected[d.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words)] += 1
        found = Counter(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows(quality.quality(docs)))
        assert found == expected


def test_host_verdicts(spark):
    good, bad = "plain words of a text " + " ".join(f"w{i}" for i in range(60)), "short"
    table = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good if i % 10 else bad, f"good{i % 5}") for i in range(300)] + [(5000, bad, "tiny")]
    out = {r["doc_id"]: r for r in rows(quality.quality(spark.createDataFrame(table, "doc_id long, text string, source string")))}
    assert all(not out[i]["kept"] for i in range(200)), "a host that fails in nine of ten documents goes"
    assert all(out[1000 + i]["kept"] == bool(i % 10) for i in range(300))
    assert out[5000]["host_rate"] < 0.99, "one document proves little about its host"
    assert rows(quality.quality(empty(spark))) == []


def brute_pii(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            number = re.sub(r"\D", "", m[0])
            checks = {"ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(number) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(number[::-1])) % 10 == 0, "phone": lambda: 9 <= len(number) <= 15}
            if checks.get(kind, lambda: True)():
                found.append((m.start(), pii.KINDS.index(kind), kind, m.end()))
    return sorted(found)


def test_pii_base_spans(spark):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["a@b@c.d", "a@b.c_d@e.f@g.h", "+1 234 567 89 +1(((( 1234567890", "01.002.0003.000004 1.2.3", "4111111111111111" * 2, "x" * 30000 + "@", "1" * 5000, "a.b@c.d.", "4" * 12 + "  4111 1111 1111 1111", "é+1 234 567 890 ñ a@ñ.b ssn 123-45-6789"])], "doc_id long, text string")
    for docs in (*both(spark), more):
        found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, [(s["start"], pii.KINDS.index(s["kind"]), s["kind"], s["end"]) for s in r["spans"] if s["base"]]) for r in rows(pii.personal_data(docs)))
        assert found == sorted((d.doc_id if d.doc_id is not None else -1, brute_pii(d.text or "")) for d in docs.select("doc_id", "text").collect())
    assert rows(pii.personal_data(empty(spark))) == []


def test_pii_query(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in rows(pii.op2_personal_data(spark, SF)):
        spans = brute_pii(texts[r["doc_id"]])
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and set(listed.split(",")) <= {*r["spans"].split(","), ""}
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in spans) for k in pii.BASE]


def test_pii_em_tells_reliable_labelers():
    counts = [("k", v, n) for v, n in {(1, 1, 1): 400, (1, 1, -1): 300, (-1, -1, 1): 350, (-1, -1, -1): 450, (1, -1, 1): 5, (-1, 1, -1): 5}.items()]
    posterior, rates = pii.reliabilities(counts)
    assert posterior["k", (1, 1, -1)] > 0.9 and posterior["k", (-1, -1, 1)] < 0.1
    assert rates[0, "k", 1, 1] > 0.9 > 0.7 > rates[2, "k", 1, 1]


def test_pii_method_adds_spans(spark):
    docs = spark.createDataFrame([(i, f"social security number 123-45-67{i:02d} of one person") for i in range(10, 60)] + [(99, "nothing private here 12-34")], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in rows(pii.personal_data(docs))}
    assert all([s["kind"] for s in out[i]] == ["ssn"] for i in range(10, 60)) and out[99] == []


def test_pii_masked_email_needs_no_dot_in_words(spark):
    masked = ["jane.doe [at] example.com", "jane (at) mail.example.com", "j.doe [AT] example [dot] org", "jd(at)mail(dot)example(dot)com"]
    docs = spark.createDataFrame([(i, f"Please write to {masked[i % 4]}, number {i} (or not).") for i in range(60)], "doc_id long, text string")
    for r in rows(pii.personal_data(docs)):
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == [("masked_email", 16, 16 + len(masked[r["doc_id"] % 4]))]


def test_pii_iban_of_15_characters(spark):
    written = ["NO9386011117947", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"]
    docs = spark.createDataFrame([(i, f"iban {written[i % 4]}, entry {i}") for i in range(60)] + [(99, "iban NO93 8601 1117 94, too short")], "doc_id long, text string")
    for r in rows(pii.personal_data(docs)):
        found = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "iban"]
        assert found == ([] if r["doc_id"] == 99 else [(5, 5 + len(written[r["doc_id"] % 4]))])


def test_pii_secrets_by_name_and_digests_by_context(spark):
    """Values after a name are found; commit hashes and checksums of the same shape are not."""
    import hashlib as h

    word = lambda i: h.sha256(str(i).encode()).hexdigest()
    texts = []
    for i in range(300):
        texts += [(f"config api_key={'AKIA' + word(i).upper()[:16]} end", "secret"), (f"set password token={word(i)[:40]} now", "secret"), (f"the secret key is {word(i)[8:40]} here", "secret")]
        texts += [(f"see commit {word(i)[:40]} of the branch", ""), (f"its checksum sha256 {word(-i)} was right", ""), (f"md5 digest {word(i)[:32]} of the file", "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][0][s["start"] : s["end"]]) for s in r["spans"]] for r in rows(pii.personal_data(docs))}
    for i, (text, kind) in enumerate(texts):
        assert [k for k, _ in found[i] if k not in pii.BASE] == ([kind] if kind else []), text  # runs of digits may pass as cards
    assert found[0][0][1].startswith("AKIA")


def test_pii_many_matches_in_one_text(spark):
    text = "".join(f"é{i % 7}.x@host{i}.org, 10.0.{i % 256}.{i % 200} " for i in range(50_000))
    began = time.perf_counter()
    spans = rows(pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]["spans"]
    assert time.perf_counter() - began < 120
    base = [s for s in spans if s["base"]]
    assert Counter(s["kind"] for s in base) == {"email": 50_000, "ip": 50_000}
    assert all(re.fullmatch(pii.PATTERNS[s["kind"]].split(")", 3)[-1].replace("++", "+") if s["kind"] == "ip" else r"[0-9.]*x@host[0-9]+\.org", text[s["start"] : s["end"]]) for s in base[:: len(base) // 500])


def test_pii_kinds_have_three_live_votes(spark):
    texts = ["token = 0123456789abcdef0123456789abcdef", "checksum aGVsbG8/d29ybGQ+MTIzNDU2Nzg5MDEyMzQ1Njc4OTA", "plain abcdefghijklmnopqrstuvwxyz1", "call (212) 555-0100", "figure 017-555 7713", "at 212 555-0100"]
    texts += ["lives at 12 Oak Street", "figure 012 Oak Rd", "from 7 Elm Ct", "name James Smith", "version James BROWN", "so James Li", "ssn 123-45-6789", "figure 000-12-3456", "and 800-12-3456", "iban DE89 3704 0044 0532 0130 00", "invoice DE89 3704 0044 0532 0130 0", "or XX89 3704 0044 0532 0130 01"]
    texts += ["mail jane [at] example.com", "table -jane [at] ab.zz", "by jane [at] example.qq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = defaultdict(lambda: [set(), set(), set()])
    for r in rows(pii.candidates(docs)):
        for s in r["spans"]:
            for held, v in zip(seen[s["kind"]], s["votes"], strict=True):
                held.add(v)
    added = [k for k in pii.KINDS if k not in pii.BASE]
    assert {k: [len(v) > 1 for v in seen[k]] for k in added} == {k: [True] * 3 for k in added}


def test_pii_em_changes_what_is_kept(spark):
    """Sample numbers in a telling context: two labelers outvote the gazetteer, until EM finds that context is worthless here."""
    n = 300
    texts = ["ssn 123-45-6789"] * n + ["id 000-12-3456"] * n + [f"ssn 000-{10 + i % 80}-1234" for i in range(n)] + [f"id 219-{10 + i % 80}-9999" for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [{r["doc_id"] for r in rows(pii.personal_data(docs, rounds)) if r["spans"]} for rounds in (0, 50)]
    assert kept[0] != kept[1]


def test_mixing(spark):
    for docs in both(spark):
        out = rows(mixing.mixed_counts(docs))
        sizes = defaultdict(int)
        for d in docs.select("source", "text").collect():
            sizes[d.source] += len(WORD.findall(d.text or ""))
        assert len(out) == docs.count() and all(r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3 for r in out)
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        target, open_, rest = {}, set(names), sum(sizes.values())
        while True:
            level = rest / max(sum(weight[s] for s in open_), 1)
            over = [s for s in open_ if weight[s] * level >= 3 * sizes[s]]
            if not over:
                break
            for s in over:
                target[s] = 3 * sizes[s]
                rest -= target[s]
                open_.remove(s)
        target |= {s: weight[s] * level for s in open_}
        assert all(abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) for r in out)
        mixed = Counter(r["doc_id"] for r in rows(mixing.mix(docs)))
        expected = Counter()
        for r in out:
            expected[r["doc_id"]] += r["copies"]
        assert mixed == +expected
        assert mixing.mix(docs).columns == docs.columns
    assert rows(mixing.mixed_counts(empty(spark))) == [] and rows(mixing.mix(empty(spark))) == []


def test_mix_comes_near_targets(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "concat('s', cast(if(id % 3 = 0, 0, id % 7) as string)) as source", "repeat('w ', cast(id % 50 as int)) as text")
    taken = mixing.mixed_counts(docs).selectExpr("source", "size * copies as taken", "target").groupBy("source").agg({"taken": "sum", "target": "max"})
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"] for r in taken.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = order.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert slots.tolist() != order.feistel(np.arange(n), n, key=1).tolist() and abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def test_training_order_round_trip(spark, tmp_path):
    for docs in both(spark):
        where = tmp_path / f"shards{docs.count()}"
        out = sorted(rows(order.training_order(docs, f"file://{where}", length=64, shard_rows=20, waves=3)), key=lambda r: r["slot"])
        assert [r["slot"] for r in out] == list(range(len(out))) and sorted(r["seq"] for r in out) == list(range(len(out)))
        assert all(r["shard"] == r["slot"] // 20 and r["byte_offset"] == r["slot"] % 20 * 128 for r in out)
        for r in out:
            with open(r["path"], "rb") as file:
                data = file.read()
            r["record"] = data[r["byte_offset"] : r["byte_offset"] + 128]
            assert hashlib.sha256(data).hexdigest() == r["shard_sha256"] and hashlib.sha256(r["record"]).hexdigest() == r["record_sha256"]
            assert len(data) == 128 * sum(o["shard"] == r["shard"] for o in out)
        assert len({r["path"] for r in out}) == len({r["shard"] for r in out}) == len(list(where.iterdir()))
        with open(order.VOCABULARY, "rb") as file:
            tokenizer = order.Tokenizer(file.read())
        stream = np.concatenate([np.frombuffer(r["record"], "<u2")[: r["n_tokens"]] for r in sorted(out, key=lambda r: r["seq"])]).tolist()
        found, held = Counter(), []
        for token in stream:
            if token == order.END_OF_TEXT:
                found[tuple(held)] += 1
                held = []
            else:
                held.append(token)
        assert not held and found == Counter(tuple(tokenizer.encoding.encode_ordinary(d.text or "")) for d in docs.select("text").collect())
        assert order.read_slots(out[0]["path"], 3, 2, 64).tobytes() == out[3]["record"] + out[4]["record"]
    assert rows(order.training_order(empty(spark))) == []


def test_training_order_is_the_datas(spark, monkeypatch):
    """However the table is dealt to tasks, the shards are the same."""
    monkeypatch.setattr(order, "RANGE_DOCS", 16)
    for docs in both(spark):
        found = [{(r["shard"], r["shard_sha256"]) for r in rows(order.training_order(d, length=64, shard_rows=50))} for d in (docs.repartition(7), docs.orderBy("text").coalesce(2))]
        assert found[0] == found[1] and len(found[0]) > 1


def test_pieces_are_the_librarys_and_come_back(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for docs in (*both(spark), spark.read.parquet(f"{SF.removesuffix('sf0.001')}sf0.01/documents.parquet")):
        encoded = pieces.encode(docs)
        found = rows(encoded)
        assert all(r["round_trip"] for r in found)
        expected = Counter((d.doc_id, tuple(library.encode(d.text or ""))) for d in docs.select("doc_id", "text").collect() if pieces.MARK not in (d.text or ""))
        assert not expected - Counter((r["doc_id"], tuple(r["ids"])) for r in found) and len(found) == docs.count()
        assert Counter((r["doc_id"], r["text"]) for r in rows(pieces.decode(encoded))) == Counter((d.doc_id, d.text or "") for d in docs.select("doc_id", "text").collect())
    assert rows(pieces.encode(empty(spark))) == []


@pytest.fixture(scope="module")
def coders():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Encoder(pieces.load_model())


@settings(deadline=None, max_examples=300)
@given(text=st.text(st.sampled_from(" ▁abeinorst.,'0é漢\n\t"), max_size=60), spaces=st.integers(0, 40))
def test_pieces_of_any_text(coders, text, spaces):
    library, encoder = coders
    text = " " * (spaces // 2) + text[: len(text) // 2] + " " * spaces + text[len(text) // 2 :]
    ids = encoder.encode([text])[0].tolist()
    assert encoder.decode(ids).decode() == text
    if pieces.MARK not in text:
        assert ids == library.encode(text)


def test_license_base_places(spark):
    for docs in both(spark):
        expected = Counter()
        for d in docs.select("doc_id", "text").collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
            places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            expected[d.doc_id, len(words), len(places), min(places, default=(None,))[0], max((p for p, _ in places), default=None), ",".join(sorted({label for _, label in places}))] += 1
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"])) for r in rows(licenses.scan_licenses(docs))) == expected
    assert rows(licenses.scan_licenses(empty(spark))) == []


def test_license_matching_statistics():
    scanner = licenses.Scanner()
    notices = [licenses.tokens(t.encode()) for texts in licenses.TEMPLATES.values() for t in texts]
    a = scanner.automaton
    for notice in notices:  # every window of a notice is a path, and no other string of its words is
        for i in range(len(notice)):
            state = 0
            for word in notice[i:]:
                state = a.next[state][a.vocabulary[word]]
    text = [*notices[1][3:12], *notices[0], *notices[3][:6]]
    substrings = {tuple(n[i:j]) for n in [*notices, *(licenses.tokens(p.encode()) for p in licenses.PHRASES)] for i in range(len(n)) for j in range(i + 1, len(n) + 1)}
    matches = []
    scanner.run([a.vocabulary[w] for w in text], 0, [], matches)
    longest = [max((e - s for s in range(e) if tuple(text[s:e]) in substrings), default=0) for e in range(1, len(text) + 1)]
    expected = [(e + 1 - n, e + 1) for e, n in enumerate(longest) if n >= licenses.MIN_MATCH and (e + 1 == len(text) or longest[e + 1] != n + 1)]
    assert [(s, e) for s, e, _ in matches] == expected


def test_license_labels(spark):
    mit = licenses.TEMPLATES["mit"][1]
    docs = spark.createDataFrame([(1, "before " + mit + " after"), (2, mit.replace("merge", "merge xx yy").replace("including", "includes")), (3, "permission is granted to copy the software"), (4, "Released under the MIT License.")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in rows(licenses.scan_licenses(docs))}
    assert [out[i]["labels"] for i in (1, 2, 3, 4)] == [["mit"], ["mit"], [], ["mit"]]
    assert out[1]["score"] > 0.9 and out[3]["score"] == 0.0


def test_license_notices_and_identifiers(spark):
    texts = {f"some code here\n{notice} and more code": label for label, found in licenses.TEMPLATES.items() for notice in found}
    texts |= {f"# {licenses.SPDX_TAG}{name}\nimport os": label for label, names in licenses.SPDX.items() for name in names}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows(licenses.scan_licenses(table)):
        text = list(texts)[r["doc_id"]]
        assert texts[text] in r["labels"] and set(r["labels"]) - set(r["base_labels"]) <= {texts[text]}, (text, r["labels"])
    other = spark.createDataFrame([(1, licenses.SPDX_TAG + "Foo-1.0"), (2, "the SPDX license identifier of a file"), (3, licenses.SPDX_TAG + "CC-BY-ND-4.0")], "doc_id long, text string")
    assert all(set(r["labels"]) <= set(r["base_labels"]) for r in rows(licenses.scan_licenses(other)))


def test_license_names_and_expressions(spark):
    tag = licenses.SPDX_TAG
    texts = {
        tag + "GPL-2.0": "gpl", tag + "GPL-2.0+": "gpl", tag + "LGPL-2.1\nint x;": "lgpl", tag + "AGPL-3.0": "agpl", tag + "MIT OR Apache-2.0": "apache-2.0,mit", tag + "(MIT AND BSD-3-Clause)": "bsd,mit",
        tag + "GPL-2.0 OR MIT": "gpl,mit", tag + "GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0 */": "apache-2.0,gpl", tag + "GPL-2.0-or-later or nothing": "gpl", tag + "Foo-1.0 OR MIT": "",
        "Licensed under GPLv3.": "gpl", "released under the MIT license, and more": "mit", "it was released under a cloud": "", "distributed under the 3-Clause BSD": "bsd", "spdx license identifier": "", tag + "MIT AND": "mit",
    }
    table = spark.createDataFrame([(f"id {i}", text) for i, text in enumerate(texts)], "doc_id string, text string")
    found = {r["doc_id"]: r for r in rows(licenses.scan_licenses(table))}
    assert [",".join(found[f"id {i}"]["labels"]) for i in range(len(texts))] == list(texts.values())
    first = found["id 4"]["spans"]
    assert [(s["label"], s["start"], s["end"]) for s in first] == [("mit", 0, 4), ("apache-2.0", 0, 8)]


def test_license_chain_with_repeated_stretches():
    """A notice that says the same twice is covered in order, at both places."""
    scanner = licenses.Scanner()
    words = [w.encode() for w in "a b c d x a b c d y a b c d".split()]
    scanner.automaton = licenses.Automaton([words])
    scanner.names, scanner.n_phrases, scanner.least, scanner.phrases = ["twice"], 0, [1.0], [()] * len(scanner.automaton.next)
    matches: list = []
    text = [w.encode() for w in "a b c d q a b c d q a b c d".split()]
    at = 0
    for part in (text[0:4], text[5:9], text[10:14]):
        scanner.run([scanner.automaton.vocabulary[w] for w in part], at, [], matches)
        at += 5
    assert scanner.automaton.ends[matches[0][2]] == {0: [4, 9, 14]}
    scanner.least = [12 / 14]
    assert scanner.chains(matches) == [("twice", 0, 14)]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert 0.15 < len(held) / len(out) < 0.35
    positive = [r.score for r in held if r.toxic]
    negative = [r.score for r in held if not r.toxic]
    auc = np.mean([(a > b) + (a == b) / 2 for a in positive for b in negative])
    assert auc > 0.9, auc


def test_toxicity_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (4, 1, None), (None, 0, 1), (50, 1, 0)], "doc_id long, quality int, toxic int")
    out = rows(toxicity.toxicity(docs, labels))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == 0.0 for r in rows(toxicity.toxicity(docs, labels.limit(0))))
    assert rows(toxicity.toxicity(empty(spark), labels)) == []


def test_ftrl_is_the_scalar_loop():
    rng = np.random.default_rng(5)
    rows_ = [(int(i), int(rng.random() < 0.4), np.unique(rng.integers(0, 40, 6)).astype(np.int32)) for i in rng.permutation(60)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.4, 0.1
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - (l1 if z[f] > 0 else -l1)) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(3):
        for _, label, features in sorted(rows_, key=lambda r: r[0]):
            held = {f: weight(f) for f in features.tolist()}
            g = 1 / (1 + np.exp(-(bias + sum(held.values())))) - label
            for f, w in held.items():
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w
                n[f] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + bias_n**0.5)
    found_bias, found = toxicity.ftrl(rows_, alpha, beta, l1, l2, epochs=3)
    assert found_bias == pytest.approx(bias) and found[:40] == pytest.approx([weight(f) for f in range(40)]) and not found[40:].any()
    assert (found[:40] == 0).any() and (found[:40] != 0).any()
