"""Operators on pairs, against brute force over all pairs of small tables."""

import itertools
import random
import re

import numpy as np
import pytest

from tapestream.llm import components, jaccard, lines, vectors

from .data import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 900)]
    expected = groups(900, edges)
    found = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, (None, 1), (2, 2)], "a long, b long")).collect()}
    assert all(found.get(i, i) == expected[i] for i in range(900)) and len(found) == len({x for e in edges for x in e if e[0] != e[1]})
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def near_copies():
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    table = []
    for size in (3, 5, 8, 20, 40, 70, 130, 260, 600):
        base = random.choices(words, k=size)
        for _ in range(9):
            copy = list(base)
            for _ in range(random.randrange(0, 1 + size // 30)):
                copy[random.randrange(len(copy))] = random.choice(words)
            cut = random.randrange(0, 1 + size // 10)
            table.append(" ".join(copy[cut:]))
    common = " ".join(random.choices(words, k=60))
    table += [common + " " + " ".join(random.choices(words, k=random.randrange(5, 90))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(table + table[:5])]


@pytest.mark.parametrize("width,percent,share,paired", [(4, 85, 0.0005, 256), (5, 80, 0.0005, 256), (4, 85, 0.01, 3), (3, 60, 0.2, 10)])
def test_jaccard_loses_no_link(spark, monkeypatch, width, percent, share, paired):
    monkeypatch.setattr(jaccard, "MOST_PAIRED", paired)
    monkeypatch.setattr(jaccard, "SIGNATURE_ROWS", 4)  # several tiles of a signature
    monkeypatch.setattr(jaccard, "BLOCK_COST", 4000)  # several tiles in a group
    table = near_copies()
    sets = [shingles(t, width) for _, t in table]
    frequent = {s for s in set().union(*sets) if sum(s in x for x in sets) > share * len(sets)}
    assert frequent
    edges = [(a, b) for a, b in itertools.combinations(range(len(table)), 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a]]
    expected = groups(len(table), edges)
    degree = [sum(i in e for e in edges) for i in range(len(table))]
    found = {r.doc_id: r for r in jaccard.jaccard_join(spark.createDataFrame(table, "doc_id long, text string"), width, percent).collect()}
    assert [found[i].n_shingles for i in range(len(table))] == [len(s) for s in sets]
    assert [found[i].component_id for i in range(len(table))] == expected
    assert [found[i].n_links for i in range(len(table))] == degree
    assert sum(degree) > 100


def test_jaccard_repeated_ids(spark):
    """Rows of one id with different texts link by their own texts."""
    words = [[f"{k}w{i}" for i in range(100)] for k in "ab"]
    a, b = (" ".join(w) for w in words)
    table = [(7, a), (7, b), (8, a + " tail"), (9, b + " tail"), (3, b + " end")]
    found = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert found == [(3, 3, 2), (7, 3, 2), (7, 7, 1), (8, 7, 1), (9, 3, 2)]


def test_jaccard_hot_signature(spark, monkeypatch):
    """Many texts share a passage and so signatures, few of them link: no group of all comes of it."""
    monkeypatch.setattr(jaccard, "SIGNATURE_ROWS", 50)
    shared = " ".join(f"s{i}" for i in range(12))
    table = [(i, f"{shared} " + " ".join(f"d{i // 2}x{k}" for k in range(10)) + (" end" if i % 2 else "")) for i in range(400)]
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda *_: np.zeros(0, np.uint64))
    grouped = []
    kept = jaccard.verified_links
    monkeypatch.setattr(jaccard, "verified_links", lambda d, c, g, *a: (grouped.append(g), kept(d, c, g, *a))[1])
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i in range(400)}
    assert grouped[0].groupBy("component").count().agg({"count": "max"}).first()[0] < 100


def test_jaccard_awkward_rows(spark):
    out = jaccard.jaccard_join(documents(spark)).collect()
    assert len(out) == documents(spark).count()
    by_id = {r.doc_id: r for r in out}
    assert by_id[0].n_shingles == by_id[1].n_shingles == by_id[2].n_shingles == 0 and [by_id[i].component_id for i in (0, 1, 2)] == [0, 1, 2]
    assert by_id[3].n_links == 2 and by_id[None].component_id is None and by_id[50].component_id == 4
    assert jaccard.jaccard_join(empty(spark)).collect() == []


def test_signatures_meet():
    """Any two sets that link share a signature, whatever shingles count as frequent."""
    rng = np.random.default_rng(1)
    for n in (6, 7, 20, 63, 64, 70, 127, 128, 300, 1000):
        for _ in range(30):
            base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            d = rng.integers(0, jaccard.most_different(n, 80) + 1)
            gone = rng.integers(0, d + 1)
            other = np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**63, d - gone).astype(np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 100 * both < 80 * (len(base) + len(other) - both) or d == 0:
                continue
            frequent = np.sort(rng.choice(base, rng.integers(0, n)))
            assert set(jaccard.signatures(base, frequent, 80).tolist()) & set(jaccard.signatures(other, frequent, 80).tolist())
            assert jaccard.overlap_bound(jaccard.bitmap(base), len(base), jaccard.bitmap(other), len(other)) >= both


def brute_patience(a, b):
    """Only what any alignment must satisfy: rising, equal lines; unique common lines in one order are all in."""
    pairs = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
    return pairs


def test_patience():
    assert brute_patience(list("abcde"), list("xbcdy")) == [(1, 1), (2, 2), (3, 3)]
    assert brute_patience(list("aabb"), list("aabb")) == [(i, i) for i in range(4)]
    assert brute_patience(list("abc"), list("cab")) == [(0, 1), (1, 2)]
    assert brute_patience([], list("ab")) == [] and brute_patience(list("ab"), list("cd")) == []
    random.seed(2)
    for _ in range(200):
        brute_patience(random.choices("abcdefgh", k=random.randrange(12)), random.choices("abcdefgh", k=random.randrange(12)))
    assert lines.blocks([(0, 3), (1, 4), (3, 5), (4, 6)]) == [[3, 4], [5, 6]]


def test_line_dedup(spark):
    p = [f"passage {i} " + " ".join(f"p{i}w{k}" for k in range(10)) for i in range(6)]
    own = lambda i: f"only document {i} has this line of its own words"
    table = [(1, "\n".join([own(1), p[0], p[1], "short line", "tail of one"])), (2, "\n".join([own(2), p[0], p[1], "short line", own(22)])), (3, "\n".join(p[:2])), (4, own(4)), (5, None), (6, ""), (7, "That it."), (8, "That it."), (None, p[0]), (3, "\n".join(p[:2])), (9, "  " + p[0] + " \n" + own(9))]
    table += [(100 + i, p[5] + "\n" + own(100 + i)) for i in range(50)]
    out = {(r.doc_id, k): r for k, r in enumerate(lines.without_repeats(spark.createDataFrame(table, "doc_id long, text string")).orderBy("doc_id", "text").collect())}
    texts = {}
    for (i, _), r in out.items():
        texts.setdefault(i, []).append((r.text, r["__removed"]))
    assert texts[1] == [(table[0][1], 0)]
    assert texts[2] == [(own(2) + "\n" + own(22), 3)], "the short line goes with the block around it"
    assert texts[3] == [("", 2), ("", 2)] and texts[4] == [(own(4), 0)]
    assert texts[5] == [(None, 0)] and texts[6] == [("", 0)] and texts[7] == texts[8] == [("That it.", 0)] and texts[None] == [(p[0], 0)]
    assert texts[9] == [(own(9), 1)]
    assert texts[100] == [(p[5] + "\n" + own(100), 0)] and all(texts[100 + i] == [(own(100 + i), 1)] for i in range(1, 50))
    assert lines.without_repeats(empty(spark)).collect() == []
    assert lines.without_repeats(documents(spark)).count() == documents(spark).count()


def brute_lines(table):
    """Lines that stay in each document: all but the runs of 8 words or more that an earlier document has as a run."""
    held = [(i, t.split("\n")) for i, t in table]
    left = {}
    for k, (i, b) in enumerate(held):
        gone = set()
        for s, e in itertools.combinations(range(len(b) + 1), 2):
            if sum(len(WORD.findall(x)) for x in b[s:e]) >= 8 and any(b[s:e] == a[p : p + e - s] for _, a in held[:k] for p in range(len(a))):
                gone |= set(range(s, e))
        left[i] = "\n".join(x for j, x in enumerate(b) if j not in gone)
    return left


def test_line_dedup_leaves_no_crossing_or_repeated_line(spark):
    p = [" ".join(f"p{i}w{k}" for k in range(9)) for i in range(12)]
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(9))
    table = [(1, "\n".join([*p[:6], own(1)])), (2, "\n".join([own(2), *p[5::-1]])), (3, "\n".join([p[2], own(3), p[2], p[0]]))]
    table += [(10, "\n".join([p[6], own(10), p[6], p[7]])), (11, "\n".join([p[7], own(11), p[6]]))]
    random.seed(8)
    table += [(20 + i, "\n".join([own(20 + i), *random.choices(p, k=7), own(120 + i)])) for i in range(20)]
    found = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found == brute_lines(table)
    assert found[2] == own(2) and found[11] == own(11)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_is_that_of_all_pairs(spark, seed, monkeypatch):
    """Every run of lines with enough words that any earlier document holds goes, and nothing else; blocks are held by 2 to 40 documents."""
    monkeypatch.setattr(lines, "TILE", 5)
    rng = random.Random(seed)
    blocks = [[" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice((1, 2, 3, 4, 9)))) for _ in range(rng.randrange(2, 7))] for _ in range(12)]
    texts = []
    for i in range(120):
        parts = [rng.choice(blocks) if rng.random() < 0.7 else [f"own {i} {rng.random()}"] for _ in range(rng.randrange(1, 6))]
        parts = [rng.sample(p, len(p)) if rng.random() < 0.2 else p[rng.randrange(len(p)) :] if rng.random() < 0.3 else p for p in parts]
        texts.append([line for p in parts for line in p])
    expected = {}
    for j, b in enumerate(texts):
        gone = set()
        for a in texts[:j]:
            for s, t in itertools.product(range(len(b)), range(len(a))):
                n = 0
                while s + n < len(b) and t + n < len(a) and b[s + n] == a[t + n]:
                    n += 1
                if sum(len(x.split()) for x in b[s : s + n]) >= lines.MIN_BLOCK_WORDS:
                    gone.update(range(s, s + n))
        expected[j] = "\n".join(x for k, x in enumerate(b) if k not in gone)
    table = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.without_repeats(table).collect()} == expected


def test_line_dedup_finds_blocks_of_short_lines(spark):
    random.seed(9)
    short = [" ".join(f"s{i}w{k}" for k in range(i % 4)) for i in range(40)]
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(9))
    verse = "\n".join(f"verse {i} here" for i in range(20))
    table = [(i, own(i) + "\n" + verse + "\n" + own(50 + i)) for i in range(3)]
    for i in range(3, 40):
        cut = random.randrange(len(short))
        table.append((i, "\n".join([own(i), *(short[cut:] + short[:cut])[: random.randrange(2, 14)], *random.choices(short, k=4), own(100 + i)])))
    found = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found == brute_lines(table)
    assert found[1] == own(1) + "\n" + own(51)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)  # several tiles in a list
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, base[i].tolist(), int(i % 3)) for i in range(60)]
    rows += [(100 + i, (base[i % 60] * 3 + 0.15 * rng.normal(size=16)).tolist(), int(i % 60 % 3)) for i in range(90)]
    rows += [(300 + i, (base[0] + 0.05 * rng.normal(size=16)).tolist(), 0) for i in range(40)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, base[1].tolist(), None), (None, base[1].tolist(), 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1), (908, [float("inf")] * 16, 1), (1, base[1].tolist(), 1)]
    table = rows + odd
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    edges = []
    for a, b in itertools.combinations(range(len(table)), 2):
        (i, u, lu), (j, v, lv) = table[a], table[b]
        if lu == lv and lu is not None and i is not None and j is not None and ok(u) and ok(v) and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
            edges.append((a, b))
    out = vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"))
    found = out.collect()
    assert len(found) == len(table)
    total = sum(r.n_links for r in found)
    assert 0.9 * 2 * len(edges) <= total <= 2 * len(edges)
    by_id = {r.vec_id: r for r in found}
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i for i in (900, 901, 902, 903, 904, 907, 908))
    assert by_id[None].component_id is None and by_id[906].component_id == 905 and not by_id[906].kept
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in found)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []


def test_vector_recall(spark, monkeypatch):
    """Planted pairs at the threshold, in the given table's dimension, with few and with many pivots."""
    rng = np.random.default_rng(8)
    n, dim = 600, 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(n, dim)))
    away = rng.normal(size=(n, dim))
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(0.9301, 0.95, size=(n, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away, unit(rng.normal(size=(3 * n, dim)))])
    linked = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert linked.sum() >= 2 * n
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for many in (vectors.PIVOTS, 2 * vectors.PIVOTS):
        monkeypatch.setattr(vectors, "pivot_count", lambda _, many=many: many)
        found = vectors.near_duplicates(table).collect()
        assert 0.94 * linked.sum() <= sum(r.n_links for r in found) <= linked.sum()


def test_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(9)
    hot = rng.normal(size=8).tolist()
    near = [v + 0.01 for v in hot]
    table = [(i, hot, 1) for i in range(3000)] + [(5000 + i, near, 1) for i in range(10)] + [(9000, hot, 2)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(found[i] == (3009, 0, i == 0) for i in [*range(3000), *range(5000, 5010)]) and found[9000] == (0, 9000, True)


def test_pivots_grow():
    assert [vectors.pivot_count(n) for n in (10, 50_000, 400_000, 10**10)] == [192, 192, 384, 1023]
