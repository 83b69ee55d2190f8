"""Jaccard join, substring dedup and license scan against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

import __spark_entry__ as E
from documents_fixture import docs_of  # noqa: F401
from ledgerlake.llm import jaccard_join, licenses, shingles, substring_dedup

SF = "/root/testdata/sf0.001"


def near_rows(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([6, 40, 120]))]
        for _ in range(r.choice([1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 3, 8])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, r.choice([" ", "\n", ", "]).join(w)))
            i += 1
    r.shuffle(rows)
    return rows


def shingle_set(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return frozenset(tuple(w[k : k + min(5, len(w))]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def classes_by_hand(rows):
    sets, texts = {}, defaultdict(set)
    for k, (d, t) in enumerate(rows):
        sets.setdefault(shingle_set(t), []).append(k)
        texts[shingle_set(t)].add(t or "")
    items = list(sets)
    up = list(range(len(items)))
    links = [len(texts[s]) - 1 if s else 0 for s in items]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if items[a] and items[b] and 5 * len(items[a] & items[b]) >= 4 * len(items[a] | items[b]):
                links[a] += len(texts[items[b]])
                links[b] += len(texts[items[a]])
                up[top(a)] = top(b)
    members = defaultdict(list)
    for x, s in enumerate(items):
        members[top(x)] += sets[s]
    order = lambda d: (d is None, d if d is not None else 0)
    out = []
    for x, s in enumerate(items):
        first = min((rows[k][0] for k in members[top(x)]), key=order)
        out += [(rows[k][0], first, links[x]) for k in sets[s]]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links_equal_brute_force(docs_of, seed):
    rows = near_rows(seed) + [(500, None), (501, ""), (502, "a b"), (503, "A b!"), (None, "a b"), (None, "q r s t u v"), (504, "q r s t u v"),
                              (504, "q r s t u v"), (505, "x " * 30_000)]
    got = jaccard_join.similarity_classes(docs_of(rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(g) for g in got), key=str) == classes_by_hand(rows)
    kept = jaccard_join.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    heads = {c for _, c, _ in classes_by_hand(rows)}
    assert sorted(map(str, (k.doc_id for k in kept.collect()))) == sorted(map(str, heads))


def thue_morse(n=1024):
    """Two words that a polynomial of their letters modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_of_equal_sets_are_linked(docs_of):
    rows = [(1, "a b c d e f"), (2, "A b, c d e f!"), (3, "a b c d e f."), (3, "a b c d e f."), (4, "..."), (5, "!"), (6, None)]
    got = {g.doc_id: (g.class_id, g.n_links) for g in jaccard_join.similarity_classes(docs_of(rows)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (4, 0), 6: (4, 0)}


def test_colliding_words_are_told_apart(docs_of):
    a, b = thue_morse()
    h, _ = shingles.hashed_words(pa.array([a, b]))
    assert h[0] != h[1]
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {a} x")]
    got = substring_dedup.duplicate_spans(docs_of(rows)).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got), key=str) == spans_by_hand(rows)
    short = [(1, f"v w x y {a}"), (2, f"v w x y {b}")]
    got = jaccard_join.similarity_classes(docs_of(short)).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(g) for g in got), key=str) == classes_by_hand(short) == [(1, 1, 0), (2, 2, 0)]
    notice = f"released under the {a} license of {a}"
    found = licenses.scan(docs_of([(1, notice), (2, notice.replace(a, b))]), (("X", notice),)).collect()
    assert {g.doc_id: len(g.license_matches) for g in found} == {1: 1, 2: 0}


def test_blocks_count_links_of_a_large_class(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(30)]
    got = jaccard_join.similarity_classes(docs_of(rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(g) for g in got), key=str) == classes_by_hand(rows)


def test_empty_tables(docs_of):
    assert jaccard_join.similarity_classes(docs_of([])).count() == 0
    assert jaccard_join.one_of_each(docs_of([])).count() == 0
    assert substring_dedup.duplicate_spans(docs_of([])).count() == 0
    assert licenses.scan(docs_of([])).count() == 0


def test_prefix_lengths_reach_the_recall():
    deep, reach = jaccard_join.levels()
    assert 1 - (1 - 0.8**reach) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (reach + 1)) ** jaccard_join.TREES
    assert deep == jaccard_join.DEPTH


def test_words_are_hashed_by_content():
    texts = ["a b\tc", None, "", " ", "b", "é\x0bb", "c"]
    h, at = shingles.hashed_words(pa.array(texts))
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert [len(w) for w in words] == list(at[1:] - at[:-1])
    seen = {}
    for w, x in zip([w for ws in words for w in ws], h):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    sliced, _ = shingles.hashed_words(pa.array(["zz", *texts])[1:])
    assert list(sliced) == list(h)


def spans_by_hand(rows, n=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    first = {}
    order = lambda d: float("inf") if d is None else d
    for d, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, float("inf")), order(d))
    out = []
    for d, w in words:
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < order(d) for j in range(k, k + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_removed_words_equal_brute_force(docs_of, seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(3 if seed == 3 else 40)]
    pool = [[r.choice(vocab) for _ in range(r.choice([12, 13, 14, 30, 60]))] for _ in range(8)]
    rows = []
    for d in range(40):
        parts = [r.choice(pool) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(0, 20))] for _ in range(r.randint(0, 5))]
        text = r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)
        rows.append((d * 3 - 20, text))
    rows += [(None, rows[3][1]), (None, " ".join(pool[4])), (7000, None), (7001, ""), (7002, rows[5][1]), (7002, rows[5][1]), (7002, " ".join(pool[5])),
             (-99, " ".join(pool[6][:12])), (8000, "x " * 20_000), (8001, "x " * 14)]
    r.shuffle(rows)
    got = substring_dedup.duplicate_spans(docs_of(rows)).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got), key=str) == spans_by_hand(rows)
    for g in got:
        covered = {j for s in g.spans for j in range(s.start, s.end)}
        assert len(covered) == g.n_removed and all(s.end - s.start >= 13 and (g.doc_id is None or s.source < g.doc_id) for s in g.spans)


def test_spans_cut_the_text(docs_of, spark):
    from pyspark.sql import functions as F

    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    df = docs_of([(1, a), (2, f"x  {a}\ny {b}"), (3, f"{b} z")])
    cut = df.select("doc_id", "text").join(substring_dedup.duplicate_spans(df), "doc_id")
    got = {r.doc_id: r.kept for r in cut.select("doc_id", substring_dedup.without_spans(F.col("text"), F.col("spans")).alias("kept")).collect()}
    assert got == {1: a, 2: f"x y {b}", 3: "z"}


def test_greedy_factors():
    assert substring_dedup.parsed([(0, 1), (1, 1), (2, 4), (9, 4)]) == [(0, 14, 1), (2, 15, 4), (9, 22, 4)]
    assert substring_dedup.kept_words(list(range(30)), [(0, 14, 1), (2, 15, 4), (20, 28, 4)]) == [*range(15, 20), 28, 29]


def licenses_by_hand(text):
    words = lambda t: re.findall(r"[a-z0-9]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    w = words(text)
    sh = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    found = set()
    for name, t in licenses.TEMPLATES:
        tw = words(t)
        ts = {tuple(tw[k : k + 5]) for k in range(len(tw) - 4)}
        g = 1 << (len(ts) - 1).bit_length()
        for k in range(len(sh)):
            if 5 * len(ts & set(sh[k : k + g])) >= 4 * len(ts):
                found.add(name)
    return found


def test_licenses_are_found_where_they_stand(docs_of):
    r = random.Random(5)
    filler = lambda n: " ".join(r.choice(["lorem", "the", "license", "under", "version", "a"]) for _ in range(n))
    rows = [(k, f"{filler(r.randint(0, 50))}\n{t}\n{filler(r.randint(0, 50))}") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + k, f"{filler(9)} {t.upper().replace(' ', '  ')}") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(200 + k, filler(120)) for k in range(10)] + [(300, None), (301, ""), (302, "MIT License"), (None, licenses.TEMPLATES[0][1])]
    rows += [(303, " ".join(licenses.TEMPLATES[1][1].split()[:26])), (304, filler(20_000) + licenses.TEMPLATES[4][1])]
    got = licenses.scan(docs_of(rows)).collect()
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for g in got:
        found = {m.license for m in g.license_matches}
        assert found >= licenses_by_hand(g.text), g.doc_id
        assert all(m.containment >= 0.8 for m in g.license_matches)
        if g.doc_id is not None and g.doc_id < 200:
            name, t = licenses.TEMPLATES[g.doc_id % 100]
            assert name in found
        if g.doc_id in (300, 301, 302) or 200 <= (g.doc_id or 0) < 300:
            assert not found
    assert len(got) == len(rows)


def test_license_matches_depend_on_the_text_alone(docs_of, spark):
    r = random.Random(8)
    filler = lambda n: " ".join(r.choice(["lorem", "the", "license", "under", "version", "a"]) for _ in range(n))
    rows = []
    for k in range(120):
        some = [t for _, t in r.sample(licenses.TEMPLATES, r.randint(1, 3))]
        rows.append((k, filler(r.randint(0, 70)) + " " + f" {filler(r.randint(0, 40))} ".join(some * r.randint(1, 2))))
    table = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    seen = []
    for parts, templates in ((1, licenses.TEMPLATES), (5, licenses.TEMPLATES), (2, table)):
        got = licenses.scan(docs_of(rows).repartition(parts, "text"), templates).collect()
        seen.append({g.doc_id: sorted((m.license, m.start, m.containment) for m in g.license_matches) for g in got})
    assert seen[0] == seen[1] == seen[2] and all(seen[0].values())
    once = licenses.scan(docs_of([(1, filler(33) + " " + licenses.TEMPLATES[1][1])])).first().license_matches
    assert [m.license for m in once] == ["MIT"] and once[0].containment == 1.0


def test_queries_cover_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = E.queries()["op1_license_scan"](spark, SF).collect()
    by_hand = {d: licenses_by_hand(t) for d, t in rows}
    assert {r.doc_id: set(filter(None, r.licenses.split(","))) for r in found} == by_hand
    got = E.queries()["op2_jaccard_join"](spark, SF).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(g) for g in got), key=str) == classes_by_hand(rows)
    assert "op5_substring_dedup" in E.oracle_sql()
