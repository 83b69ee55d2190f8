"""Exact deduplication and benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from documents_fixture import docs_of  # noqa: F401
from ledgerlake.llm import decontaminate, exact_dedup
from ledgerlake.session import scratch_path

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    out = []
    for t, rs in groups.items():
        best = min(rs, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept = False
        for r in rs:
            mine = not kept and r == best
            kept |= mine
            out.append((r[0], best[0], len(rs), mine, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\x0b b\n"), (5, None), (6, ""), (7, " \t"), (8, "é x"), (9, "éx"),
        (None, "q"), (10, "q"), (11, "long " * 20_000), (12, "long" * 20_000), (13, "z"), (13, "z"), (None, "n"), (None, "n")]


def test_exact_dedup_of_awkward_rows(spark, docs_of):
    path = scratch_path(spark, "docs")
    docs_of(ROWS).repartition(3).write.parquet(path)
    got = exact_dedup.exact_dedup(spark, path).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(ROWS)
    empty = scratch_path(spark, "none")
    docs_of([]).write.parquet(empty)
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


def test_state_goes_on_with_new_files(spark, docs_of):
    path, folder = scratch_path(spark, "grow"), scratch_path(spark, "state")
    docs_of([(5, "a b"), (6, "c")]).write.parquet(path)
    assert exact_dedup.exact_dedup(spark, path, folder).filter("kept").count() == 2
    docs_of([(4, "ab"), (3, "c  "), (9, "d")]).write.mode("append").parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, path, folder).collect()}
    assert got == {5: (5, 2), 4: (5, 2), 6: (3, 2), 3: (3, 2), 9: (9, 1)}


def test_digests_that_clash_are_told_apart_by_bytes(spark, docs_of, monkeypatch):
    real = exact_dedup._rows
    monkeypatch.setattr(exact_dedup, "_rows", lambda docs: real(docs).withColumn("text_sha256", F.lit("same")))
    path = scratch_path(spark, "clash")
    docs_of([(1, "a"), (2, "a "), (3, "b"), (4, "c"), (5, "b")]).write.parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 2, True), 5: (3, 2, False), 4: (4, 1, True)}


def windows(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, {tuple(w[i : i + min(len(w), 10)]) for i in range(max(len(w) - 9, 1))} if w else set()


def contaminated_by_hand(docs, items):
    out = []
    wins = [(i, windows(t)[1]) for i, t in items]
    for d, t in docs:
        w, _ = windows(t)
        hit, names = set(), set()
        for i, ws in wins:
            for win in ws:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        names.add(str(i) if i is not None else "null")
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_contamination_equals_brute_force(spark, docs_of, seed):
    r = random.Random(seed)
    vocab = ["a", "B", "Éa", "éa", "of", "the", "x9", "ß"]
    text = lambda n: r.choice([" ", ", ", "\x00"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(None, text(10)), (3, ""), (4, None), (10, "of the x9 of of the a b a b zz")]
    docs = [(i, text(r.randint(0, 60))) for i in range(25)]
    docs += [(100 + k, f"{text(4)} {t} {text(3)}".upper() if k % 2 else t) for k, (_, t) in enumerate(items)]
    docs += [(None, items[5][1]), (7, docs[7][1]), (8, None), (9, "")]
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("key", F.lit("x"))
    got = decontaminate.contamination(docs_of(docs), table).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_hit, list(g.item_ids)) for g in got), key=str) == contaminated_by_hand(docs, items)
    clean = decontaminate.decontaminated(docs_of(docs), table)
    want = sorted((str(d) for d, _, n, _ in contaminated_by_hand(docs, items) if not n))
    assert sorted(str(x.doc_id) for x in clean.collect()) == want and clean.columns == docs_of(docs).columns


def test_contamination_of_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert decontaminate.contamination(docs_of([]), items).count() == 0
    got = decontaminate.contamination(docs_of([(1, "a b c")]), items.limit(0)).collect()
    assert [(g.doc_id, g.n_hit) for g in got] == [(1, 0)]
    assert decontaminate.decontaminated(docs_of([(1, "a b c"), (2, None)]), items.limit(0)).count() == 2


def test_queries_cover_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for q in ("op7_mix_sources", "op8_decontaminate", "op9_exact_dedup"):
        assert E.queries()[q](spark, SF).count() == n and q in E.oracle_sql()


def test_filter_grows_with_the_benchmark(spark):
    """200,000 shingles: of other places few pass."""
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    table = decontaminate._filter_of(hashes)
    assert len(table) == 1 << 22
    passed = spark.range(200_000, 300_000).select(F.xxhash64("id").alias("h")).filter(decontaminate._wanted(F.col("h"), table)).count()
    assert passed < 1000
    assert hashes.filter(decontaminate._wanted(F.col("h"), table)).count() == 200_000


def test_large_benchmark(docs_of, spark):
    words = [f"w{i}" for i in range(4000)]
    items = spark.createDataFrame([(i, " ".join(words[(i * 7 + j * (i % 13 + 1)) % 4000] for j in range(12))) for i in range(20_000)], "item_id long, text string")
    docs = docs_of([(1, "x " + " ".join(words[(700 + j * 10) % 4000] for j in range(10)) + " y"), (2, " ".join(words[:9])), (3, None)])
    got = {r.doc_id: (r.n_hit, len(r.item_ids) > 0) for r in decontaminate.contamination(docs, items).collect()}
    assert got[1] == (10, True) and got[2] == (0, False) and got[3] == (0, False)
