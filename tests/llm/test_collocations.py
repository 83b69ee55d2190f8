"""Dynamic itemset counting against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlake.llm import collocations


def brute(rows, threshold, longest=5, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {p: n for p, n in f.items() if n >= threshold}
    covered = set()
    for (lang, w), n in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if n >= f[lang, w[i : i + m]]:
                    covered.add((lang, w[i : i + m]))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in covered:
            cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, phrases in found.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def corpus(n, seed, words="a b c d e f g h ä ö Ünter".split(), marks=" , . ! \t"):
    r = random.Random(seed)
    passage = "red Green blue white black grey"
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            w.insert(r.randint(0, len(w)), passage)
        text = "".join(x + (r.choice([". ", ",", "\n", "\t", "  "]) if r.random() < 0.15 else " ") for x in w)
        rows.append((r.choice(["en", "en", "de", None, "und"]), text))
    return rows


def run(spark, rows, parts=4, **options):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'y' as phrase", "2 as shard")
    out = collocations.collocations(df.repartition(parts), **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("shards,threshold", [(1, 4), (3, 7), (4, 20)])
def test_equals_counting_every_phrase(spark, shards, threshold):
    rows = corpus(120, shards)
    assert run(spark, rows, threshold=threshold, shards=shards) == brute(rows, threshold)


def test_crowded_slots_change_nothing(spark, monkeypatch):
    """With 16 slots nearly every phrase shares one with a frequent phrase."""
    monkeypatch.setattr(collocations, "LEAST_SLOT_BITS", 4)
    monkeypatch.setattr(collocations, "MOST_SLOT_BITS", 4)
    rows = corpus(100, 11)
    assert run(spark, rows, threshold=6, shards=3) == brute(rows, 6)


def test_top_is_cut_by_language_and_ties_by_phrase(spark):
    rows = corpus(150, 5)
    assert run(spark, rows, threshold=5, shards=2, top=3) == brute(rows, 5, top=3)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "x y. X Y z"), ("und", "x y"), ("en", None), ("en", ""), ("en", " \t\n.,!"), ("de", "x y")] * 3
    assert run(spark, rows, threshold=3) == brute(rows, 3)
    assert run(spark, [], threshold=1) == []
    assert run(spark, [("en", None)], threshold=1) == []


def test_long_texts_and_long_words(spark):
    rows = [("en", "long" * 3000 + " tail " + "go on and on " * 20_000), ("en", "long" * 3000 + " tail")]
    assert run(spark, rows, threshold=2, parts=1) == brute(rows, 2)


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 2**63; the digits must be exact."""
    df = spark.createDataFrame([(123_456_789_012_345, 9_876_543_210_987, 3, 7)], "a long, total long, l long, r long")
    got = df.selectExpr(
        "cast(cast(a as decimal(19,0)) * cast(total as decimal(19,0)) * 1000 as decimal(38,0)) "
        "div (cast(l * 1000000000 as decimal(19,0)) * cast(r * 1000000000 as decimal(19,0))) as s"
    ).first()["s"]
    assert got == 1000 * 123_456_789_012_345 * 9_876_543_210_987 // (3 * 7 * 10**18)


def test_hashes_tell_languages_and_pieces_apart():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": ["a b. a b", "a b"]})
    words = collocations.Words(batch)
    assert len(set(words.code.tolist())) == 4
    assert words.linked.tolist() == [True, False, True, False, True]
    assert np.array_equal(words.rows, [0, 0, 0, 0, 1, 1])


def test_phrases_are_handed_on_in_parts(spark, monkeypatch):
    """A task that hands its phrases on again and again counts the same; languages and long texts included."""
    monkeypatch.setattr(collocations, "HELD", 50)
    rows = corpus(200, 17) + [("en", "x y " * 400), (None, None), ("de", "Ä ä x Y")]
    assert run(spark, rows, parts=1, threshold=4, shards=2) == brute(rows, 4)


def test_spelling_sorts_about_as_often_as_phrases_occur(monkeypatch):
    """Not all phrases of the task again for every batch of texts."""
    import pyarrow as pa

    class Slots:
        value = np.ones(1 << 16, np.uint8)

    r, n = random.Random(3), [0]
    argsort, lexsort = np.argsort, np.lexsort

    def counted(x, *args, **named):
        n[0] += len(x[0]) if isinstance(x, tuple) else len(x)
        return (lexsort if isinstance(x, tuple) else argsort)(x, *args, **named)

    monkeypatch.setattr(np, "argsort", counted)
    monkeypatch.setattr(np, "lexsort", counted)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(1500)) for _ in range(40)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [t]}) for t in texts]
    found = pa.Table.from_batches(list(collocations._spelled(iter(batches), 5, Slots))).to_pylist()
    places = sum(1500 - k + 1 for k in range(1, 6)) * 40
    assert sum(x["n"] for x in found if x["k"] > 0) == places
    assert [x["n"] for x in found if x["k"] == 0] == [60_000]
    assert n[0] <= 4 * places
