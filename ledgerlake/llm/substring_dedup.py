"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are factored relative to all earlier ones (smaller doc_id). The index
of reference blocks is built in two steps, so that text that occurs once never
leaves its document:
1. Anchors: of the ``GRAM``-word hashes in a window of ``WINDOW`` words the
   least is the window's anchor; equal windows have equal anchors. Documents
   are scanned for anchors, and anchors that more than one document has are kept.
2. Windows whose anchor is kept are reference blocks: they are indexed by their
   hash with the earliest document that has them.
Each document is then parsed greedily from left to right: a factor begins at
the first word whose window an earlier document has, and goes on as long as the
next word's window is indexed under the same document. So every factor has at
least ``WINDOW`` words and refers to one document. Where the next window is
indexed under another document, a new factor begins one word on and overlaps the
last: the windows across a factor's boundary are looked up like all others, and
no duplicate hides there. Factors are the duplicate spans.

Documents whose words all equal those of an earlier one are one factor and need
no parse. Windows are keyed by 96 bits: 64 of one word hash and 32 of an independent one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, text_of
from .shingles import SECOND, hashed_words, rolled, row_of, small, whole

WINDOW = 13
GRAM = 7

SPANS = "array<struct<start:bigint,end:bigint,source:bigint>>"


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, offsets, and for every place its window's anchor and whether the window lies in one text."""
    words, offsets = hashed_words(column)
    inside = whole(offsets, WINDOW)
    least = rolled(words, GRAM)
    span, n = 1, WINDOW - GRAM + 1
    while span < n:  # least of ever longer runs of grams
        step = min(span, n - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return words, offsets, least[: len(inside)], inside


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the distinct anchors of its windows."""
    for batch in small(batches):
        _, offsets, least, inside = _windows(batch.column("text"))
        rows, least = row_of(offsets)[: len(inside)][inside], least[inside]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (least[1:] != least[:-1])
        rows, least = rows[new], least[new]
        order = np.lexsort((least, rows))
        rows, least = rows[order], least[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (least[1:] != least[:-1])
        rows, least = rows[new], least[new]
        at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(least.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), lists], names=["doc", "anchors"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reference blocks: (h, c, doc, rn, at) for every window whose anchor is kept."""
    for batch in small(batches):
        words, offsets, least, inside = _windows(batch.column("text"))
        kept = batch.column("anchors").flatten().to_numpy().view(np.uint64)
        at = np.flatnonzero(inside & np.isin(least, np.unique(kept)))
        rows = row_of(offsets)[at]
        h = rolled(words, WINDOW)[at]
        twin, _ = hashed_words(batch.column("text"), seed=SECOND)
        c = (rolled(twin, WINDOW)[at] >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, max(len(at), 1), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[part].view(np.int64)), pa.array(c[part].view(np.int32)),
                    batch.column("doc").take(pa.array(rows[part])), batch.column("rn").take(pa.array(rows[part])),
                    pa.array((at[part] - offsets[rows[part]]).astype(np.int32)),
                ],
                names=["h", "c", "doc", "rn", "at"],
            )


def parsed(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy factors (start, end, source) from the sorted (place, source) of indexed windows."""
    factors: list[list[int]] = []
    for at, source in places:
        if factors and at == factors[-1][3] + 1 and source == factors[-1][2]:
            factors[-1][1], factors[-1][3] = at + WINDOW, at
        else:
            factors.append([at, at + WINDOW, source, at])
    return [(a, b, s) for a, b, s, _ in factors]


def kept_words(words: list, factors: list[tuple[int, int, int]]) -> list:
    """The words outside of all factors (sorted by start, may overlap)."""
    out, at = [], 0
    for start, end, _ in factors:
        out += words[at:start] if start > at else []
        at = max(at, end)
    return out + words[at:]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        shas, removed, spans, kept = [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            words = (text or "").encode().split()
            factors = parsed(sorted((f["at"], f["source"]) for f in found))
            rest = kept_words(words, factors)
            shas.append(_sha(words))
            removed.append(len(words) - len(rest))
            kept.append(_sha(rest))
            spans.append([{"start": a, "end": b, "source": s} for a, b, s in factors])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(shas, pa.string()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)],
            names=["doc", "sha", "n_removed", "kept", "spans"],
        )


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("doc"), pa.array([len(w) for w in words], pa.int64()), pa.array([_sha(w) for w in words], pa.string())],
            names=["doc_id", "doc", "n_words", "sha"],
        )


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_words, spans, n_removed, kept_sha256, sha256.

    Needs doc_id (an integer) and text; other columns are not read. Words are
    runs without white space. spans are the factors as (start, end, source) in
    words, source a doc_id smaller than the row's; n_removed the words that they
    cover; kept_sha256 the digest of the other words joined by blanks, sha256
    that of all words. A null doc_id comes after all others, and no row is
    earlier than another of the same id; null texts have no words; texts under
    ``WINDOW`` words are never removed. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select("doc_id", doc.alias("doc"), text_of().alias("text"))
    sizes = stored(rows.mapInArrow(_sizes, f"doc_id {kind}, doc long, n_words long, sha string"), "text-sizes")
    first = sizes.groupBy("sha").agg(F.min("doc").alias("first"))
    marked = sizes.join(first, "sha").withColumn("copy", (F.col("first") < F.col("doc")) & (F.col("n_words") >= WINDOW))
    plain, sizes = sizes, stored(marked, "text-copies")
    dropped(spark, plain)

    # 1. Anchors that more than one document has, and which of them each document has.
    texts = rows.select("doc", "text")
    anchors = texts.mapInArrow(_anchors, "doc long, anchors array<bigint>").select("doc", F.explode("anchors").alias("a"))
    common = stored(anchors.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "anchors")
    copies = sizes.groupBy("doc").agg(F.min(F.col("copy").cast("int")).alias("all")).filter("all = 1").select("doc")
    own = anchors.join(common, "a").groupBy("doc").agg(F.collect_set("a").alias("anchors"))
    own = stored(own.join(copies, "doc", "left_anti"), "document-anchors")
    dropped(spark, common)
    blocks_of = stored(texts.join(own.hint("shuffle_hash"), "doc").withColumn("rn", F.monotonically_increasing_id()), "factored-texts")
    dropped(spark, own)

    # 2. Reference blocks, and the earliest document of each.
    blocks = blocks_of.mapInArrow(_blocks, "h long, c int, doc long, rn long, at int")
    index = blocks.groupBy("h", "c").agg(F.min("doc").alias("source"), F.count("*").alias("n")).filter("n > 1").drop("n")
    index = stored(index, "reference-blocks")
    found = blocks.join(index, ["h", "c"]).filter("source < doc")
    found = found.groupBy("rn").agg(F.collect_list(F.struct("at", "source")).alias("found"))

    # The parse, for documents with at least one indexed window.
    factored = blocks_of.select("doc", "rn", "text").join(found, "rn").mapInArrow(
        _parse, f"doc long, sha string, n_removed long, kept string, spans {SPANS}"
    )
    factored = stored(factored.dropDuplicates(["doc", "sha"]), "factors")
    dropped(spark, index, blocks_of)
    out = sizes.join(factored, ["doc", "sha"], "left")
    whole_text = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("first").alias("source")))
    none = F.array().cast(SPANS)
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), whole_text).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_sha([]))).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.col("sha").alias("sha256"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The words of a text outside of its spans, joined by blanks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    inside = lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
    return F.array_join(F.filter(words, lambda _, i: ~inside(i)), " ")
