"""N-gram Jaccard join by an LSH forest, with exact verification.

A document is the set of its five-word shingles. Words are runs of ASCII letters
and digits (in lower case) and of other characters from U+0080. Documents with equal sets are
one item. Each of ``TREES`` tries holds every item under a label of ``DEPTH``
MinHash values. Two items of similarity s share the first x values of a label
with probability s**x, so x is shortened from ``DEPTH`` until the recall
1 - (1 - s**x)**TREES at the threshold reaches ``RECALL``.

Candidates are compared from long prefixes to short ones:
1. in every group of one full label, an item is compared with the group's first
   item; links join items into classes;
2. the same over the shortened prefixes, with items of other classes;
3. in every group under a shortened prefix that still holds several classes,
   all items are compared with each other, block by block inside of tasks; only
   links that join two classes leave a task.
So no candidate pair is left out: pairs that are not compared are in one class.
Number of links of an item: all members of its class that it resembles,
counted block by block in the same way. A block has about ``BLOCK`` items,
whatever the size of a group or class. All comparisons are exact, on sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, fresh, stored
from .shingles import LETTERS, hashed_words, mixed, odd_factors, rolled, row_of, shingle_set, small, whole

SHINGLE = 5
TREES, DEPTH = 24, 8
RECALL = 0.995
SIMILAR = (4, 5)  # the threshold, 4/5
BLOCK = 256

_ODD = odd_factors(TREES * DEPTH, 0xBF58476D1CE4E5B9)


def levels() -> list[int]:
    """Prefix lengths that are joined: the full label, and the longest that reaches the recall."""
    s = SIMILAR[0] / SIMILAR[1]
    reach = next(x for x in range(DEPTH, 0, -1) if 1 - (1 - s**x) ** TREES >= RECALL or x == 1)
    return [DEPTH, reach] if reach < DEPTH else [DEPTH]


def _sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), sorted and distinct, of all texts of a batch."""
    rows = row_of(offsets)
    inside = whole(offsets, SHINGLE)
    at, sh = rows[: len(inside)][inside], rolled(values, SHINGLE)[inside]
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        at = np.concatenate([at, short])
        sh = np.concatenate([sh, [rolled(values[offsets[r] : offsets[r + 1]], size[r])[0] for r in short]])
    order = np.lexsort((sh, at))
    at, sh = at[order], sh[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (sh[1:] != sh[:-1])
    return at[new], sh[new]


def _label(batches: Iterator[pa.RecordBatch], names: list[str], depths: list[int]) -> Iterator[pa.RecordBatch]:
    """For each row: two digests of its set, its size, and per level the prefix hash in every tree."""
    for batch in small(batches):
        values, offsets = hashed_words(batch.column("text"), LETTERS)
        at, sh = _sets(values, offsets)
        full, starts, counts = np.unique(at, return_index=True, return_counts=True)
        n = np.zeros(batch.num_rows, np.int64)
        d1, d2 = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        prefix = {x: np.zeros((batch.num_rows, TREES), np.uint64) for x in depths}
        if len(full):
            n[full] = counts
            d1[full] = np.add.reduceat(mixed(sh), starts)
            d2[full] = np.bitwise_xor.reduceat(mixed(sh ^ np.uint64(0x5851F42D4C957F2D)), starts)
            for tree in range(TREES):
                h = np.full(len(full), tree + 1, np.uint64)
                for depth in range(DEPTH):
                    h = mixed(h * np.uint64(31) + np.minimum.reduceat(sh * _ODD[tree * DEPTH + depth], starts))
                    if depth + 1 in prefix:
                        prefix[depth + 1][full, tree] = h
        lists = [
            pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * TREES + 1, TREES), pa.int32()), pa.array(p.ravel().view(np.int64)))
            for p in prefix.values()
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n), *lists], names=names
        )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of at least the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, "ta"):
        sides = []
        for name in ("ta", "tb"):
            values, offsets = hashed_words(batch.column(name), LETTERS)
            sides.append([shingle_set(values[i:j], SHINGLE) for i, j in zip(offsets, offsets[1:], strict=False)])
        keep = pa.array([similar(a, b) for a, b in zip(*sides, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _alike(items: pd.DataFrame) -> np.ndarray:
    """Which pairs of two blocks of items (or of one block and itself) are similar."""
    values, offsets = hashed_words(pa.array(items["text"], pa.string()), LETTERS)
    sets = [shingle_set(values[i:j], SHINGLE) for i, j in zip(offsets, offsets[1:], strict=False)]
    size = np.array([len(s) for s in sets])
    sh, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(sh, kind="stable")
    sh, at = sh[order], at[order]
    column = np.cumsum(np.concatenate([[0], sh[1:] != sh[:-1]])) if len(sh) else np.empty(0, np.int64)
    shared = np.bincount(column)[column] > 1  # a shingle of one item alone is in no intersection
    column, at = np.unique(column[shared], return_inverse=True)[1], at[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, 8192):  # so many shingles at a time
        i, j = np.searchsorted(column, [lo, lo + 8192])
        has = np.zeros((len(sets), 8192), np.float32)
        has[at[i:j], column[i:j] - lo] = 1
        both += has @ has.T
    alike = both * SIMILAR[1] >= SIMILAR[0] * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(alike, False)
    if items["i"].iloc[0] != items["j"].iloc[0]:  # pairs inside a block are compared where it meets itself
        block = items["block"].to_numpy()
        alike &= block[:, None] != block[None, :]
    return alike


def _degrees(items: pd.DataFrame) -> pd.DataFrame:
    """Links of every item of one block with the texts of the items of another (or of the same)."""
    return pd.DataFrame({"id": items["id"], "links": _alike(items).astype("int64") @ items["texts"].to_numpy()})


def _bridges(items: pd.DataFrame) -> pd.DataFrame:
    """Links that join classes: at most one less than there are classes."""
    label = items["label"].to_numpy()
    a, b = np.nonzero(np.triu(_alike(items) & (label[:, None] != label[None, :])))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    links = []
    for i, j in zip(a, b, strict=True):
        x, y = top(int(label[i])), top(int(label[j]))
        if x != y:
            up[x] = y
            links.append((i, j))
    at = np.array(links, np.int64).reshape(-1, 2)
    ids = items["id"].to_numpy()
    return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})


def _dealt(members: DataFrame, group: str, texts: DataFrame) -> DataFrame:
    """Members (group, blocks, id, label) with their texts, once for every pair of blocks (i, j) of their group."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    names = dict.fromkeys([group, "id", "label", "block", "text", "texts"])  # the group may be the label itself
    meets = members.withColumn("block", block).join(texts, "id").select(
        *names, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    )
    return meets.select(*names, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the component of every node of ``edges`` (a, b)."""
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.least("label", "near").alias("label"), F.col("label").alias("old")
        )
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        step = stored(step.join(up, "label").select("id", F.least("label", "above").alias("label"), "old"), "labels")
        labels = step.select("id", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def _picked(buckets: DataFrame, prefix: str) -> DataFrame:
    """For every item, the least item of another class that leads one of its groups: pairs (a, b)."""
    lead = F.min(F.struct("label", "id")).alias("lead")
    leads = buckets.groupBy(prefix).agg(lead)
    other = buckets.join(leads, prefix).filter(F.col("label") != F.col("lead.label"))
    return other.groupBy("id").agg(F.min("lead").alias("lead")).select(F.col("lead.id").alias("a"), F.col("id").alias("b"))


def _across(buckets: DataFrame, prefix: str, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of every group that holds several; buckets: (prefix, id, label)."""
    sizes = buckets.groupBy(prefix).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    several = sizes.filter("lo <> hi").select(prefix, "blocks")
    members = buckets.select(prefix, "id", "label").join(several, prefix)
    return _dealt(members, prefix, texts).groupBy(prefix, "i", "j").applyInPandas(_bridges, "a bigint, b bigint").distinct()


def similarity_classes(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: doc_id, key, class_id, keeps, n_links, n_shingles.

    Needs doc_id and text; other columns are not read. key is the digest of the
    text. class_id is the least doc_id (nulls last) among the rows of all items
    that links connect; ``keeps`` marks the row that stands for the class (all
    rows equal to it in doc_id and text are marked). n_links counts the other
    texts of similarity 0.8 or more, each once however many rows have it; texts
    that differ but have equal shingle sets are linked. Texts of one
    to four words are one shingle; texts without words are one item without
    links. An empty table gives an empty one.
    """
    depths = levels()
    last = f"p{depths[-1]}"
    light = docs.select("doc_id", content_key().alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "key", "d1", "d2", "n", *[f"p{x}" for x in depths]]
    lists = ", ".join(f"p{x} array<bigint>" for x in depths)
    rows = stored(
        light.mapInArrow(lambda b: _label(b, columns, depths), f"doc_id {kind}, key string, d1 bigint, d2 bigint, n bigint, {lists}"),
        "shingle-sets",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    digests = ["d1", "d2", "n"]
    items = rows.groupBy(*digests).agg(first, *[F.first(f"p{x}").alias(f"p{x}") for x in depths])
    texts_of = rows.groupBy(*digests, "key").agg(F.lit(1).alias("_")).groupBy(*digests).agg(F.count("*").alias("texts"))
    items = stored(items.join(texts_of, digests).withColumn("id", F.monotonically_increasing_id()), "items")
    names = items.select(*digests, "id", "first", "texts")

    # The tries: only groups of at least two items under a shortened prefix matter.
    tries = items.filter("n > 0").select("id", F.explode(F.arrays_zip(*[f"p{x}" for x in depths])).alias("p")).select("id", "p.*")
    many = tries.groupBy(last).agg(F.count("*").alias("n")).filter("n > 1").select(last)
    groups = stored(tries.join(many, last), "prefix-groups")
    near = groups.select("id").distinct()
    chosen = items.join(near, "id").select("id", "first.doc_id", "first.key", "texts")
    found = docs.select("doc_id", content_key().alias("key"), "text").alias("d").join(
        chosen.alias("c"), (F.col("d.key") == F.col("c.key")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
    )
    texts = stored(found.select("id", "text", "texts").dropDuplicates(["id"]), "near-texts")

    def linked(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_verify, "a bigint, b bigint")

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return groups.withColumn("label", F.col("id"))
        return groups.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))

    edges, labels = None, None
    for x in depths:
        more = linked(_picked(labelled(labels), f"p{x}"))
        edges = stored(more if edges is None else edges.union(more), "links")
        labels = components(edges)
    edges = stored(edges.union(_across(labelled(labels), last, texts)), "links")
    labels = components(edges)

    # Links inside each class, block against block.
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    counted = _dealt(labels.join(sizes, "label"), "label", texts).groupBy("label", "i", "j").applyInPandas(
        _degrees, "id bigint, links bigint"
    )
    links = counted.groupBy("id").agg(F.sum("links").alias("n_links"))

    of = names.join(labels, "id", "left").join(links, "id", "left").withColumn("label", F.coalesce("label", "id"))
    of = stored(of, "classes")
    head = of.groupBy("label").agg(F.min("first").alias("head"))
    own = F.when(F.col("n") > 0, F.col("texts") - 1).otherwise(0)
    answer = of.join(head, "label").select("d1", "d2", "n", "head", (F.coalesce("n_links", F.lit(0)) + own).alias("n_links"))
    keeps = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key"))
    return rows.join(answer, ["d1", "d2", "n"]).select(
        "doc_id", "key", F.col("head.doc_id").alias("class_id"), keeps.alias("keeps"), "n_links", F.col("n").alias("n_shingles")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class: the least doc_id, once if the row is repeated."""
    key, kept_id, kept_key = fresh(docs, "_key", "_kept_id", "_kept_key")
    kept = similarity_classes(docs).filter("keeps").select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)).distinct()
    keyed = docs.withColumn(key, content_key())
    on = (F.col(key) == F.col(kept_key)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    return keyed.join(stored(kept, "kept"), on, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
