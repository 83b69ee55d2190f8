"""Mixing sources to target sizes by repetition.

Sizes are summed by source; every source gets a target from its weight, and
target / size is its repetition rate. A document is emitted floor(rate) times,
and once more with probability equal to the fraction, drawn from a seeded hash
of its id, so that reruns agree.

Targets: a share of the summed size is dealt by weight; a source stops at
``limit`` times its size, and the excess is dealt again by weight among the
others until none is above its limit. One round of that is one aggregate over
the table of sources, of which only three numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, global_row_numbers, n_words, stored, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"


def source_targets(
    docs: DataFrame, size: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, take the weights in turn.

    ``size`` names a long column of ``docs``. A source of size 0 has target 0;
    no rows give no rows.
    """
    sizes = docs.groupBy("source").agg(F.sum(size).alias("source_size"))
    ordered, _ = global_row_numbers(sizes, [F.col("source").isNull(), F.col("source")], "_at")
    turn = F.pmod("_at", F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    table = stored(ordered.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.lit(limit) * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    goal = min(share, limit) * total
    unit, full = 0.0, -1  # size for each unit of weight; sources at their limit
    while total:
        above = cap < F.lit(unit) * F.col("weight")
        spent, n_full, free = table.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n_full == full or not free:
            break
        full, unit = n_full, (goal - spent) / free
    return table.select(
        "source", "source_size", F.least(cap, F.lit(unit) * F.col("weight")).alias("target")
    )


def draw(seed: str) -> Column:
    """A number in [0, 1) from the document's id (from its text where the id is null)."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of()))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), who)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_copies(docs: DataFrame, weights: tuple[int, ...], share: float, limit: float, seed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with size, source_size, target and copies, under names that clash with no column."""
    size, source_size, target, copies, key, u, rate = fresh(
        docs, "size", "source_size", "target", "copies", "_source", "_draw", "_rate"
    )
    sized = docs.withColumn(size, n_words(text_of()))
    targets = source_targets(sized, size, weights, share, limit).select(
        F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target)
    )
    rated = (
        sized.withColumn(u, draw(seed))
        .join(targets, F.col("source").eqNullSafe(F.col(key)))
        .withColumn(rate, F.coalesce(F.try_divide(target, source_size), F.lit(0.0)))
    )
    extra = (F.col(u) < F.col(rate) - F.floor(rate)).cast("long")
    return rated.withColumn(copies, F.floor(rate) + extra).drop(key, u, rate), [size, source_size, target, copies]


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, one row per document.

    size is the number of words (null text: 0). Needs doc_id, text and source;
    columns of the four names are replaced. Repeated rows draw alike. An empty
    table gives an empty one. The table of sources is joined back: Spark
    broadcasts it if its files are below the session's threshold, and splits hot
    sources otherwise.
    """
    return _with_copies(docs.drop("size", "source_size", "target", "copies"), weights, share, limit, seed)[0]


def emitted(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    mix, (*_, copies) = _with_copies(docs, weights, share, limit, seed)
    (at,) = fresh(mix, "_copy")
    return mix.filter(F.col(copies) > 0).withColumn(at, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
