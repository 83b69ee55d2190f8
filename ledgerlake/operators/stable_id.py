"""Order-free stable transaction ids (T9, T10; Appendix N1 of the survey).

The source hashes ``date_time|category|account|amount|tags|row index`` and
keeps the first 24 hex digits of SHA-256. A distributed frame has no row index,
and an index makes ids shift when a row is inserted earlier in the file. Here
the index is replaced by the occurrence number of the row among the rows with
the same hashed text: ``sha256(content|occ)[:24]`` with occ = 0..copies-1.
The *set* of ids therefore depends only on the multiset of rows, never on
their order, partitioning or the number of tasks; true repeats still get
distinct ids, as in the source.

Plan, built for a skewed input (one group of copies may hold a third of all rows):

1. ``groupBy(content, other columns).count()``: map-side partial aggregation
   collapses copies before the shuffle, so a hot group costs one row per map task.
2. Per content text, copies are numbered by a running sum over the (few)
   distinct variants that share it (e.g. two currencies, or two tuples whose
   ``|``-joined text coincides), ordered by the variant's columns.
3. Rows are regenerated with ``explode(sequence(...))``. A variant with more
   than ``chunk_rows`` copies is first split into chunks that are spread over
   tasks by an explicit repartition, so no task generates more than
   ``chunk_rows`` rows of one group; small variants are exploded in place.

Because every (content, occ) pair is distinct, ids collide only on a 96-bit
hash collision; the source's keep-first de-duplication by id is therefore a
no-op and is offered as an option (it costs a shuffle of all rows).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_HEX_CHARS = 24
DEFAULT_CHUNK_ROWS = 100_000


def id_expr(content: Column, occ: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", content, occ.cast("string")), 256), 1, ID_HEX_CHARS)


def number_copies(df: DataFrame, content_col: str, variant_cols: Sequence[str], chunk_rows: int = DEFAULT_CHUNK_ROWS,
                  hot_partitions: int | None = None) -> DataFrame:
    """One output row per input row with ``occ`` = 0..n-1 among rows sharing ``content_col``.

    ``variant_cols`` are all other columns to keep; rows equal in content and
    variant columns are interchangeable, so only their count travels.
    """
    counts = df.groupBy(content_col, *variant_cols).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(content_col).orderBy(*[F.col(c).asc_nulls_first() for c in variant_cols]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = counts.withColumn("_start", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    keep = [content_col, *variant_cols]

    small = counts.where(F.col("_cnt") <= chunk_rows).select(
        *keep, "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cnt") - 1)).alias("_i")
    )
    hot = counts.where(F.col("_cnt") > chunk_rows)
    n_parts = hot_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = hot.select(
        *keep, "_start", "_cnt",
        F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_cnt") / F.lit(chunk_rows)) - 1)).alias("_chunk"),
    ).repartition(n_parts, content_col, "_chunk")
    lo = F.col("_chunk") * F.lit(chunk_rows)
    hi = F.least(F.col("_cnt"), lo + F.lit(chunk_rows)) - 1
    hot_rows = chunks.select(*keep, "_start", F.explode(F.sequence(lo, hi)).alias("_i"))
    both = small.unionByName(hot_rows)
    return both.select(*keep, (F.col("_start") + F.col("_i")).alias("occ"))


def assign_stable_ids(df: DataFrame, hashed_cols: Sequence[str], other_cols: Sequence[str] = (),
                      id_col: str = "transaction_id", chunk_rows: int = DEFAULT_CHUNK_ROWS,
                      drop_duplicate_ids: bool = False) -> DataFrame:
    """Add ``id_col`` = first 24 hex of sha256(hashed_cols joined by '|' + '|' + occurrence).

    ``hashed_cols`` must be text columns (their text is what is hashed);
    ``other_cols`` are carried unchanged.
    """
    content = F.concat_ws("|", *[F.col(c) for c in hashed_cols]).alias("_content")
    base = df.select(content, *hashed_cols, *other_cols)
    numbered = number_copies(base, "_content", [*hashed_cols, *other_cols], chunk_rows)
    out = numbered.select(id_expr(F.col("_content"), F.col("occ")).alias(id_col), *hashed_cols, *other_cols)
    if drop_duplicate_ids:
        out = out.dropDuplicates([id_col])
    return out
