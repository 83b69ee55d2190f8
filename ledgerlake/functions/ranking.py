"""Ranks and running sums over a whole table, without one task that sees all of it.

Rows are dealt by range, so every partition holds one stretch of the order, and
numbered inside it. What precedes a partition is one number; those offsets, one
row for each shuffle partition, are summed up on the driver and added back. The
dealt rows are written to the shared folder first, so that a retried task cannot
change a number.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_weight(df: DataFrame, order: Sequence[Column | str], weight: str | None = None, out: str = "before") -> tuple[DataFrame, int]:
    """``df`` with ``out``, the weight (1 without a column) of all rows before a row in the order; and the weight of all.

    Rows that are equal in ``order`` follow each other in any way. Weights are whole numbers.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(dealt, "ranks").withColumn("_part", F.shiftright("_at", 33))
    one = F.lit(1) if weight is None else F.col(weight)
    sums = sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.sum(one).cast("long")).collect())  # a row a partition
    offsets, total = [], 0
    for part, s in sums:
        offsets.append((part, total))
        total += s
    if weight is None:
        inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        stretch = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(stretch), F.lit(0))
    rows = rows.withColumn("_inside", inside)
    known = F.broadcast(spark.createDataFrame(offsets, "_part long, _offset long"))  # as many rows as shuffle partitions
    return rows.join(known, "_part").withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long")).drop(
        "_part", "_at", "_inside", "_offset"), total


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """``df`` with its place in the order, from 1."""
    rows, _ = running_weight(df, order, out=out)
    return rows.withColumn(out, (F.col(out) + 1).cast("int"))
