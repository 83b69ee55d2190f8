"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# White space as the contracts define it.
WS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder (a folder for each value of ``by``) and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that reads them is written itself."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(conf).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Have the driver look for shuffles that nothing refers to any more, whose files Spark's cleaner then deletes: else they stay until it happens to."""
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with no column of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def content_key(col: str | Column = "text") -> Column:
    """128-bit key of a whole text; results that depend on the text alone are joined on it."""
    return F.md5(text_of(col))


def ws_words(text: Column) -> Column:
    """Words of a text: maximal runs without white space, unchanged."""
    return F.array_remove(F.split(text, WS + "+"), "")


def n_words(text: Column) -> Column:
    """How many words ``ws_words`` finds, without building them: each run becomes one character."""
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(runs, WS + "+", "")).cast("long")


def global_row_numbers(df: DataFrame, order: list[Column], out: str) -> tuple[DataFrame, int]:
    """``df`` with a gapless number from 0 in the given order, and the number of rows.

    No task sees all rows: rows are dealt by range, numbered inside each
    partition, and shifted by the rows of the partitions before. The numbered
    rows are written once, so that a retried task cannot change a number. Rows
    that are equal in ``order`` should be equal altogether, else the number
    among them is free.
    """
    mid, pid, base = fresh(df, "_mid", "_pid", "_base")
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumn(mid, F.monotonically_increasing_id()), "row-numbers")
    rows = rows.withColumn(pid, F.shiftright(mid, 33))
    counts = stored(rows.groupBy(pid).agg(F.count("*").alias("_n")), "row-offsets")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # One row for each partition: its bound is the number of shuffle partitions, hence the broadcast.
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(pid, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    numbered = rows.join(F.broadcast(offsets), pid).withColumn(
        out, F.col(base) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    )
    return numbered.drop(mid, pid, base), total
