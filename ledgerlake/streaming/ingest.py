"""Incremental ingestion with Structured Streaming.

X1 ``start_append_dedup``: rows arrive as files and the first row of every key
is appended. The keys seen are keyed state of the stream (RocksDB, on disk,
keys only, without a watermark): a micro-batch looks its own keys up and reads
nothing of the table. Nothing is dropped by event time: a row may be arbitrarily
late, and a repeat may come at any time after the first. A stream that starts
on a table that has rows takes their keys into its state first.

X2 ``start_ingest``: X1, and of what each batch has written its sums per
(by, month), in a folder of the batch; the months that it touches are computed
anew from those sums. ``start_monthly_summary`` is the same with the rows kept
beside the summary.

Sinks are idempotent under retries: a batch replaces its own folders, and the
state that it starts from is that of the batch before. Old folders are folded
(``fold_batches``, ``fold_sums``), so their number stays bounded.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.summary import expense_amt, income_amt, savings_rate, signed_amt
from ..session import MAX_FILE_AGE
from ..sources import folders as FO
from ..sources import store as ST

# The settings that put the state of a stream on disk.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves megabytes
}
FOLD = 10  # folders of one size that become one of the next


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, name_glob: str = "*.parquet",
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", name_glob).option("maxFileAge", MAX_FILE_AGE)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(fmt).load(folder)


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --- rows by key (X1) -----------------------------------------------------------
SEED = "_seed"  # marks keys of a table that was there before the stream


def _start_point(spark: SparkSession, table_root: str, checkpoint: str, key: str, known: DataFrame | None) -> tuple[str | None, int]:
    """(folder of the keys known when the stream first started, or None; number of its first batch folder).

    Both are kept beside the checkpoint. Folders of earlier streams keep their numbers; a new stream goes on from there.
    """
    home = checkpoint.rstrip("/")
    seed, start = f"{home}/seed", f"{home}/start"
    if not FO.exists(spark, f"{home}/metadata"):  # written as the stream starts, before any batch
        tables = [t for t in (read_batches(spark, table_root), known) if t is not None]
        if tables:
            keys = tables[0].select(key)
            for t in tables[1:]:
                keys = keys.unionByName(t.select(key))
            keys.write.mode("overwrite").parquet(seed)
        first = max(FO.numbered(spark, table_root, "batch_id"), default=-1) + 1
        spark.createDataFrame([(first,)], "first int").write.mode("overwrite").parquet(start)
    first = spark.read.parquet(start).first()["first"] if FO.finished(spark, start) else 0
    return (seed if FO.finished(spark, seed) else None), first


def first_of_each_key(stream: DataFrame, key: str, seed: str | None) -> DataFrame:
    """The rows of ``stream`` whose key is new to the state, and, marked in ``SEED``, those of the seed folder."""
    rows = stream.withColumn(SEED, F.lit(False))
    if seed is not None:
        kind = stream.schema[key].dataType
        keys = stream.sparkSession.readStream.schema(T.StructType([T.StructField(key, kind)])).parquet(seed)
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != key]
        rows = rows.unionByName(keys.select(key, *others, F.lit(True).alias(SEED)))
    return rows.dropDuplicates([key])


def _new_rows(batch: DataFrame, batch_id: int, key: str, seed: str | None) -> DataFrame:
    """What a micro-batch adds. All of the seed comes in batch 0, where a new row may have won against its own key."""
    rows = batch.where(~F.col(SEED)).drop(SEED)
    if seed is not None and batch_id == 0:
        rows = ST.append_new(batch.sparkSession.read.parquet(seed), rows, key)
    return rows


def _append_batch(table_root: str, key: str, seed: str | None, first: int, fold: int):
    root = table_root.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        fold_batches(batch.sparkSession, root, first + batch_id, fold)
        # the batch's own folder: a retried batch replaces exactly what it wrote before
        _new_rows(batch, batch_id, key, seed).write.mode("overwrite").parquet(f"{root}/batch_id={first + batch_id}")

    return run


def read_batches(spark: SparkSession, table_root: str) -> DataFrame | None:
    """The rows of a table of batch folders, also while folders are being folded; None if it has none."""
    root = table_root.rstrip("/")
    staged = [n for n in FO.numbered(spark, f"{root}/_folded", "batch_id") if FO.finished(spark, f"{root}/_folded/batch_id={n}")]
    if not staged:
        return ST.read_or_none(spark, root)
    lo, hi = _span(spark, root, staged[-1]), staged[-1]
    paths = [f"{root}/_folded/batch_id={hi}"] + [
        f"{root}/batch_id={n}" for n in FO.numbered(spark, root, "batch_id") if not lo <= n <= hi]
    tables = [t.withColumn("batch_id", F.lit(int(p.rsplit("=", 1)[1]))) for p in paths if (t := ST.read_or_none(spark, p)) is not None]
    out = tables[0] if tables else None
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _span(spark: SparkSession, root: str, upto: int) -> int:
    """The first batch that the staged folder ``upto`` holds."""
    return spark.read.parquet(f"{root}/_folded/_first/upto={upto}").first()["first"]


def fold_batches(spark: SparkSession, table_root: str, batch_id: int, fold: int = FOLD) -> None:
    """Before batch N, make one folder of the last fold**k ones, k the greatest with N a multiple of fold**k.

    So a row is copied once for each power of ``fold``, and at most
    ``fold`` folders of each size are there. Only finished batches are folded.
    The copy is staged first; from then on it stands for its folders
    (``read_batches``), which are deleted before it is moved into their place. A
    retry goes on where the last try broke off.
    """
    root = table_root.rstrip("/")
    size = 1
    while batch_id and batch_id % (size * fold) == 0:
        size *= fold
    stage = f"{root}/_folded"
    for n in FO.numbered(spark, stage, "batch_id"):
        if FO.finished(spark, f"{stage}/batch_id={n}"):
            _put_in_place(spark, root, n)
        else:
            FO.delete(spark, f"{stage}/batch_id={n}")
    if size == 1:
        return
    first, last = batch_id - size, batch_id - 1
    ids = [n for n in FO.numbered(spark, root, "batch_id") if first <= n <= last]
    if len(ids) < 2:
        return
    tables = [t for n in ids if (t := ST.read_or_none(spark, f"{root}/batch_id={n}")) is not None]
    if not tables:
        return
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    spark.createDataFrame([(first,)], "first long").write.mode("overwrite").parquet(f"{stage}/_first/upto={last}")
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{stage}/batch_id={last}")
    _put_in_place(spark, root, last)


def _put_in_place(spark: SparkSession, root: str, upto: int) -> None:
    first = _span(spark, root, upto)
    for n in FO.numbered(spark, root, "batch_id"):
        if first <= n <= upto:
            FO.delete(spark, f"{root}/batch_id={n}")
    FO.move(spark, f"{root}/_folded/batch_id={upto}", f"{root}/batch_id={upto}")
    FO.delete(spark, f"{root}/_folded/_first/upto={upto}")


def _started(stream: DataFrame, sink, checkpoint: str, available_now: bool, processing_time: str | None):
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    with _state_on_disk(stream.sparkSession):
        return w.start()


def start_append_dedup(stream: DataFrame, table_root: str, checkpoint: str, key: str = "transaction_id",
                       available_now: bool = True, processing_time: str | None = None, fold: int = FOLD,
                       known: DataFrame | None = None):
    """Start X1; returns the StreamingQuery.

    On its first start the state takes the keys of the rows that earlier streams
    wrote to the table, and those of ``known``, any other table. Of rows
    with one key in one micro-batch any one is kept.
    """
    seed, first = _start_point(stream.sparkSession, table_root, checkpoint, key, known)
    sink = _append_batch(table_root, key, seed, first, fold)
    return _started(first_of_each_key(stream, key, seed), sink, checkpoint, available_now, processing_time)


# --- sums by month (X2) ---------------------------------------------------------
SUMS = ["_inc", "_exp", "_net", "transaction_count"]


def month_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum(income_amt()).alias("_inc"), F.sum(expense_amt()).alias("_exp"),
        F.sum(signed_amt()).alias("_net"), F.count(F.lit(1)).alias("transaction_count"),
    )


def _sum_folders(spark: SparkSession, root: str) -> tuple[int | None, list[int]]:
    """The newest finished base (its last batch), and the batches after it."""
    bases = [n for n in FO.numbered(spark, root, "upto") if FO.finished(spark, f"{root}/upto={n}")]
    base = bases[-1] if bases else None
    return base, [n for n in FO.numbered(spark, root, "batch") if base is None or n > base]


def read_sums(spark: SparkSession, sums_root: str, upto: int | None = None) -> DataFrame | None:
    """Sums of all batches (up to one): the base, and one folder for each batch after it."""
    base, after = _sum_folders(spark, sums_root)
    paths = ([] if base is None else [f"{sums_root}/upto={base}"]) + [f"{sums_root}/batch={n}" for n in after if upto is None or n <= upto]
    out = None
    for p in paths:
        t = ST.read_or_none(spark, p)
        if t is not None:
            out = t if out is None else out.unionByName(t)
    return out


def fold_sums(spark: SparkSession, sums_root: str, batch_id: int, keys: Sequence[str], month_col: str, fold: int = FOLD) -> None:
    """Before batch N, add the sums of finished batches to the base, once there are ``fold`` of them.

    The new base is a folder of its own; it counts once it is finished, and then
    what it holds is deleted. A retry finds either state.
    """
    base, after = _sum_folders(spark, sums_root)
    for n in FO.numbered(spark, sums_root, "upto"):
        if n != base:
            FO.delete(spark, f"{sums_root}/upto={n}")
    for n in FO.numbered(spark, sums_root, "batch"):
        if base is not None and n <= base:
            FO.delete(spark, f"{sums_root}/batch={n}")
    done = [n for n in after if n < batch_id]
    if len(done) < fold:
        return
    total = read_sums(spark, sums_root, done[-1])
    if total is None:
        return
    even = total.groupBy(*keys).agg(*[F.sum(c).cast(total.schema[c].dataType).alias(c) for c in SUMS]).hint("rebalance", month_col)
    even.write.mode("overwrite").partitionBy(month_col).parquet(f"{sums_root}/upto={done[-1]}")
    for n in done:
        FO.delete(spark, f"{sums_root}/batch={n}")
    if base is not None:
        FO.delete(spark, f"{sums_root}/upto={base}")


def _ingest_batch(table_root: str, summary_root: str, key: str, by: Sequence[str], seed: str | None, first: int, fold: int,
                  month_col: str = "year_month"):
    sums_root = f"{summary_root.rstrip('/')}/_sums"
    keys = [*by, month_col]
    append = _append_batch(table_root, key, seed, first, fold)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        append(batch, batch_id)
        number = first + batch_id
        fold_sums(spark, sums_root, number + 1, keys, month_col, fold)
        written = ST.read_or_none(spark, f"{table_root.rstrip('/')}/batch_id={number}")
        if written is None:
            return
        # this batch's contribution per (by, month), in its own folder: a retry replaces it, never adds it twice
        own = f"{sums_root}/batch={number + 1}"
        month_sums(written, keys).write.mode("overwrite").partitionBy(month_col).parquet(own)
        added = ST.read_or_none(spark, own)
        if added is None:
            return
        # months that it touches, computed whole from the sums: nothing depends on what the summary held before
        touched = ST.restrict_to_touched(read_sums(spark, sums_root), added, [month_col])
        ST.write_rows(_monthly(touched, keys), summary_root, [month_col], "overwrite")

    return run


def _monthly(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        sums.groupBy(*keys)
        .agg(F.sum("_inc").cast("double").alias("total_income"), F.sum("_exp").cast("double").alias("total_expense"),
             F.sum("_net").cast("double").alias("net"), F.sum("transaction_count").alias("transaction_count"))
        .withColumn("savings_rate_pct", savings_rate("net", "total_income"))
    )


def _start_sums(spark: SparkSession, table_root: str, summary_root: str, checkpoint: str, keys: Sequence[str], first: int,
                month_col: str = "year_month") -> None:
    """Before the first batch of a stream on a table that has rows: their sums are the first base, and make the summary."""
    if first and not FO.exists(spark, f"{checkpoint.rstrip('/')}/metadata"):
        sums_root = f"{summary_root.rstrip('/')}/_sums"
        FO.delete(spark, sums_root)
        month_sums(read_batches(spark, table_root), keys).write.partitionBy(month_col).parquet(f"{sums_root}/upto={first}")
        whole = _monthly(spark.read.parquet(f"{sums_root}/upto={first}"), keys)
        ST.write_rows(whole, summary_root, [month_col], "overwrite")


def start_ingest(stream: DataFrame, table_root: str, summary_root: str, checkpoint: str, by: Sequence[str] = (),
                 key: str = "transaction_id", available_now: bool = True, processing_time: str | None = None, fold: int = FOLD):
    """X1 and X2 in one exact stream; returns the StreamingQuery.

    Repeats never reach the summary (their keys are in the state), late rows
    are counted, and a retried batch replaces its own sums. Rows that earlier
    streams wrote to the table count in the summary.
    """
    spark = stream.sparkSession
    seed, first = _start_point(spark, table_root, checkpoint, key, None)
    _start_sums(spark, table_root, summary_root, checkpoint, [*by, "year_month"], first)
    sink = _ingest_batch(table_root, summary_root, key, list(by), seed, first, fold)
    return _started(first_of_each_key(stream, key, seed), sink, checkpoint, available_now, processing_time)


def start_monthly_summary(stream: DataFrame, summary_root: str, checkpoint: str, by: Sequence[str] = (),
                          key: str = "transaction_id", available_now: bool = True, processing_time: str | None = None, fold: int = FOLD):
    """Start X2 over a ledger-shaped stream; the rows are kept at ``<summary_root>_rows``."""
    return start_ingest(stream, f"{summary_root.rstrip('/')}_rows", summary_root, checkpoint, by, key, available_now, processing_time, fold)


def run_to_completion(start: Callable[[], object], timeout_s: int | None = None) -> None:
    """Wait for a stream that ends by itself (availableNow), however long it takes unless ``timeout_s`` is given."""
    q = start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
