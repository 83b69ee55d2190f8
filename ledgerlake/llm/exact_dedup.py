"""Exact deduplication with keyed streaming state.

A file stream of documents is grouped by the digest of the normalised text. The
state store (RocksDB, on disk, without a watermark, so nothing expires) keeps
for each digest the number of rows and, of the best row, its identifier and the
locator of its content (file and row); no text enters the state. Every batch
appends the groups that it changed to a table in the shared folder, and the
last entry of a digest is its state. A later call with the same folder goes on
from there and reads only new files.

A digest that was hit more than once is then checked on full bytes: the least
and the greatest normalised text among its rows must be equal. Rows of a digest
that fails are grouped by the whole text instead.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import MAX_FILE_AGE, scratch_path
from .common import WS, stored, text_of

# The settings that put the streaming state on disk.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves megabytes
}


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, WS + "+", "")


def _rows(docs: DataFrame) -> DataFrame:
    """What is compared: locator and size of each row, and its digest."""
    whole = text_of(F.col("text"))
    return docs.select(
        "doc_id", "text",
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        F.length(whole).cast("long").alias("n_points"),
        F.sha2(normalised(whole), 256).alias("text_sha256"),
    )


# The best row has most code points first, then the smallest identifier (null last); rows equal in both by their place.
def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    rank = F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    return rows.groupBy(*keys).agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))


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


def update_state(spark: SparkSession, path: str, folder: str, max_files: int = 100_000) -> None:
    """Run the stream over the files under ``path`` that ``folder`` has not seen."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    # As a pattern, so that the path may be one file as well as a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    options = {"maxFilesPerTrigger": max_files, "maxFileAge": MAX_FILE_AGE}
    stream = spark.readStream.schema(schema).options(**options).parquet(pattern)
    groups = _groups(_rows(stream), "text_sha256")

    def keep(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again after a failure replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch_id}")

    with _state_on_disk(spark):
        query = (
            groups.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
        )
    query.awaitTermination()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """(text_sha256, best, group_size): the last entry of every digest."""
    entries = spark.read.option("basePath", f"{folder}/groups").parquet(f"{folder}/groups/batch=*")
    last = F.max_by(F.struct("best", "group_size"), F.col("batch")).alias("s")
    return entries.groupBy("text_sha256").agg(last).select("text_sha256", "s.best", "s.group_size")


def exact_dedup(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """One row for every row of the parquet files under ``path`` (columns doc_id, text; others are not read).

    doc_id, text_sha256 (of the normalised text), keep_id, group_size, kept, and
    the locator (file, row). Null texts count as empty, all empty ones are equal;
    a null doc_id loses against any other; of rows equal in everything the first
    in file order stays. ``folder`` keeps the state for later calls.
    """
    folder = folder or scratch_path(spark, "exact-dedup")
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return _decided(_rows(docs).join(_groups(_rows(docs), "text_sha256"), "text_sha256"))
    update_state(spark, path, folder)
    groups = state(spark, folder)
    # Hits: rows of digests with more than one row, compared on full bytes. Only two texts leave each task for a digest.
    hits = groups.filter("group_size > 1").select("text_sha256")
    bytes_of = _rows(docs).select("text_sha256", normalised(text_of("text")).alias("t"))
    differ = stored(
        bytes_of.join(hits.hint("shuffle_hash"), "text_sha256", "left_semi").groupBy("text_sha256")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("text_sha256"),
        "digest-clashes",
    )
    rows = _rows(docs)
    light = rows.drop("text")
    if differ.isEmpty():
        return _decided(light.join(groups, "text_sha256"))
    by_text = rows.join(differ, "text_sha256", "left_semi").withColumn("t", normalised(text_of("text"))).drop("text")
    exact = _groups(by_text, "text_sha256", "t")
    clear = light.join(differ, "text_sha256", "left_anti").join(groups, "text_sha256")
    return _decided(clear).unionByName(_decided(by_text.join(exact, ["text_sha256", "t"])))


def _decided(rows: DataFrame) -> DataFrame:
    same = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return rows.select(
        "doc_id", "text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size", same.alias("kept"), "file", "row"
    )
