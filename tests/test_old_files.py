"""File streams read new files however old their modification time is."""

import glob
import os
import time

from pyspark.sql import functions as F

from ledgerlake.session import scratch_path
from ledgerlake.streaming import ingest as IN


def add_old(df, path, days=400):
    """Append ``df`` as files whose modification time lies ``days`` back."""
    local = path.removeprefix("file:")
    before = set(glob.glob(f"{local}/*.parquet"))
    df.write.mode("append").parquet(path)
    for f in set(glob.glob(f"{local}/*.parquet")) - before:
        os.utime(f, (time.time() - days * 86_400,) * 2)


def test_stream_takes_files_with_old_dates(spark):
    path, root = scratch_path(spark, "source-old"), scratch_path(spark, "table-old")
    ids = lambda lo: spark.range(lo, lo + 3).select(F.col("id").cast("string").alias("transaction_id"))
    ids(0).write.parquet(path)
    run = lambda: IN.run_to_completion(
        lambda: IN.start_append_dedup(IN.file_stream(spark, path, ids(0).schema), f"{root}/t", f"{root}/ck"))
    run()
    add_old(ids(2), path)
    run()
    assert sorted(r.transaction_id for r in spark.read.parquet(f"{root}/t").collect()) == list("01234")
