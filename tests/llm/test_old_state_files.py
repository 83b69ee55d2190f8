"""The state of exact deduplication takes new files however old their modification time is."""

import glob
import os
import time

from ledgerlake.llm import exact_dedup
from ledgerlake.session import scratch_path


def add_old(df, path, days=400):
    """Append ``df`` as files whose modification time lies ``days`` back."""
    local = path.removeprefix("file:")
    before = set(glob.glob(f"{local}/*.parquet"))
    df.write.mode("append").parquet(path)
    for f in set(glob.glob(f"{local}/*.parquet")) - before:
        os.utime(f, (time.time() - days * 86_400,) * 2)


def test_state_takes_files_with_old_dates(spark):
    path, folder = scratch_path(spark, "grow-old"), scratch_path(spark, "state-old")
    kind = "doc_id long, text string"
    spark.createDataFrame([(5, "a b"), (6, "c")], kind).write.parquet(path)
    assert exact_dedup.exact_dedup(spark, path, folder).count() == 2
    add_old(spark.createDataFrame([(4, "ab"), (9, "d")], kind), path)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, path, folder).collect()}
    assert got == {5: (5, 2), 4: (5, 2), 6: (6, 1), 9: (9, 1)}
