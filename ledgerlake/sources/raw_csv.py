"""Raw transaction log scan (S1, S2): quoted CSV files, split over tasks whatever their size and number.

All columns are read as text by the name in each file's header, so files may
order their columns differently; quotes are doubled inside quoted fields, which
may span lines. A missing required column is an error naming it; extra columns
are tolerated and dropped by the cleaner's projection.

Files are read as lines, which any task can do for any stretch of a file. A line
turns the state before it (outside or inside a quoted field) into that after
it; most lines leave it as it is. Only files with a line that does not are
looked at closer: an aggregate of those changes gives what a stretch does, a
running one along the stretches of a file the state before each, and the task that
reads a stretch joins its lines to records as they come. No line is shuffled but
those of records that a stretch cuts. Records are parsed by ``from_csv``. What is
kept of files and stretches, a row each, is written once and broadcast.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import stored
from ..schema import REQUIRED_RAW_COLUMNS

NONE, CLOSE, OPEN, TURN = range(4)  # what a line does to the state
CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


class ExtractError(RuntimeError):
    """The raw dataset cannot be read or lacks required columns."""


# --- lines and quotes ---------------------------------------------------------------
def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): ``at`` orders the lines of a block, ``block`` those of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line that begins inside a quoted field or not ends inside of one.

    Outside, a field is quoted if its first character is a quote; it is left open
    by an odd number of quotes up to the next comma. Inside, an odd number closes it.
    """
    def step(now: Column, field: Column) -> Column:
        odd = F.length(F.regexp_replace(field, '[^"]+', "")) % 2 == 1
        return F.when(now | field.startswith('"'), now != odd).otherwise(F.lit(False))

    fold = F.aggregate(F.split(line, ","), F.lit(inside), step)
    return F.when(line.contains('"'), fold).otherwise(F.lit(inside))


def _changed(lines: DataFrame) -> DataFrame:
    """Lines with what they do to the state, ``change``: nothing, close, open (the same end either way) or turn (it is reversed)."""
    ends = lines.withColumn("_out", _ends_inside(F.col("line"), False)).withColumn("_in", _ends_inside(F.col("line"), True))
    change = F.when(F.col("_out") == F.col("_in"), F.when(F.col("_out"), OPEN).otherwise(CLOSE)).when(F.col("_out"), TURN).otherwise(NONE)
    return ends.select(*lines.columns, change.cast("byte").alias("change"))


def _blocks(lines: DataFrame) -> DataFrame:
    """A row for each block, written once: ``id``, ``first_at`` (its first line that is not blank), ``moved`` (a line of its
    file changes the state) and ``last`` (place and value of the last line that fixes the state, as one number)."""
    at, change = F.col("at"), F.col("change")
    seen = lines.groupBy("file", "block").agg(
        F.min(F.when(~F.col("line").isin("", "\r"), at)).alias("first_at"),
        F.max(change != NONE).alias("moved"),
        F.max(F.when(change.isin(OPEN, CLOSE), at * 2 + (change == OPEN).cast("long"))).alias("last"),
    )
    whole = seen.withColumn("moved", F.max("moved").over(Window.partitionBy("file")))
    return stored(whole.withColumn("id", F.monotonically_increasing_id()), "log-blocks")


def _beginnings(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Moved blocks with ``inside``, the state before their first line: the composition of the earlier blocks of the file."""
    moved = blocks.where("moved")
    late = lines.join(F.broadcast(moved), ["file", "block"]).where(F.col("last").isNull() | (F.col("at") > F.shiftright("last", 1)))
    turns = late.groupBy("id").agg(F.count_if(F.col("change") == TURN).alias("turns"))
    ends = moved.join(turns, "id", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_all", F.sum("turns").over(Window.partitionBy("file").orderBy("block")))
    fixed = F.when(F.col("last").isNotNull(), F.struct((F.col("last") % 2).alias("value"), (F.col("_all") - F.col("turns")).alias("before")))
    ends = ends.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("_turned", F.coalesce(F.sum("turns").over(earlier), F.lit(0)))
    state = F.coalesce(F.col("_fixed.value"), F.lit(0)) + F.col("_turned") - F.coalesce(F.col("_fixed.before"), F.lit(0))
    return stored(ends.select("file", "block", "id", (state % 2 == 1).alias("inside")), "log-beginnings")


def _place(batches):
    """Records of a task's lines, which come block by block in their order.

    A record that a batch or block cuts comes in parts, each with ``begins``: whether it is the first.
    """
    block, state = None, False
    for batch in batches:
        ids, change = batch.column("id").to_numpy(), batch.column("change").to_numpy()
        n = len(ids)
        if not n:
            continue
        rows = np.arange(n)
        new = np.concatenate([[ids[0] != block], ids[1:] != ids[:-1]])
        start = np.maximum.accumulate(np.where(new, rows, 0))
        first = np.where(new[start], batch.column("inside").to_numpy(zero_copy_only=False)[start], state)
        turns = np.concatenate([[0], np.cumsum(change == TURN)])  # before a line
        fixed = np.maximum.accumulate(np.where((change == OPEN) | (change == CLOSE), rows, -1))
        known = fixed >= start
        since = np.where(known, fixed, start)
        after = np.where(known, change[fixed] == OPEN, first) ^ ((turns[1:] - turns[since]) % 2 == 1)
        before = np.where(start == rows, first, np.concatenate([[False], after[:-1]]))
        block, state = ids[-1], bool(after[-1])

        cut = np.flatnonzero(new | ~before)  # where a record, or its part in this batch and block, begins
        cut = cut if len(cut) and cut[0] == 0 else np.concatenate([[0], cut])
        end = np.concatenate([cut[1:], [n]])
        begins, whole = ~before[cut], ~before[cut] & ~after[end - 1]
        lines, alone = batch.column("line"), end - cut == 1
        if not alone.all():
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, n), pa.int32()), lines)
            joined = pc.binary_join(lists.filter(pa.array(~alone)), "\n")
            places = np.where(alone, cut, n + np.cumsum(~alone) - 1)
            texts = pa.concat_arrays([lines, joined]).take(pa.array(places))
        else:
            texts = lines.take(pa.array(cut))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[cut]), batch.column("at").take(pa.array(cut)), pa.array(whole), pa.array(begins), texts],
            names=["id", "at", "whole", "begins", "record"])


def _joined_lines(lines: DataFrame, begun: DataFrame) -> DataFrame:
    """Records (file, block, at, record) of files with quoted line breaks; a record is placed where it begins.

    Lines stay in the task that reads them: the blocks, a row for each block of a file, are broadcast, and
    only records cut by a block or an Arrow batch are shuffled, in their parts.
    """
    placed = lines.join(F.broadcast(begun), ["file", "block"]).select("id", "inside", "at", "change", "line")
    records = placed.mapInArrow(_place, "id long, at long, whole boolean, begins boolean, record string")
    records = records.join(F.broadcast(begun.select("id", "file", "block")), "id")
    whole = records.where("whole").select("file", "block", "at", "record")
    upto = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)
    parts = records.where("not whole").withColumn("number", F.sum(F.col("begins").cast("long")).over(upto))
    parts = parts.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "at", "record"))).alias("parts"))
    more = parts.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"),
                        F.array_join(F.col("parts.record"), "\n").alias("record"))
    return whole.unionByName(more)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of all files, not parsed yet, as (file, block, at, record), and (file, first_at, header): the first of each.

    Runs a job that looks for quoted line breaks, and more where there are any.
    """
    lines = _changed(read_lines(spark, path))
    blocks = _blocks(lines)
    records = lines.select("file", "block", "at", F.col("line").alias("record"))
    if not blocks.where("moved").isEmpty():
        still = blocks.where("not moved").select("file", "block")
        records = _joined_lines(lines, _beginnings(lines, blocks))
        if not still.isEmpty():
            plain = lines.join(F.broadcast(still), ["file", "block"], "left_semi").select("file", "block", "at", F.col("line").alias("record"))
            records = plain.unionByName(records)
    bare = F.regexp_replace("record", "\r$", "")
    records = records.withColumn("record", F.when(F.col("record").endswith("\r"), bare).otherwise(F.col("record"))).where(F.col("record") != "")

    begin = F.broadcast(blocks.where("block = 0 and first_at is not null").select("file", "first_at"))
    heads = _changed(read_lines(spark, path).where("block = 0").join(begin, "file").where("at = first_at"))
    heads = stored(heads.select("file", "first_at", F.col("line").alias("header"), F.col("change").isin(OPEN, TURN).alias("open")), "log-headers")
    long = heads.where("open").select("file", "first_at")
    if not long.isEmpty():  # headers that span lines
        longer = records.where("block = 0").join(F.broadcast(long), "file").where("at = first_at").select("file", "first_at", F.col("record").alias("header"))
        heads = stored(heads.where("not open").select("file", "first_at", "header").unionByName(longer), "log-headers")
    return records, heads.select("file", "first_at", F.regexp_replace("header", "\r$", "").alias("header"))


# --- columns ------------------------------------------------------------------------
def _names(header: str) -> list[str]:
    return next(csv.reader([header.removeprefix("﻿")], strict=False)) if "\n" not in header else next(
        csv.reader(header.removeprefix("﻿").splitlines(keepends=True)))


def extract_transactions(spark: SparkSession, path: str, required=REQUIRED_RAW_COLUMNS) -> DataFrame:
    """All-text DataFrame of the raw log; raises ``ExtractError`` on missing columns or path.

    A few jobs run when called, over all files at once: for quoted line breaks, and
    for headers, of which the distinct ones reach the driver.
    """
    try:
        records, first = read_records(spark, path)
        headers = {r["header"]: r["file"] for r in first.groupBy("header").agg(F.min("file").alias("file")).collect()}
    except Exception as exc:  # noqa: BLE001  (missing path: AnalysisException)
        raise ExtractError(f"Raw data file not found or unreadable: {path}: {exc}") from exc
    if not headers:
        raise ExtractError(f"Raw data file not found, unreadable or empty: {path}")
    names = {h: _names(h) for h in headers}
    columns: dict[str, None] = {}
    for header, cols in sorted(names.items(), key=lambda x: headers[x[0]]):
        missing = [c for c in required if c not in cols]
        if missing:
            raise ExtractError(f"Dataset is missing required columns: {missing} in {headers[header]}")
        columns |= dict.fromkeys(cols)

    width = max(len(c) for c in names.values())
    fields = T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(width)])
    parsed = F.from_csv("record", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), CSV_OPTIONS)
    rows = records.join(F.broadcast(first), "file").where((F.col("block") != 0) | (F.col("at") != F.col("first_at"))).withColumn("_v", parsed)
    out = []
    for c in columns:
        value = F.lit(None).cast("string")
        for header, cols in names.items():
            if c in cols:
                value = F.when(F.col("header") == header, F.col(f"_v.c{cols.index(c)}")).otherwise(value)
        out.append((F.col(f"_v.c{next(iter(names.values())).index(c)}") if len(names) == 1 else value).alias(c))
    return rows.select(*out)
