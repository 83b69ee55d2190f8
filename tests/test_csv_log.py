"""Quoted CSV read by lines in many tasks equals Spark's reader of whole files."""

import os
import random
import tempfile

import pytest

from ledgerlake.sources import raw_csv as RC

COLS = ["date_time", "category", "account", "amount", "currency", "tags"]
TEXTS = ["Food", "a,b", 'say "hi"', "two\nlines", 'x\n"y",\nz', "", "  pad ", "é,\n,\n", '"', '""', "plain", "end\n"]


def quoted(v, r, always=False):
    if v is None:
        return ""
    if always or any(c in v for c in ',"\n') or v == "" or r.random() < 0.2:
        return '"' + v.replace('"', '""') + '"'
    return v


def write_log(folder, name, n, seed, texts=TEXTS, cols=COLS, stray=False, end="\n"):
    r = random.Random(seed)
    rows = [[r.choice(texts + [None]) for _ in cols] for _ in range(n)]
    lines = [",".join(cols)]
    for row in rows:
        fields = [quoted(v, r) for v in row]
        if stray and r.random() < 0.3:
            fields[r.randrange(len(fields))] = r.choice(['5" pipe', 'a"b"c', 'x"', "it's"])
        lines.append(",".join(fields))
    with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
        f.write(end.join(lines) + r.choice(["", end]))


def whole_files(spark, path, cols=COLS):
    """Spark's own multi-line reader: one task for each file."""
    df = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


@pytest.fixture
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "2000")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed", range(4))
def test_one_large_file_is_read_by_many_tasks(spark, small_blocks, seed):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    write_log(folder, "big.csv", 700, seed)
    assert RC.read_lines(spark, folder).rdd.getNumPartitions() > 8
    got = sorted([tuple(r) for r in RC.extract_transactions(spark, folder).select(*COLS).collect()], key=str)
    assert len(got) > 600 and got == whole_files(spark, folder)


def test_stray_quotes_change_nothing_after_them(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    write_log(folder, "a.csv", 500, 7, stray=True, texts=["Food", "a,b", "two\nlines", 'say "hi"'])
    got = sorted([tuple(r) for r in RC.extract_transactions(spark, folder).select(*COLS).collect()], key=str)
    assert got == whole_files(spark, folder)


def test_line_ends_of_windows(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    write_log(folder, "a.csv", 200, 3, end="\r\n")
    got = sorted([tuple(r) for r in RC.extract_transactions(spark, folder).select(*COLS).collect()], key=str)
    assert got == whole_files(spark, folder)


def test_many_files_take_few_jobs(spark):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    other = list(reversed(COLS)) + ["note"]
    for i in range(400):
        write_log(folder, f"{i}.csv", 3, i, cols=COLS if i % 3 else other)
    sc = spark.sparkContext
    sc.setJobGroup("many", "headers of many files")
    df = RC.extract_transactions(spark, folder)
    jobs = len(sc.statusTracker().getJobIdsForGroup("many"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20  # not one for each file
    assert set(df.columns) == {*COLS, "note"}
    want = []
    for i in range(400):
        cols = COLS if i % 3 else other
        part = [tuple(dict(zip(cols, r)).get(c) for c in [*COLS, "note"]) for r in whole_files(spark, f"{folder}/{i}.csv", cols)] if i < 24 else None
        want += part or []
    few = RC.extract_transactions(spark, f"{folder}/{{{','.join(str(i) for i in range(24))}}}.csv")
    assert sorted([tuple(r) for r in few.select(*COLS, "note").collect()], key=str) == sorted(want, key=str)


def test_header_spanning_lines_repeats_and_empty_files(spark):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    head = '"date_time",category,account,amount,currency,tags,"a\nnote"'
    body = "2025-01-01,Food,a,1,BYN,t,x"
    with open(f"{folder}/a.csv", "w") as f:
        f.write("﻿" + head + "\n" + body + "\n" + "\n" + head + "\n")  # a blank line, and the header once more as data
    open(f"{folder}/b.csv", "w").close()
    df = RC.extract_transactions(spark, folder)
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("2025-01-01", "Food", "a", "1", "BYN", "t", "x"), ("date_time", "category", "account", "amount", "currency", "tags", "a\nnote")]
    assert df.columns[-1] == "a\nnote"
    lone = tempfile.mkdtemp(prefix="ll-csv-")
    open(f"{lone}/b.csv", "w").close()
    with pytest.raises(RC.ExtractError):
        RC.extract_transactions(spark, lone)


def test_a_quote_that_is_never_closed(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    with open(f"{folder}/a.csv", "w") as f:
        f.write(",".join(COLS) + "\n2025-01-01,Food,a,1,BYN,t\n2025-01-01,\"open,a,1,BYN,t\n" + "2025-01-02,Food,a,1,BYN,t\n" * 300)
    got = RC.extract_transactions(spark, folder).collect()
    assert len(got) == 2 == len(whole_files(spark, folder))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_records_cut_by_blocks_and_batches(spark, small_blocks, batch):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    write_log(folder, "a.csv", 300, 11, texts=["Food", "x\ny\n\nz" * 40, 'a\n"b",\nc'])
    write_log(folder, "b.csv", 60, 12, texts=["plain"])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        got = sorted([tuple(r) for r in RC.extract_transactions(spark, folder).select(*COLS).collect()], key=str)
    finally:
        spark.conf.set(name, before)
    assert got == whole_files(spark, folder)


def test_lines_are_not_shuffled(spark):
    """Only the parts of cut records are; else a log takes many times its size on disk."""
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    write_log(folder, "a.csv", 50, 5)
    plan = RC.extract_transactions(spark, folder)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in x]
    assert "MapInArrow" in plan and len(lines) == 1, lines  # of parts, by file
    assert "SortMergeJoin" not in plan
