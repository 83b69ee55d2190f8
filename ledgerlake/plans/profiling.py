"""The profiling job.

Structural checks on the raw log (row/column counts, per-column nulls,
distinct counts, numeric ranges or top values, duplicate rows) and
statistical checks on the cleaned transactions (date range, type totals,
category and account breakdowns, amount statistics), assembled into one JSON
report. Every section is an aggregate; the sections are gathered without
joins (``functions.assemble``) and the report is serialised on the executors
and written as one small text file. Like the source's report it lists every
category and account of the ledger in that one document; for a ledger with
millions of accounts, read the breakdowns as tables (``operators.summary``)
instead.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assemble import json_object, merge_columns
from ..functions.ranking import stored
from ..operators import profile as PR
from ..operators import summary as S


def _listed(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """A small aggregate as one row holding a sorted array of structs."""
    st = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in df.columns]).alias("v"))
    return df.agg(F.transform(F.sort_array(F.collect_list(st)), lambda e: e["v"]).alias(name))


def column_entries(raw: DataFrame) -> DataFrame:
    """Per raw column: the profile plus its top values (non-numeric columns)."""
    tops = PR.top_values(raw).groupBy("column_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))),
                    lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))).alias("top_values"))
    return PR.column_profile(raw).join(tops, "column_name", "left")


CLEAN_COLUMNS = ("transaction_date", "category", "type", "account", "amount")  # what the sections read


def _held(raw: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames written once: every section and column reads them again, and the cleaner numbers copies over two shuffles."""
    return stored(raw, "profile-raw"), stored(clean.select(*CLEAN_COLUMNS), "profile-clean")


def headline_counts(raw: DataFrame, clean: DataFrame) -> DataFrame:
    c = merge_columns([
        raw.agg(F.count(F.lit(1)).alias("source_rows")),
        clean.agg(F.count(F.lit(1)).alias("clean_rows")),
        PR.duplicate_rows(raw),
    ])
    return c.withColumn("rows_dropped_in_transform", F.col("source_rows") - F.col("clean_rows"))


def profile_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: ``report_json`` with generated_at, counts, structural and statistical sections. Writes both frames when called."""
    raw, clean = _held(raw, clean)
    counts = headline_counts(raw, clean)
    structural = json_object([
        ("row_count", counts.select(F.col("source_rows").alias("row_count"))),
        ("column_count", counts.select(F.lit(len(raw.columns)).alias("column_count"))),
        ("columns", _listed(column_entries(raw), "columns", ["column_name"])),
        ("duplicate_rows", counts.select("duplicate_rows")),
    ], out="structural")
    amount = PR.amount_stats(clean)
    statistical = json_object([
        ("date_range", S.date_range(clean).select(F.struct("min_date", "max_date", "row_count").alias("date_range"))),
        ("type_totals", _listed(S.type_totals(clean), "type_totals", ["type"])),
        ("category_breakdown", _listed(S.category_breakdown(clean), "category_breakdown", ["category", "type"])),
        ("account_breakdown", _listed(S.account_breakdown(clean), "account_breakdown", ["account"])),
        ("amount_stats", amount.select(F.struct(*amount.columns).alias("amount_stats"))),
    ], out="statistical")
    return json_object([
        ("generated_at", counts.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"))),
        ("source_rows", counts.select("source_rows")),
        ("clean_rows", counts.select("clean_rows")),
        ("rows_dropped_in_transform", counts.select("rows_dropped_in_transform")),
        ("structural", structural, True),
        ("statistical", statistical, True),
    ], out="report_json")


def profiling_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Condensed summary (C21): headline counts, per column only dtype, null % and distinct count,
    and date range and amount statistics of the cleaned rows. Writes both frames when called."""
    raw, clean = _held(raw, clean)
    counts = headline_counts(raw, clean)
    cols = PR.column_profile(raw).select("column_name", "dtype", "null_pct", "unique_count")
    listed = _listed(cols, "columns", ["column_name"])
    return merge_columns([
        counts, listed.select(F.to_json("columns").alias("columns_json")),
        S.date_range(clean).select("min_date", "max_date"), PR.amount_stats(clean),
    ])


def write_report(report: DataFrame, report_dir: str) -> str:
    """Write the report JSON as one text file under a timestamped folder."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    path = f"{report_dir.rstrip('/')}/profile_report_{stamp}"
    report.select("report_json").coalesce(1).write.mode("errorifexists").text(path)
    return path
