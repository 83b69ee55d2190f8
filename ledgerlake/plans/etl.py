"""The ETL job (S22): raw log -> canonical transactions -> monthly summary -> stores.

extract (S1, S2) -> clean (T1-T12) -> write transactions, partitioned
by ``year_month`` (S3), and the rejected rows with their reasons -> monthly summary (A1) read from
the written table -> keyed upsert into the summary table (S8) -> optional
extra sinks. As in the source, a failing sink does not abort the run: its
error is collected in ``errors``; errors in extract/clean propagate.

The transactions are written once and the summary is computed from the
written files, which also cuts the lineage: a lost executor later in the job
re-reads parquet instead of recomputing the cleaning.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession

from ..operators.clean import clean_transactions, rejected_transactions
from ..operators.summary import monthly_summary
from ..sources import store as ST
from ..sources.raw_csv import extract_transactions

Sink = Callable[[DataFrame, DataFrame], object]


def run_etl(spark: SparkSession, raw_path: str, out_root: str, source: str = "csv_seed",
            mapping: Mapping[str, str] | None = None, partition_by: Sequence[str] = ("year_month",),
            sinks: Mapping[str, Sink] | None = None, raw: DataFrame | None = None) -> dict:
    """Run the job; returns counts, paths and collected sink errors."""
    raw_df = raw if raw is not None else extract_transactions(spark, raw_path)
    obs = Observation("etl_clean")
    clean = clean_transactions(raw_df, source=source, mapping=mapping, observation=obs, require_non_empty=True)
    tx_root = f"{out_root.rstrip('/')}/transactions"
    tx_path = ST.replace_table(clean, tx_root, partition_by, key="transaction_id")
    metrics = obs.get
    tx = spark.read.parquet(tx_path)
    summary = monthly_summary(tx, stamp=True)
    errors: list[str] = []
    result = {
        "rows_in": metrics.get("rows_in"),
        "rows_out": metrics.get("rows_out"),
        "bad_date": metrics.get("bad_date"),
        "bad_amount": metrics.get("bad_amount"),
        "unfit_amount": metrics.get("unfit_amount"),
        "income_rows": metrics.get("income_rows"),
        "expense_rows": metrics.get("expense_rows"),
        "transactions_path": tx_path,
    }
    dropped = [metrics.get(k) or 0 for k in ("bad_date", "bad_amount", "unfit_amount")]
    result["rejected"] = sum(dropped)
    if result["rejected"]:
        result["rejected_path"] = ST.replace_table(rejected_transactions(raw_df), f"{out_root.rstrip('/')}/rejected")
    try:
        up = ST.upsert_table(summary, f"{out_root.rstrip('/')}/monthly_summary", ["year_month"])
        result["monthly_summary_path"] = up["path"]
        result["months"] = up["inserted"] + up["updated"]
    except Exception as exc:  # noqa: BLE001  (a sink failure is reported, not raised)
        errors.append(f"monthly_summary: {exc}")
    for name, sink in (sinks or {}).items():
        try:
            sink(tx, summary)
        except Exception as exc:  # noqa: BLE001
            errors.append(f"{name}: {exc}")
    result["errors"] = errors
    return result
