"""Fixed schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw transaction log: every column is read as text; parsing is the cleaner's job.
REQUIRED_RAW_COLUMNS = ["date_time", "category", "account", "amount", "currency", "tags"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in REQUIRED_RAW_COLUMNS])

CANONICAL_COLUMNS = [
    "transaction_id",
    "transaction_date",
    "transaction_datetime",
    "year",
    "month",
    "year_month",
    "category",
    "type",
    "account",
    "amount",
    "currency",
    "tags",
    "source",
    "ingested_at",
]

AMOUNT_TYPE = T.DecimalType(18, 2)

TRANSACTIONS_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("transaction_date", T.DateType(), True),
        T.StructField("transaction_datetime", T.TimestampNTZType(), True),
        T.StructField("year", T.IntegerType(), True),
        T.StructField("month", T.IntegerType(), True),
        T.StructField("year_month", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("account", T.StringType(), True),
        T.StructField("amount", AMOUNT_TYPE, True),
        T.StructField("currency", T.StringType(), True),
        T.StructField("tags", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("ingested_at", T.TimestampType(), True),
    ]
)

MONTHLY_SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("year_month", T.StringType(), False),
        T.StructField("total_income", T.DoubleType(), True),
        T.StructField("total_expense", T.DoubleType(), True),
        T.StructField("net", T.DoubleType(), True),
        T.StructField("savings_rate_pct", T.DoubleType(), True),
        T.StructField("transaction_count", T.LongType(), True),
        T.StructField("generated_at", T.TimestampType(), True),
    ]
)

# Union of the fields the document store and the warehouse table carry.
BUDGET_PLAN_SCHEMA = T.StructType(
    [
        T.StructField("budget_id", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("monthly_limit", T.DoubleType(), False),
        T.StructField("applies_from", T.StringType(), True),
        T.StructField("period", T.StringType(), True),
        T.StructField("currency", T.StringType(), True),
        T.StructField("notes", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), True),
        T.StructField("updated_at", T.TimestampType(), True),
    ]
)

AI_REPORT_SCHEMA = T.StructType(
    [
        T.StructField("report_id", T.StringType(), False),
        T.StructField("report_type", T.StringType(), True),
        T.StructField("query_hash", T.StringType(), True),
        T.StructField("metadata_snapshot", T.VariantType(), True),
        T.StructField("prompt", T.StringType(), True),
        T.StructField("response", T.StringType(), True),
        T.StructField("model", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), True),
    ]
)

SIMULATION_SCHEMA = T.StructType(
    [
        T.StructField("simulation_id", T.StringType(), False),
        T.StructField("params", T.VariantType(), True),
        T.StructField("results", T.VariantType(), True),
        T.StructField("created_at", T.TimestampType(), True),
    ]
)

TABLES = {
    "transactions": TRANSACTIONS_SCHEMA,
    "monthly_summary": MONTHLY_SUMMARY_SCHEMA,
    "budget_plans": BUDGET_PLAN_SCHEMA,
    "ai_reports": AI_REPORT_SCHEMA,
    "fire_simulations": SIMULATION_SCHEMA,
}

