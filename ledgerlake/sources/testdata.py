"""Ledgers derived from the driver's parquet tables.

The given tables hold no personal transaction log, so three ledgers are derived
from them with plain projections (no row is invented, every one of them grows
with the tables):

* L1 ``orders_ledger``: one order = one transaction; category = order priority,
  account = order status, amount = total price, entity = customer.
* L2 ``lineitem_ledger``: lineitem joined to part; category = brand, account =
  return flag, amount = extended price, entity = supplier.
* L3 ``events_ledger``: one event = one transaction; category = event type,
  account = user, amount = value, entity = user.

``lineitem_raw_log`` renders L2 as the all-text raw log the cleaner expects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import type_expr
from ..schema import AMOUNT_TYPE

# Which categories of each derived ledger count as Income.
ORDERS_INCOME = ("1-URGENT", "2-HIGH", "3-MEDIUM")
LINEITEM_INCOME = tuple(f"Brand#{i}" for i in range(1, 16))
EVENTS_INCOME = ("purchase",)

ORDERS_MAPPING = {c: "Income" for c in ORDERS_INCOME}
LINEITEM_MAPPING = {c: "Income" for c in LINEITEM_INCOME}
EVENTS_MAPPING = {c: "Income" for c in EVENTS_INCOME}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _date_parts(ts) -> list:
    return [
        F.to_date(ts).alias("transaction_date"),
        ts.alias("transaction_datetime"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.date_format(ts, "yyyy-MM").alias("year_month"),
    ]


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        *_date_parts(ts),
        F.col("o_orderpriority").alias("category"),
        type_expr(F.col("o_orderpriority"), ORDERS_MAPPING).alias("type"),
        F.col("o_orderstatus").alias("account"),
        F.col("o_totalprice").cast(AMOUNT_TYPE).alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("tags"),
        F.lit("orders").alias("source"),
        F.col("o_custkey").alias("entity_id"),
    )


def lineitem_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part. No hint: AQE broadcasts part only when its measured size allows."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
                                                      "l_linestatus", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    ts = F.col("l_shipdate")
    return j.select(
        F.lit(None).cast("string").alias("transaction_id"),
        *_date_parts(ts),
        F.col("p_brand").alias("category"),
        type_expr(F.col("p_brand"), LINEITEM_MAPPING).alias("type"),
        F.col("l_returnflag").alias("account"),
        F.col("l_extendedprice").cast(AMOUNT_TYPE).alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("l_linestatus").alias("tags"),
        F.lit("lineitem").alias("source"),
        F.col("l_suppkey").alias("entity_id"),
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_ledger(read_table(spark, sf_dir, "events"))


def events_to_ledger(e: DataFrame) -> DataFrame:
    """Event rows (batch or stream) as ledger rows."""
    ts = F.col("ts")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        *_date_parts(ts),
        F.col("event_type").alias("category"),
        type_expr(F.col("event_type"), EVENTS_MAPPING).alias("type"),
        F.col("user_id").cast("string").alias("account"),
        F.col("value").cast(AMOUNT_TYPE).alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("tags"),
        F.lit("events").alias("source"),
        F.col("user_id").alias("entity_id"),
    )


def lineitem_raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 as a raw text log with the six required columns (what a CSV read yields)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_returnflag",
                                                      "l_linestatus", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("date_time"),
        F.col("p_brand").alias("category"),
        F.col("l_returnflag").alias("account"),
        F.col("l_extendedprice").cast("string").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("l_linestatus").alias("tags"),
    )


def lineitem_dirty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw text log with rows spoilt in every way that the cleaner has a rule for, by order number."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag",
                                                      "l_linestatus", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    every = lambda n: F.col("l_orderkey") % n == 0
    price = F.col("l_extendedprice").cast("string")
    return j.select(
        F.when(every(11), "not-a-date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("date_time"),
        F.when(every(31), F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))).otherwise(F.col("p_brand")).alias("category"),
        F.col("l_returnflag").alias("account"),
        F.when(every(7), "x").when(every(13), "").when(every(17), F.concat(price, F.lit("5"))).when(every(19), "inf").when(every(23), "1e20")
        .when(every(29), F.concat(F.lit("-"), price)).when(every(37), F.concat(F.lit(" "), price)).when(every(41), "nan")
        .otherwise(price).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(every(43), "").when(every(47), F.lit(None).cast("string")).otherwise(F.col("l_linestatus")).alias("tags"),
    )


def customer_budget_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget plans per customer, derived from ``customer`` (one narrow scan).

    Each customer gets: two plans for ``4-NOT SPECIFIED`` (the larger wins),
    one for ``5-LOW``, and one for a category it never spends on
    (``0-SAVINGS``), so every budget case of the planner is exercised.
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    base = F.abs(F.col("c_acctbal"))
    plans = F.array(
        F.struct(F.lit("a").alias("k"), F.lit("4-NOT SPECIFIED").alias("category"), base.alias("lim")),
        F.struct(F.lit("b").alias("k"), F.lit("4-NOT SPECIFIED").alias("category"), (base / 2).alias("lim")),
        F.struct(F.lit("c").alias("k"), F.lit("5-LOW").alias("category"), (base * 3).alias("lim")),
        F.struct(F.lit("d").alias("k"), F.lit("0-SAVINGS").alias("category"), F.lit(100.0).alias("lim")),
    )
    x = c.select("c_custkey", F.explode(plans).alias("p"))
    return x.select(
        F.concat_ws("-", F.col("c_custkey").cast("string"), F.col("p.k")).alias("budget_id"),
        F.col("c_custkey").alias("entity_id"),
        F.col("p.category").alias("category"),
        F.round(F.col("p.lim").cast("decimal(28,8)"), 2).cast("double").alias("monthly_limit"),
    )


def orders_macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order-volume series derived from ``orders``: one series per order priority.

    Shape of saved macro observations: (series_id, date, value as text).
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    g = o.groupBy(
        F.col("o_orderpriority").alias("series_id"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("obs_date"),
    ).agg(F.sum(F.col("o_totalprice").cast(AMOUNT_TYPE)).alias("volume"))
    return g.select(
        "series_id",
        F.date_format("obs_date", "yyyy-MM-dd").alias("date"),
        F.col("volume").cast("string").alias("value"),
    )
