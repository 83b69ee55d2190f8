"""Ranks by range partition, exact medians at any scale, proven top values, duplicates by digest."""

import random
from collections import Counter
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import ranking as RK
from ledgerlake.operators import anomaly as AN
from ledgerlake.operators import budget as BU
from ledgerlake.operators import profile as PR
from ledgerlake.operators import trends as TR
from ledgerlake.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_weight_and_rank(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "a", "b", "c"]), r.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, w long").repartition(7)
    out, total = RK.running_weight(df, ["g", "id"], "w")
    before, want = 0, {}
    for i, _, w in sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0])):
        want[i], before = before, before + w
    assert total == before and {x.id: x.before for x in out.collect()} == want
    ranks = {x.id: x.rank for x in RK.global_rank(df, [F.col("id").desc()]).collect()}
    assert ranks == {i: 300 - i for i in range(300)}
    assert RK.running_weight(df.where("id < 0"), ["id"])[1] == 0


@pytest.mark.parametrize("kind,scale", [("decimal(20,4)", 4), ("decimal(38,6)", 6), ("decimal(10,0)", 0)])
def test_median_at_any_scale(spark, kind, scale):
    r = random.Random(scale)
    unit = Decimal(1).scaleb(-scale)
    big = 10**30 if kind == "decimal(38,6)" else 0
    rows = [(g, (Decimal(r.randint(-500, 900)) + big) * 1 * unit if scale else Decimal(r.randint(-500, 900))) for g in [1, 1, 2, 3, None] * 25]
    df = spark.createDataFrame([(g, str(v)) for g, v in rows], "g int, amount string").withColumn("amount", F.col("amount").cast(kind))
    assert PR.exact_median(df, "amount").first().median == float(median(v for _, v in rows))
    got = {x.g: x.median for x in PR.exact_median(df, "amount", by=["g"]).collect()}
    assert got == {g: float(median(v for k, v in rows if k == g)) for g in (1, 2, 3, None)}


def test_median_of_three_decimals_is_not_below_the_minimum(spark):
    df = spark.createDataFrame([("0.125",), ("0.127",), ("0.129",)], "amount string").withColumn("amount", F.col("amount").cast("decimal(20,4)"))
    got = PR.amount_stats(df).first()
    assert (got.min_amount, got.median, got.max_amount) == (0.125, 0.127, 0.129)


def test_no_window_over_everything(spark, make_ledger):
    """With by=() nothing runs in one task: no window without partition keys."""
    for name in ("amount_stats", "category_share", "budget_status", "top_anomalies", "category_breakdown_ordered"):
        text = plan_of(REGISTRY[name](spark, SF))
        assert "SinglePartition" not in "".join(line for line in text.splitlines() if "Window" in line), name
        for line in text.splitlines():
            if "Window [" in line:
                assert "], [" in line and not line.rstrip().endswith("[]"), (name, line)


def test_budget_ranks_of_the_whole_ledger(spark, make_ledger):
    from conftest import tx

    led = make_ledger([tx("2025-01-01", c, "Expense", "a", v) for c, v in [("x", 30), ("y", 40), ("z", 30), ("w", 1)]])
    plans = spark.createDataFrame([("x", 10.0), ("y", 10.0), ("z", 10.0), ("w", 10.0), ("none", 5.0)], "category string, monthly_limit double")
    got = {r.category: r.over_rank for r in BU.budget_status(led, plans).collect()}
    assert got == {"y": 1, "x": 2, "z": 3, "w": None, "none": None}  # ties by category
    share = {r.category: r.share_pct for r in TR.category_share(led).collect()}
    assert share["y"] == 39.6 and TR.category_share(led.limit(0)).count() == 0


def top_of(rows, n):
    return [(v, c) for v, c in sorted(Counter(v for v in rows if v is not None).items(), key=lambda x: (-x[1], x[0]))[:n]]


def test_top_values_proven_and_counted(spark):
    r = random.Random(9)
    skewed = [f"v{int(r.paretovariate(0.7)) % 5000}" for _ in range(20_000)]
    flat = [f"u{i}" for i in range(20_000)]  # no value is frequent: the summary proves nothing
    ties = [f"t{i % 40}" for i in range(20_000)]
    few = [None if i % 3 else "only" for i in range(20_000)]
    df = spark.createDataFrame(list(zip(skewed, flat, ties, few)), "skewed string, flat string, ties string, few string").repartition(5)
    proven = PR.heavy_hitters(df, df.columns, 10)
    assert proven["flat"] is None and proven["skewed"] is not None and proven["few"] is not None
    got = {}
    for x in PR.top_values(df).orderBy("column_name", "rank").collect():
        got.setdefault(x.column_name, []).append((x.value, x["count"]))
    for name, values in (("skewed", skewed), ("flat", flat), ("ties", ties), ("few", few)):
        assert got[name] == top_of(values, 10), name
    assert PR.top_values(df.limit(0)).count() == 0


def test_a_crowded_summary_is_never_believed(spark, monkeypatch):
    monkeypatch.setattr(PR, "TRACKED", 20)
    r = random.Random(1)
    for spread in (0.3, 1.0, 3.0):
        values = [f"v{int(r.paretovariate(spread)) % 3000}" for _ in range(5000)]
        df = spark.createDataFrame([(v,) for v in values], "a string").repartition(4)
        got = [(x.value, x["count"]) for x in PR.top_values(df, n=2).orderBy("rank").collect()]
        assert got == top_of(values, 2), spread


def test_profile_multiplies_no_row(spark):
    for name in ("column_profile", "top_values"):
        text = plan_of(REGISTRY[name](spark, SF))
        scans = [line for line in text.splitlines() if "FileScan" in line]
        assert "Expand" not in text and not ("Generate" in text and len(scans) < 2), name
    text = plan_of(PR.distinct_counts(REGISTRY["find_transactions"](spark, SF), ["transaction_id", "year_month"]))
    assert "Generate" not in text and "Expand" not in text


def test_equal_digests_are_told_apart(spark, monkeypatch):
    rows = [("a", 1), ("a", 1), ("b", 1), (None, 2), (None, 2), (None, 2), ("c", None), ("d", 4)]
    df = spark.createDataFrame(rows, "x string, y int")
    assert PR.duplicate_rows(df).first().duplicate_rows == 3
    monkeypatch.setattr(PR, "row_digest", lambda columns: [F.lit(1), F.lit(2)])
    assert PR.duplicate_rows(df).first().duplicate_rows == 3
    assert PR.duplicate_rows(df.limit(0)).first().duplicate_rows == 0
