"""Appends of small batches look their keys up instead of reading the key column."""

from pyspark.sql import functions as F

from ledgerlake.session import scratch_path
from ledgerlake.sources import store as ST


def hashed(spark, lo, hi):
    return spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 24).alias("transaction_id"), "id")


def scanned_rows(df):
    """Rows that the file scans of an executed frame gave out."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
            continue
        if hasattr(p, "plan") and p.nodeName().endswith("QueryStage"):
            plans.append(p.plan())
            continue
        if p.nodeName().startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        children = p.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


def test_lookup_skips_most_of_the_table(spark, monkeypatch):
    root = scratch_path(spark, "blooms")
    n = 80_000
    ST.replace_table(hashed(spark, 0, n).repartition(40), root, key="transaction_id")  # random ids: ranges of files overlap
    table = ST.read_or_none(spark, root)
    keys = [r[0] for r in hashed(spark, n - 3, n + 997).select("transaction_id").collect()]
    seen = []
    collect = type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda self: seen.append((self, collect(self))) or seen[-1][1])
    known = ST.known_keys(table, keys, "transaction_id")
    monkeypatch.undo()
    assert len(known) == 3
    assert scanned_rows(seen[-1][0]) <= n / 40 * 8  # the files of three keys, and few by chance


def test_appends_by_lookup_equal_appends_by_join(spark, monkeypatch):
    for limit in (1000, 0):
        monkeypatch.setattr(ST, "LOOKED_UP", limit)
        root = scratch_path(spark, "appends")
        ST.append_table(hashed(spark, 0, 50), root)
        ST.append_table(hashed(spark, 30, 70), root)
        twice = hashed(spark, 65, 75)
        ST.append_table(twice.unionByName(twice), root)  # repeats inside a batch stay, as in the source
        got = sorted(r.id for r in ST.read_current(spark, root).select("id").collect())
        assert got == sorted([*range(70), *range(70, 75), *range(70, 75)])
        ST.append_table(hashed(spark, 0, 0), root)
        assert ST.read_current(spark, root).count() == 80
