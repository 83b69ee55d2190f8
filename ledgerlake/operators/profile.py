"""Data-quality profile.

Column profile: per column dtype, null count, null % (rounded 2), distinct
count (nulls ignored); numeric columns add min, max, mean, negative and zero
counts; other columns get their 10 most frequent values. Duplicate rows are
rows after the first of each identical group.

Plans:

* numeric and null statistics: one aggregate over all columns (one pass);
* distinct counts: one column at a time, read alone from the scan and
  de-duplicated map-side, so no row is multiplied by the columns;
* top values: a frequent-items summary of each column (``approx_top_k``, built
  map-side and merged, of fixed size) names candidates; a second pass counts
  them exactly. An item that is no candidate occurs at most as often as the least
  estimate among them, so if the n-th exact count is above that, or the
  candidates are all there is, the answer is proven; else the column's values
  are all counted;
* duplicates: 16-byte digests are counted, and only rows whose digest occurs
  twice are compared as whole rows;
* exact median: distinct values with their counts are ranked by range partition
  and offsets (``functions.ranking``), on the type of the column itself. No task
  sees all values, whether of the ledger or of one group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.assemble import merge_columns
from ..functions.exprs import round_dec
from ..functions.ranking import running_weight
from ..functions.stats import mean_from, stddev_samp_from, sum_sq

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TRACKED = 10_000  # items that the summary of a column keeps
CANDIDATES = 10  # candidates for each asked value


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    value = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
    return value.groupBy("value").agg(F.count(F.lit(1)).alias("count")).select(F.lit(column).alias("column_name"), "value", "count")


def _together(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, unique_count) of each column, nulls ignored."""
    one = [df.select(F.col(c).alias("v")).where(F.col("v").isNotNull()).distinct().agg(F.count(F.lit(1)).alias("unique_count"))
           .select(F.lit(c).alias("column_name"), "unique_count") for c in columns]
    return _together(one)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: dtype, null_count, null_pct, unique_count, min, max, mean, negative_count, zero_count."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n{i}"))
        if c in numeric:
            v = F.col(c).cast("double")
            aggs += [
                F.min(v).alias(f"mn{i}"),
                F.max(v).alias(f"mx{i}"),
                F.avg(v).alias(f"av{i}"),
                F.count_if(F.col(c) < 0).alias(f"ng{i}"),
                F.count_if(F.col(c) == 0).alias(f"z{i}"),
            ]
    stats = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        num = c in numeric
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(types[c].simpleString()).alias("dtype"),
                F.col(f"n{i}").alias("null_count"),
                (F.col(f"mn{i}") if num else F.lit(None).cast("double")).alias("min"),
                (F.col(f"mx{i}") if num else F.lit(None).cast("double")).alias("max"),
                (round_dec(F.col(f"av{i}"), 6) if num else F.lit(None).cast("double")).alias("mean"),
                (F.col(f"ng{i}") if num else F.lit(None).cast("long")).alias("negative_count"),
                (F.col(f"z{i}") if num else F.lit(None).cast("long")).alias("zero_count"),
            )
        )
    per_col = stats.select("_rows", F.inline(F.array(*rows)))
    per_col = per_col.withColumn(
        "null_pct", round_dec(F.try_divide(F.col("null_count") * F.lit(100.0), F.col("_rows").cast("double")), 2)
    )
    out = per_col.join(distinct_counts(df, columns), "column_name", "left")
    return out.select(
        "column_name", "dtype", "null_count", F.coalesce("null_pct", F.lit(0.0)).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "min", "max", "mean", "negative_count", "zero_count",
    )


def heavy_hitters(df: DataFrame, columns: Sequence[str], n: int) -> dict[str, list[tuple[str, int]] | None]:
    """The n most frequent values of each column with exact counts; None where the summary cannot prove them.

    What reaches the driver is bounded by the candidates: ``CANDIDATES`` * n a column.
    """
    k = CANDIDATES * n
    sketches = [F.expr(f"approx_top_k(cast(`{c}` as string), {k}, {max(TRACKED, k)})").alias(f"t{i}") for i, c in enumerate(columns)]
    totals = [F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    seen = df.agg(*sketches, *totals).first()
    found = {}
    for i, c in enumerate(columns):
        items = [(x["item"], x["count"]) for x in seen[f"t{i}"] if x["item"] is not None]
        found[c] = (items, seen[f"n{i}"])
    asked = [c for c in columns if found[c][0]]
    exact: dict[str, dict[str, int]] = {c: {} for c in columns}
    if asked:
        counts = _together([
            _value_counts(df.where(F.col(c).cast("string").isin([v for v, _ in found[c][0]])), c) for c in asked])
        for r in counts.collect():
            exact[r["column_name"]][r["value"]] = r["count"]
    out = {}
    for c in columns:
        items, total = found[c]
        best = sorted(exact[c].items(), key=lambda x: (-x[1], x[0].encode()))[:n]
        everything = sum(exact[c].values()) == total
        bound = min((estimate for _, estimate in items), default=0)
        out[c] = best if everything or (len(best) == n and best[-1][1] > bound) else None
    return out


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """Up to n most frequent non-null values per non-numeric column; ties by value ascending. Runs two jobs when called."""
    if columns is None:
        numeric = set(numeric_columns(df))
        columns = [c for c in df.columns if c not in numeric]
    schema = "column_name string, value string, count long, rank int"
    proven = heavy_hitters(df, columns, n)
    rows = [(c, v, m, i) for c, best in proven.items() if best is not None for i, (v, m) in enumerate(best, 1)]
    frames = [df.sparkSession.createDataFrame(rows, schema)]
    for c in columns:
        if proven[c] is None:
            counts = _value_counts(df, c).orderBy(F.col("count").desc(), F.col("value").asc()).limit(n)
            ordered = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "value"))).alias("best"))  # n items
            ranked = ordered.select(F.posexplode("best").alias("place", "b"))
            frames.append(ranked.select(F.lit(c).alias("column_name"), F.col("b.value").alias("value"), (-F.col("b.less")).alias("count"),
                                        (F.col("place") + 1).alias("rank")))
    return _together(frames)


def row_digest(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row; rows that differ may share them."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("again"), *reversed(columns))]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows after the first of each group of identical rows (nulls compare equal).

    Only digests are shuffled, and whole rows of those that occur more than once.
    """
    first, second = row_digest(df.columns)
    keyed = df.withColumn("_d1", first).withColumn("_d2", second)
    often = keyed.groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_d1", "_d2")
    alike = keyed.join(often, ["_d1", "_d2"], "left_semi")
    g = alike.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows"))


def exact_median(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median of a numeric column per ``by`` group, as double.

    Middle ranks k1 = (n-1)//2 and k2 = n//2; median = (v[k1] + v[k2]) / 2, like
    DuckDB's MEDIAN and pandas. Values are compared as they are, whatever the
    column's scale; the sum of the two is exact where it fits the type.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    rows, total = running_weight(counts, [*by, "_v"], "_c", "_before")
    if by:
        keys = [f"_k{i}" for i in range(len(by))]
        groups = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(F.min("_before").alias("_start"), F.sum("_c").alias("_n"))
        same = F.lit(True)
        for b, k in zip(by, keys):
            same = same & F.col(b).eqNullSafe(F.col(k))
        rows = rows.join(groups, same).drop(*keys)
    else:
        rows = rows.withColumn("_start", F.lit(0)).withColumn("_n", F.lit(total))
    lo = F.col("_before") - F.col("_start")
    holds = lambda k: (lo <= k) & (k < lo + F.col("_c"))
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    two = rows.where(holds(low) | holds(high)).groupBy(*by).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_v1"), F.max(F.when(holds(high), F.col("_v"))).alias("_v2"))
    exact = F.try_add("_v1", "_v2").cast("double") / 2
    apart = F.col("_v1").cast("double") / 2 + F.col("_v2").cast("double") / 2
    return two.select(*by, F.coalesce(exact, apart).alias("median"))


def amount_stats(ledger: DataFrame, by: Sequence[str] = (), col: str = "amount") -> DataFrame:
    """min, max, avg, sample std and exact median of the amount.

    Moments of a decimal are taken in whole units of its last digit, so that no
    product is rounded to Spark's 38 digits, whatever the column's scale.
    """
    kind = ledger.schema[col].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    unit = F.lit(10**scale).cast(f"decimal({scale + 1},0)")
    units = F.try_multiply(F.col(col), unit).cast("decimal(38,0)") if scale else F.col(col)
    rows = ledger.withColumn("_u", units)
    st = rows.groupBy(*by).agg(
        F.min(col).cast("double").alias("min_amount"),
        F.max(col).cast("double").alias("max_amount"),
        F.count(F.col(col)).alias("_n"), F.sum(F.col(col)).alias("_s1"), F.stddev_samp(F.col(col).cast("double")).alias("_w"),
        F.when(F.count("_u") == F.count(col), F.try_sum("_u")).alias("_u1"), sum_sq("_u").alias("_u2"),
    )
    st = st.withColumn("_u2", F.when(F.col("_u1").isNotNull(), F.col("_u2")))
    st = st.select(
        *by, "min_amount", "max_amount",
        mean_from("_n", "_s1").alias("avg_amount"),
        stddev_samp_from("_n", "_u1", "_u2", "_w", scale).alias("std_amount"),
    )
    med = exact_median(ledger, col, by)
    # join-free: both parts are one row per key
    return merge_columns([st, med], by)
