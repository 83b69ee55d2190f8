"""Macro indicators from saved observation series.

Observations are (series_id, date text, value text), with ``"."`` or null for
a missing value. Per series: the newest ``limit`` observations are taken
first and missing values dropped after (so one missing month in the window
suppresses the year-over-year figure, as in the source); the latest usable
value and date are reported, and YoY % = (v0 - v12) / v12 * 100, rounded 2,
when 13 usable observations remain.

``row_number() <= limit`` per series is planned with a partial
WindowGroupLimit, so a series with a third of all observations still sends
only ``limit`` rows per map task.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import round_dec

# The indicator series of the source and their labels.
DEFAULT_INDICATORS = {
    "CPIAUCSL": "Consumer Price Index (All Urban Consumers, seasonally adjusted)",
    "FEDFUNDS": "Effective Federal Funds Rate",
    "UNRATE": "Civilian Unemployment Rate",
}
YOY_SERIES = ("CPIAUCSL",)
MISSING_VALUE = "."


def macro_indicators(obs: DataFrame, limit: int = 13, yoy_series: Sequence[str] | None = YOY_SERIES,
                     labels: Mapping[str, str] | None = None, lag: int = 12) -> DataFrame:
    """Per series: label, latest_value, latest_date, n_usable, yoy_change_pct.

    ``yoy_series=None`` computes YoY for every series.
    """
    w = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    newest = obs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    usable = newest.where(F.col("value").isNotNull() & (F.col("value") != F.lit(MISSING_VALUE)))
    usable = usable.withColumn("_v", F.col("value").try_cast("double")).where(F.col("_v").isNotNull())
    usable = usable.withColumn("_pos", F.row_number().over(w))
    g = usable.groupBy("series_id").agg(
        F.max(F.when(F.col("_pos") == 1, F.col("_v"))).alias("latest_value"),
        F.max(F.when(F.col("_pos") == 1, F.col("date"))).alias("latest_date"),
        F.max(F.when(F.col("_pos") == lag + 1, F.col("_v"))).alias("_ago"),
        F.count(F.lit(1)).alias("n_usable"),
    )
    yoy = round_dec(F.try_divide((F.col("latest_value") - F.col("_ago")) * F.lit(100.0), F.nullif(F.col("_ago"), F.lit(0.0))), 2)
    wants = F.lit(True) if yoy_series is None else F.col("series_id").isin(list(yoy_series))
    labels = DEFAULT_INDICATORS if labels is None else labels
    label_map = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]) if labels else None
    return g.select(
        "series_id",
        (F.try_element_at(label_map, F.col("series_id")) if label_map is not None else F.lit(None).cast("string")).alias("label"),
        "latest_value",
        "latest_date",
        "n_usable",
        F.when(wants & (F.col("n_usable") >= lag + 1), yoy).alias("yoy_change_pct"),
    )
