"""Saved macro-series responses -> observation rows.

Each file holds one response body ``{"observations": [{"date": ..., "value": ...}, ...]}``;
the series id is the file's base name (``CPIAUCSL.json``) unless the body
carries a ``series_id`` field. Values stay text: ``"."`` marks a missing value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField(
            "observations",
            T.ArrayType(T.StructType([T.StructField("date", T.StringType()), T.StructField("value", T.StringType())])),
        ),
    ]
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(OBS_SCHEMA).option("multiLine", True).json(path)
    from_name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    sid = F.coalesce(F.col("series_id"), from_name)
    x = raw.select(sid.alias("series_id"), F.explode_outer("observations").alias("o"))
    return x.where(F.col("o").isNotNull()).select("series_id", F.col("o.date").alias("date"), F.col("o.value").alias("value"))
