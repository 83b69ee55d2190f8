"""Category -> transaction type."""

from __future__ import annotations

import json
from typing import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The category mapping of the source application.
# Any other category is an Expense (the default type).
DEFAULT_TYPE = "Expense"
DEFAULT_CATEGORY_MAPPING = {
    "Job": "Income",
    "Loan given": "Expense",
    "Other": "Expense",
    "Food": "Expense",
    "Cafe": "Expense",
    "Gifts": "Expense",
    "Bought for myself": "Expense",
    "Leisure": "Expense",
    "Health": "Expense",
    "Taxi": "Expense",
    "Clothes": "Expense",
    "Public transport": "Expense",
    "University": "Expense",
    "Fines": "Expense",
}
# Mapping used when the mapping file is absent (only Job is Income).
FALLBACK_CATEGORY_MAPPING = {"Job": "Income"}

def type_expr(category: Column | str, mapping: Mapping[str, str] | None = None, default: str = DEFAULT_TYPE) -> Column:
    """Type lookup as one expression: ``coalesce(try_element_at(map, category), default)``.

    The map is one literal, so there is no join and nothing to shuffle; a mapping
    of thousands of entries is better given as a table (``classify_with_table``).
    """
    mapping = DEFAULT_CATEGORY_MAPPING if mapping is None else mapping
    cat = F.col(category) if isinstance(category, str) else category
    if not mapping:
        return F.lit(default)
    table = F.from_json(F.lit(json.dumps(dict(mapping))), "map<string,string>")
    return F.coalesce(F.try_element_at(table, cat), F.lit(default))


def read_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    """The category mapping of a JSON file; the fallback mapping when the file is absent."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return dict(FALLBACK_CATEGORY_MAPPING)
    return json.loads(text.value)


def classify_with_table(df: DataFrame, mapping_df: DataFrame, default: str = DEFAULT_TYPE,
                        category_col: str = "category", out_col: str = "type") -> DataFrame:
    """Type lookup against a mapping table of (category, type) of any size; a category should occur once.

    No broadcast hint: the mapping size is unknown here, so the planner (and
    AQE at run time, from the actual size) chooses broadcast or shuffle join.
    """
    m = mapping_df.select(F.col("category").alias("_map_cat"), F.col("type").alias("_map_type"))
    out = df.join(m, F.col(category_col) == F.col("_map_cat"), "left")
    return out.withColumn(out_col, F.coalesce(F.col("_map_type"), F.lit(default))).drop("_map_cat", "_map_type")
