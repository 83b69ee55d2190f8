"""Join-free assembly of small per-key results.

Several aggregates keyed by the same columns (or by nothing) are combined
into one row per key without joins: each contributes rows of
(keys, position, '"name": <JSON>'); one ``union`` and one aggregate per key
gather them. For keyless (one-row) parts this avoids the nested-loop joins a
constant-key join turns into; for keyed parts it replaces a chain of joins by
a single shuffle of small rows.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json_value(df: DataFrame, name: str) -> Column:
    """JSON text of any column: objects/arrays directly, scalars through a one-element array."""
    v = F.col(name)
    if isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(v)
    arr = F.to_json(F.array(v))
    return arr.substr(F.lit(2), F.length(arr) - 2)


def json_object(parts: Sequence[tuple], by: Sequence[str] = (), out: str = "json") -> DataFrame:
    """``parts``: (field name, frame with ``by`` columns + a column of that name[, raw]).

    With ``raw=True`` the column already holds JSON text (e.g. an inner
    ``json_object``). Returns ``by`` + ``out`` = '{"field": <JSON>, ...}' in the given order.
    """
    rows = None
    for i, part in enumerate(parts):
        name, df = part[0], part[1]
        raw = len(part) > 2 and part[2]
        val = F.col(name) if raw else to_json_value(df, name)
        kv = F.concat(F.lit(json.dumps(name) + ":"), F.coalesce(val, F.lit("null")))
        r = df.select(*by, F.lit(i).alias("_pos"), kv.alias("_kv"))
        rows = r if rows is None else rows.unionByName(r)
    g = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_pos", "_kv"))).alias("_p"))
    body = F.array_join(F.transform(F.col("_p"), lambda e: e["_kv"]), ",")
    return g.select(*by, F.concat(F.lit("{"), body, F.lit("}")).alias(out))


def merge_columns(parts: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One row per key holding the columns of every part (each part: ``by`` + its own columns).

    Union with null padding, then ``max`` per column: every column has exactly
    one non-null contributor per key.
    """
    cols: list[str] = []
    types = {}
    for p in parts:
        for f in p.schema.fields:
            if f.name not in by and f.name not in types:
                cols.append(f.name)
                types[f.name] = f.dataType
    rows = None
    for p in parts:
        r = p.select(*by, *[(F.col(c) if c in p.columns else F.lit(None).cast(types[c])).alias(c) for c in cols])
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy(*by).agg(*[F.max(c).alias(c) for c in cols])


def json_document(parts: Sequence[tuple], by: Sequence[str] = (), out: str = "json") -> DataFrame:
    """One JSON object per key from object and list sections, gathered by a single aggregate.

    ``parts``: (name, frame, kind[, order]) where kind is ``"object"`` (the
    frame has ``by`` + a column ``name``, one row per key) or ``"list"`` (the
    frame has ``by`` + the element columns, any number of rows per key;
    ``order`` = (numeric column or None, text column or None) sorts the
    elements). Every section's rows are rendered to JSON text where they are,
    then one ``union`` and one ``groupBy(by)`` collect them; lists are built
    from the collected, sorted elements. The number of shuffles does not grow
    with the number of sections; sections that are all partitioned by ``by``
    keep that partitioning through the union.
    """
    rows = None
    kinds = []
    for i, part in enumerate(parts):
        name, df, kind = part[0], part[1], part[2]
        kinds.append((name, kind))
        if kind == "object":
            js = to_json_value(df, name)
            o1, o2 = F.lit(None).cast("double"), F.lit(None).cast("string")
        else:
            cols = [c for c in df.columns if c not in by and not c.startswith("_")]  # "_" columns: order keys only
            js = F.to_json(F.struct(*[F.col(c) for c in cols]))
            order = part[3] if len(part) > 3 else (None, None)
            o1 = F.col(order[0]).cast("double") if order[0] else F.lit(None).cast("double")
            o2 = F.col(order[1]).cast("string") if order[1] else F.lit(None).cast("string")
        r = df.select(*by, F.lit(i).alias("_pos"), o1.alias("_o1"), o2.alias("_o2"), js.alias("_js"))
        rows = r if rows is None else rows.unionByName(r)
    g = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_pos", "_o1", "_o2", "_js"))).alias("_p"))
    def of_section(i):
        # one-argument lambda: Spark passes (element, index) to two-argument ones
        return lambda e: e["_pos"] == F.lit(i)

    pieces = []
    for i, (name, kind) in enumerate(kinds):
        sel = F.transform(F.filter(F.col("_p"), of_section(i)), lambda e: e["_js"])
        if kind == "object":
            val = F.coalesce(F.get(sel, 0), F.lit("null"))
        else:
            val = F.concat(F.lit("["), F.array_join(sel, ","), F.lit("]"))
        pieces.append(F.concat(F.lit(json.dumps(name) + ":"), val))
    body = F.concat_ws(",", *pieces)
    return g.select(*by, F.concat(F.lit("{"), body, F.lit("}")).alias(out))
