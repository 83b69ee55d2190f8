"""Exact median and column profile against brute force; macro fixtures (FX10); the driver contract."""

import json
import os
import random
import tempfile
from decimal import Decimal

import numpy as np
import pandas as pd

from ledgerlake.operators import macro as MA
from ledgerlake.operators import profile as PR
from ledgerlake.sources.macro import read_observations


def dec_median(vals):
    v = sorted(vals)
    n = len(v)
    return float((v[(n - 1) // 2] + v[n // 2]) / 2)


def test_exact_median_matches_brute_force(spark):
    rnd = random.Random(3)
    for n in (1, 2, 7, 10, 501):
        vals = [Decimal(rnd.randint(-500000, 5_000_000_000)) / 100 for _ in range(n)]
        vals += [Decimal("10485.76")] * (n % 3)   # a bucket boundary value, repeated
        df = spark.createDataFrame([(1 if i % 2 else 2, v) for i, v in enumerate(vals)], "g int, amount decimal(18,2)")
        got = PR.exact_median(df, "amount").collect()[0].median
        assert got == dec_median(vals)
        assert abs(got - float(np.median([float(v) for v in vals]))) <= 1e-9 * max(1.0, abs(got))
        per = {r.g: r.median for r in PR.exact_median(df, "amount", by=["g"]).collect()}
        for g in per:
            assert per[g] == dec_median([v for i, v in enumerate(vals) if (1 if i % 2 else 2) == g])


def test_column_profile_and_top_values(spark):
    pdf = pd.DataFrame({"a": [1.0, -2.0, 0.0, None, 1.0], "b": ["x", "y", "x", None, "x"]})
    df = spark.createDataFrame([(None if pd.isna(a) else a, b) for a, b in zip(pdf.a, pdf.b)], "a double, b string")
    prof = {r.column_name: r for r in PR.column_profile(df).collect()}
    assert prof["a"].null_count == 1 and prof["a"].null_pct == 20.0 and prof["a"].unique_count == pdf.a.nunique()
    assert (prof["a"].min, prof["a"].max, prof["a"].negative_count, prof["a"].zero_count) == (-2.0, 1.0, 1, 1)
    assert prof["b"].unique_count == 2 and prof["b"].min is None
    top = [(r.value, r["count"]) for r in PR.top_values(df).orderBy("rank").collect()]
    assert top == [("x", 3), ("y", 1)]
    dups = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None)], "x int, y string")
    assert PR.duplicate_rows(dups).collect()[0].duplicate_rows == 3


def _write_series(d, sid, values):
    obs = [{"date": f"{2025 - i // 12}-{12 - i % 12:02d}-01", "value": v} for i, v in enumerate(values)]
    with open(os.path.join(d, f"{sid}.json"), "w") as f:
        json.dump({"observations": obs}, f)


def test_macro_fixtures(spark):
    d = tempfile.mkdtemp(prefix="ll-macro-")
    _write_series(d, "CPIAUCSL", [str(320 - i) for i in range(13)])            # 13 good values: YoY set
    _write_series(d, "FEDFUNDS", ["4.33"] + ["."] + ["4.3"] * 11 + ["4.1"])      # a missing value inside the 13
    _write_series(d, "UNRATE", [])                                               # no rows: absent
    obs = read_observations(spark, d)
    out = {r.series_id: r for r in MA.macro_indicators(obs, yoy_series=None).collect()}
    assert set(out) == {"CPIAUCSL", "FEDFUNDS"}
    assert out["CPIAUCSL"].latest_value == 320.0 and out["CPIAUCSL"].latest_date == "2025-12-01"
    assert out["CPIAUCSL"].yoy_change_pct == round((320 - 308) / 308 * 100, 2)
    assert out["FEDFUNDS"].yoy_change_pct is None and out["FEDFUNDS"].n_usable == 12
    assert out["CPIAUCSL"].label.startswith("Consumer Price Index")


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 60
