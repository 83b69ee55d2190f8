import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from ledgerlake.schema import TRANSACTIONS_SCHEMA  # noqa: E402
from ledgerlake.session import DEFAULT_CONF, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    b = SparkSession.builder.master("local[*]").appName("ledgerlake-tests").config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def tx(ym_day: str, category: str, type_: str, account: str, amount, entity=1, tid=None, tags="t"):
    """One canonical ledger row (ym_day = 'YYYY-MM-DD')."""
    d = dt.date.fromisoformat(ym_day)
    ts = dt.datetime(d.year, d.month, d.day, 12, 0, 0)
    return (
        tid or f"{ym_day}-{category}-{account}-{amount}",
        d, ts, d.year, d.month, f"{d.year:04d}-{d.month:02d}", category, type_, account,
        Decimal(str(amount)).quantize(Decimal("0.01")), "BYN", tags, "test", None, entity,
    )


@pytest.fixture(scope="session")
def make_ledger(spark):
    from pyspark.sql import types as T

    schema = T.StructType(TRANSACTIONS_SCHEMA.fields + [T.StructField("entity_id", T.LongType())])

    def _make(rows):
        fixed = []
        for i, r in enumerate(rows):
            r = list(r)
            r[0] = f"{r[0]}#{i}"
            fixed.append(tuple(r))
        return spark.createDataFrame(fixed, schema)

    return _make
