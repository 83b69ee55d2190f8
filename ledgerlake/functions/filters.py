"""Ledger filter spec -> one Column predicate (F1, F2).

A falsy entry adds no clause, exactly like the page filters it mirrors:
``start_ym``/``end_ym`` compare ``year_month`` as text (inclusive), the lists
become ``IN`` clauses, ``year_month``/``type`` are single-value equalities.
The predicate is a plain Column, so Catalyst pushes it into the parquet scan
and prunes ``year_month`` partitions when the table is partitioned by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LedgerFilter:
    start_ym: str | None = None
    end_ym: str | None = None
    accounts: tuple = field(default_factory=tuple)
    categories: tuple = field(default_factory=tuple)
    types: tuple = field(default_factory=tuple)
    year_month: str | None = None
    type: str | None = None

    @classmethod
    def of(cls, spec: "LedgerFilter | Mapping | None") -> "LedgerFilter":
        if spec is None:
            return cls()
        if isinstance(spec, LedgerFilter):
            return spec
        vals = {}
        for k in ("start_ym", "end_ym", "year_month", "type"):
            if spec.get(k):
                vals[k] = spec[k]
        for k in ("accounts", "categories", "types"):
            if spec.get(k):
                vals[k] = tuple(spec[k])
        return cls(**vals)

    def with_types(self, types: Iterable[str]) -> "LedgerFilter":
        return replace(self, types=tuple(types))

    def clauses(self) -> list[Column]:
        out: list[Column] = []
        if self.start_ym:
            out.append(F.col("year_month") >= F.lit(self.start_ym))
        if self.end_ym:
            out.append(F.col("year_month") <= F.lit(self.end_ym))
        if self.year_month:
            out.append(F.col("year_month") == F.lit(self.year_month))
        if self.type:
            out.append(F.col("type") == F.lit(self.type))
        for values, column in ((self.accounts, "account"), (self.categories, "category"), (self.types, "type")):
            if values:
                out.append(F.col(column).isin(list(values)))
        return out

    def predicate(self) -> Column | None:
        cl = self.clauses()
        return reduce(lambda a, b: a & b, cl) if cl else None


_YM = re.compile(r"^(\d{4})-(\d{2})$")


def _month_start(ym: str | None, add: int = 0) -> str | None:
    m = _YM.match(ym or "")
    if not m:
        return None
    y, mo = int(m.group(1)), int(m.group(2)) + add
    y, mo = y + (mo - 1) // 12, (mo - 1) % 12 + 1
    return f"{y:04d}-{mo:02d}-01 00:00:00"


def implied_time_range(spec: LedgerFilter, df: DataFrame, ts_col: str = "transaction_datetime") -> list[Column]:
    """Timestamp bounds implied by month bounds (year_month is date_format(ts, 'yyyy-MM') in a ledger).

    They add nothing to the result (a missing timestamp passes) but, unlike a predicate on the derived
    ``year_month`` text, reach the parquet scan as pushed filters, so row
    groups outside the months are skipped by their min/max statistics.
    """
    if ts_col not in df.columns:
        return []
    t = df.schema[ts_col].dataType.simpleString()
    lo = _month_start(spec.year_month or spec.start_ym)
    hi = _month_start(spec.year_month or spec.end_ym, add=1)
    out = []
    if lo:
        out.append((F.col(ts_col) >= F.lit(lo).cast(t)) | F.col(ts_col).isNull())
    if hi:
        out.append((F.col(ts_col) < F.lit(hi).cast(t)) | F.col(ts_col).isNull())
    return out


def apply_filter(df: DataFrame, spec=None, push_time_range: bool = True) -> DataFrame:
    spec = LedgerFilter.of(spec)
    pred = spec.predicate()
    if pred is None:
        return df
    extra = implied_time_range(spec, df) if push_time_range else []
    return df.where(reduce(lambda a, b: a & b, extra, pred))
