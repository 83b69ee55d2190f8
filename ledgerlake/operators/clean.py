"""Raw transaction log -> canonical transactions.

Order of the rules follows the source: drop rows whose date does not parse,
then rows whose amount does not parse (a row bad in both is counted once, as a
bad date), then rows whose amount the amount type cannot hold as it is (too many
decimals, too large, infinite: nothing is rounded). ``rejected_transactions`` has
every dropped row with its reason, so rows in = rows out + rejected. Then take
the magnitude of the amount, strip the four text columns
(missing -> the text ``nan``), derive date parts, classify the type, stamp
provenance, assign the stable id, project the 14 canonical columns.

Everything is column expressions on one scan plus the id step
(``operators.stable_id``); the load metrics ride along as an ``Observation``
on the same job instead of extra counts.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import AMOUNT_TYPE, CANONICAL_COLUMNS, REQUIRED_RAW_COLUMNS
from .classify import DEFAULT_TYPE, classify_with_table, type_expr
from .stable_id import DEFAULT_CHUNK_ROWS, assign_stable_ids

DEFAULT_DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
TEXT_COLUMNS = ("category", "account", "currency", "tags")
# The tokens a pandas CSV read turns into a missing value (its
# default ``na_values``); a missing text value becomes the text "nan".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
MISSING_TEXT = "nan"


class TransformError(RuntimeError):
    """The raw frame cannot be transformed (e.g. it is empty)."""


# The characters that Python's str.strip removes (its white space).
STRIPPED = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIPPED))


def parse_datetime(c: Column, formats: Sequence[str] = DEFAULT_DATETIME_FORMATS) -> Column:
    """Text -> timestamp_ntz, null when nothing parses.

    ISO forms (with or without ``T``, fractions of a second, a zone) are cast
    without passing through the session's time zone: the written clock time is
    kept. A slash date counts as a dash date; ``formats`` are tried last.
    """
    s = strip(c)
    plain = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ][\d:.]*)?$")  # nothing to replace: by far the most rows
    iso = F.regexp_replace(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"\s*(?:Z|UTC|[+-]\d{2}:?\d{2})$", "")
    day = F.when(plain, s).when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), iso)
    tries = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in formats if f not in DEFAULT_DATETIME_FORMATS]
    return F.coalesce(day.try_cast("timestamp_ntz"), *tries)


def parse_amount(c: Column) -> Column:
    """Text -> double; null for non-numeric text and NaN.

    Text without a digit is a number only as a form of infinity; it is not cast, since a cast that fails costs an exception.
    """
    s = strip(c)
    return F.nullif(F.when(s.rlike("[0-9]|(?i:inf)"), s.try_cast("double")), F.lit(float("nan")))


def exact_amount(v: Column, amount_type: str) -> Column:
    """The double as ``amount_type``; null for a value that the type cannot hold as it is."""
    d = v.try_cast(amount_type)
    return F.when(d.cast("double") == v, d)


BAD_DATE, BAD_AMOUNT, UNFIT_AMOUNT = "bad_date", "bad_amount", "unfit_amount"


def reject_reason(formats: Sequence[str] = DEFAULT_DATETIME_FORMATS, amount_type: str = AMOUNT_TYPE) -> Column:
    """Why a raw row (date_time, amount) is dropped; null for a row that is kept. The amount is parsed once."""
    def unfit(amount: Column) -> Column:
        return F.when(amount.isNull(), BAD_AMOUNT).when(exact_amount(F.abs(amount), amount_type).isNull(), UNFIT_AMOUNT)

    by_amount = F.transform(F.array(parse_amount(F.col("amount"))), unfit)[0]
    return F.when(parse_datetime(F.col("date_time"), formats).isNull(), BAD_DATE).otherwise(by_amount)


def rejected_transactions(raw: DataFrame, formats: Sequence[str] = DEFAULT_DATETIME_FORMATS, amount_type: str = AMOUNT_TYPE) -> DataFrame:
    """The rows of ``raw`` that ``clean_transactions`` drops, as they are, with their ``reason``."""
    # exploded instead of filtered: a filter would work out the reason a second time, below the projection
    return raw.withColumn("reason", F.explode(F.array_compact(F.array(reject_reason(formats, amount_type)))))


def clean_text(c: Column, missing_text: str | None = MISSING_TEXT) -> Column:
    """Strip; a missing value (null or a missing-value token) becomes ``missing_text``."""
    is_missing = c.isNull() | c.isin(list(MISSING_TOKENS))
    return F.when(is_missing, F.lit(missing_text)).otherwise(strip(c))


def clean_transactions(raw: DataFrame, source: str = "csv_seed", mapping: Mapping[str, str] | DataFrame | None = None,
                       default_type: str = DEFAULT_TYPE, formats: Sequence[str] = DEFAULT_DATETIME_FORMATS,
                       missing_text: str | None = MISSING_TEXT, require_non_empty: bool = False,
                       observation: Observation | None = None, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                       drop_duplicate_ids: bool = False, amount_type: str = AMOUNT_TYPE) -> DataFrame:
    """Canonical transactions from a raw all-text log with the six required columns.

    ``mapping`` is a dict, or a table of (category, type), which is joined. A
    row whose amount ``amount_type`` cannot hold exactly (too large, too many
    decimals) is rejected, never rounded; take a wider type to keep it.

    ``require_non_empty`` runs one small job (``isEmpty``) to raise on an empty
    input like the source does; the default skips it. ``observation`` collects
    rows_in, bad_date, bad_amount, unfit_amount, rows_out, income_rows,
    expense_rows when the result is first computed: rows_in is the sum of the next four.
    """
    missing = [c for c in REQUIRED_RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"Dataset is missing required columns: {missing}")
    if require_non_empty and raw.isEmpty():
        raise TransformError("Cannot transform an empty dataframe.")

    ts = parse_datetime(F.col("date_time"), formats)
    amt = F.abs(parse_amount(F.col("amount")))
    staged = raw.select(
        F.col("date_time").cast("string").alias("date_time"),
        ts.alias("_ts"),
        amt.alias("_amt"),
        exact_amount(amt, amount_type).isNotNull().alias("_fits"),
        *[clean_text(F.col(c).cast("string"), missing_text).alias(c) for c in TEXT_COLUMNS],
    )
    table = mapping if isinstance(mapping, DataFrame) else None
    if observation is not None:
        parsed = F.col("_ts").isNotNull() & F.col("_amt").isNotNull()
        good = parsed & F.col("_fits")
        if table is not None:
            staged = classify_with_table(staged, table, default_type)
        typ = F.col("type") if table is not None else type_expr(F.col("category"), mapping, default_type)
        staged = staged.observe(
            observation,
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(F.col("_ts").isNull()).alias("bad_date"),
            F.count_if(F.col("_ts").isNotNull() & F.col("_amt").isNull()).alias("bad_amount"),
            F.count_if(parsed & ~F.col("_fits")).alias("unfit_amount"),
            F.count_if(good).alias("rows_out"),
            F.count_if(good & (typ == "Income")).alias("income_rows"),
            F.count_if(good & (typ == "Expense")).alias("expense_rows"),
        )
    kept = staged.where(F.col("_ts").isNotNull() & F.col("_amt").isNotNull() & F.col("_fits")).select(
        "date_time", "category", "account", F.col("_amt").cast("string").alias("amount_text"), "tags", "currency",
    )
    # the parsed timestamp and amount are functions of the hashed text: recomputed after the id step
    # instead of travelling through its shuffles
    ided = assign_stable_ids(kept, ["date_time", "category", "account", "amount_text", "tags"], ["currency"],
                             chunk_rows=chunk_rows, drop_duplicate_ids=drop_duplicate_ids)
    ided = ided.withColumn("_ts", parse_datetime(F.col("date_time"), formats)).withColumn(
        "_amt", F.col("amount_text").cast("double"))
    if table is not None:
        ided = classify_with_table(ided, table, default_type)
    ts = F.col("_ts")
    out = ided.select(
        "transaction_id",
        F.to_date(ts).alias("transaction_date"),
        ts.alias("transaction_datetime"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.date_format(ts, "yyyy-MM").alias("year_month"),
        "category",
        F.col("type") if table is not None else type_expr(F.col("category"), mapping, default_type).alias("type"),
        "account",
        F.col("_amt").cast(amount_type).alias("amount"),  # fits, or the row would not be here
        "currency",
        "tags",
        F.lit(source).alias("source"),
        F.current_timestamp().alias("ingested_at"),
    )
    return out.select(*CANONICAL_COLUMNS)
