"""Table operations of the operational stores, as Spark jobs.

The source keeps transactions and summaries in a document store (keyed
``$set`` upserts) and a warehouse (stage table + ``MERGE``). Both reduce to
one relational operator, the keyed upsert::

    result = current LEFT ANTI updates  UNION ALL  updates

A catalog whose tables support row-level operations runs it as ``MERGE INTO``
(``merge_into``). For plain parquet folders, ``append_table`` adds files and
rewrites nothing; ``upsert_table`` partitions the table by a hash bucket of the
key, which a key never leaves, and overwrites the buckets that a batch touches.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folders as FO

BUCKET = "key_bucket"
LOOKED_UP = 1000  # keys of a batch that are looked up through the files' Bloom filters; more are joined

# Bloom filters of the key: one in 100,000 by chance, so that a thousand keys still leave 99 of 100 row groups out.
BLOOM = {"enabled#KEY": "true", "fpp#KEY": "0.00001", "adaptive.enabled": "true", "max.bytes": str(8 << 20)}


# --- SQL access (S5, S6) --------------------------------------------------------------
def register(df: DataFrame, name: str = "transactions") -> DataFrame:
    """Expose a frame to SQL under ``name`` (a temporary view; nothing is copied)."""
    df.createOrReplaceTempView(name)
    return df


def run_query(spark: SparkSession, sql: str, params: Sequence[object] | Mapping[str, object] | None = None) -> DataFrame:
    """Ad-hoc SQL with positional ``?`` (list) or named ``:name`` (dict) parameters, bound by Spark."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def cache_key(*cols: Column | str) -> Column:
    """Deterministic key of a document and a question (D7): sha256 of their JSON/text, for de-duplicating reports."""
    return F.sha2(F.concat_ws("\u0001", *[F.col(c) if isinstance(c, str) else c for c in cols]), 256)


# --- pure DataFrame operators -------------------------------------------------------
def append_new(existing: DataFrame, incoming: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing`` (S4, J2), wherever it is held there.

    As in the source, duplicates inside one incoming batch are not removed.
    The key is never null (ids are generated), so a plain left anti join has
    ``NOT IN`` semantics. Of the existing table only the key column is read, and
    only keys that the batch holds too reach the anti join: with a batch below
    the broadcast threshold the existing keys are not shuffled.
    """
    batch_keys = incoming.select(key).distinct()
    seen = existing.select(key).join(batch_keys, key, "left_semi")
    return incoming.join(seen, key, "left_anti").select(*incoming.columns)


def known_keys(table: DataFrame, keys: Sequence[object], key: str) -> list:
    """Which of some keys a table holds: a scan that skips row groups by their Bloom filters and statistics.

    The keys are pushed into the scan as equalities, which is what a Bloom
    filter can answer; Spark would otherwise replace a long list by its range.
    """
    spark = table.sparkSession
    limit = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(max(len(keys), int(before))))
    try:
        return [r[0] for r in table.select(key).where(F.col(key).isin(list(keys))).distinct().collect()]
    finally:
        spark.conf.set(limit, before)


def restrict_to_touched(table: DataFrame, changes: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """Rows of ``table`` in the partitions that ``changes`` touch: a semi-join on the partition columns.

    On a table partitioned by them, dynamic partition pruning skips the others.
    """
    cols = list(partition_cols)
    if not cols:
        return table
    return table.join(changes.select(*cols).distinct(), cols, "left_semi").select(*table.columns)


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Column | str | None = None,
           flag: str | None = None) -> DataFrame:
    """Keyed upsert, field by field (S7-S10): an update overwrites the columns it has, or is inserted.

    Columns of ``current`` that ``updates`` lacks keep their value (null in
    inserted rows). Of several updates for one key the last by ``order_by``
    wins; without an order they may not differ, as rows of a distributed batch
    have none of their own: two that do are an error that names the key.
    ``flag`` adds a column saying ``kept``/``updated``/``inserted``.
    """
    keys = list(keys)
    cols = [c for c in updates.columns if c not in keys]
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    if order is None:
        return _merged(current, _only_update(updates, keys, cols), updates.columns, keys, flag)
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in cols], F.lit(1).alias("_")), order).alias("_u"))
    return _merged(current, last, updates.columns, keys, flag)


def _only_update(updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The update of each key; an error if two of one key differ."""
    row = F.struct(*[F.col(c) for c in cols], F.lit(1).alias("_"))
    found = updates.groupBy(*keys).agg(F.min(row).alias("_u"), F.max(row).alias("_other"))
    which = F.concat(F.lit("updates of one key differ and order_by is not given: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_u").eqNullSafe(F.col("_other")), F.col("_u")).otherwise(F.raise_error(which).cast(found.schema["_u"].dataType))
    return found.select(*keys, checked.alias("_u"))


def _merged(current: DataFrame, last: DataFrame, columns: Sequence[str], keys: list[str], flag: str | None) -> DataFrame:
    """``current`` with the last updates (keys, _u) put in."""
    absent = [c for c in current.columns if c not in columns]
    kept = current.join(last.select(*keys), keys, "left_anti")
    if absent or flag:
        have = current.select(*keys, F.lit(True).alias("_hit"), *absent)
        merged = last.join(have, keys, "left")
    else:
        merged = last
    merged = merged.select(
        *[F.col(c) if c in keys or c in absent else F.col(f"_u.`{c}`").alias(c) for c in current.columns],
        *([F.when(F.col("_hit"), "updated").otherwise("inserted").alias(flag)] if flag else []),
    )
    return (kept.withColumn(flag, F.lit("kept")) if flag else kept).unionByName(merged)


def find_rows(df: DataFrame, query: Mapping[str, object] | None = None, limit: int = 0) -> DataFrame:
    """Equality filter on a field map, optional limit; 0 = all."""
    out = df
    for k, v in (query or {}).items():
        out = out.where(F.col(k).isNull() if v is None else (F.col(k) == F.lit(v)))
    return out.limit(limit) if limit else out


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str = "created_at", tie: Sequence[str] = ()) -> DataFrame:
    """Latest row per key (S17) with ``max_by``: one aggregate, partially combined per map task."""
    keys = list(keys)
    cols = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts), *[F.col(t) for t in tie])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")


def newest_n(df: DataFrame, n: int = 50, ts: str = "created_at", tie: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` rows (S16): TakeOrderedAndProject, n rows per partition then a merge."""
    return df.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in tie]).limit(n)


def with_variant(df: DataFrame, json_cols: Iterable[str]) -> DataFrame:
    """Parse JSON text columns to VARIANT (S15); invalid JSON becomes null."""
    out = df
    for c in json_cols:
        out = out.withColumn(c, F.try_parse_json(F.col(c)))
    return out


def fold_changes(current: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], ts: str = "changed_at",
                 tie: Sequence[str] = ()) -> DataFrame:
    """What applying a log of changes one after another leaves (S14): key, fields, created_at, updated_at.

    ``changes``: (op, key, fields, ts), op create / update / delete, applied in
    the order of ``ts`` and then ``tie``; changes equal in both must not contradict each other. Per key:

    * a delete ends what was there; an update or delete of an absent key does nothing;
    * a create begins anew with the fields it carries; on a key that is there it counts as an update;
    * an update sets the fields that it carries (not null) and ``updated_at``.

    Sequential semantics as aggregates, so no task sees all changes of a key in
    a row: the last delete of a key, the first create after it, and, of the
    changes from there on, the last value of each field.
    """
    at = F.struct(ts, *tie)
    log = changes.where(F.col("op").isin("create", "update", "delete")).withColumn("_at", at)
    ends = log.where("op = 'delete'").groupBy(key).agg(F.max("_at").alias("_end"))
    alive = log.where("op <> 'delete'").join(ends, key, "left").where(F.col("_end").isNull() | (F.col("_at") > F.col("_end")))
    alive = alive.join(current.select(key, F.lit(True).alias("_was")), key, "left")
    # a key that was there and is not deleted goes on from its row; else the first create begins it
    goes_on = F.col("_was").isNotNull() & F.col("_end").isNull()
    begins = alive.where(~goes_on & (F.col("op") == "create")).groupBy(key).agg(F.min("_at").alias("_begin"))
    counted = alive.join(begins, key, "left").where(goes_on | (F.col("_at") >= F.col("_begin")))
    later = F.col("_begin").isNull() | (F.col("_at") > F.col("_begin"))
    folded = counted.groupBy(key).agg(
        F.first("_begin").alias("_begin"),
        F.max(F.when(later, F.col("_at"))).alias("_last"),
        # one struct for each field: max_by would skip nulls of the value, not of the order
        *[F.max(F.when(F.col(f).isNotNull(), F.struct(F.col("_at"), F.col(f).alias("v")))).alias(f"_f_{f}") for f in fields],
    )
    old = current.join(ends, key, "left").select(
        key, F.struct(*[F.col(c) for c in (*fields, "created_at", "updated_at")]).alias("_old"), F.col("_end").isNotNull().alias("_gone"))
    both = old.join(folded, key, "full_outer")
    stays = F.col("_old").isNotNull() & ~F.coalesce("_gone", F.lit(False))
    kept = lambda c: F.when(stays, F.col(f"_old.{c}"))
    return both.where(stays | F.col("_begin").isNotNull()).select(
        key,
        *[F.coalesce(F.col(f"_f_{f}.v"), kept(f)).alias(f) for f in fields],
        F.coalesce(kept("created_at"), F.col(f"_begin.{ts}")).alias("created_at"),
        F.coalesce(F.col(f"_last.{ts}"), kept("updated_at")).alias("updated_at"),
    )


PLAN_FIELDS = ("category", "monthly_limit", "applies_from", "notes")


def apply_plan_changes(plans: DataFrame, changes: DataFrame, key: str = "budget_id", ts: str = "changed_at",
                       tie: Sequence[str] = ()) -> DataFrame:
    """Budget plans after a batch of changes (S14), any number of them for one plan: see ``fold_changes``."""
    return fold_changes(plans, changes, key, PLAN_FIELDS, ts, tie)


def first_non_empty(readers: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """First reader whose frame has a row (S19): ``take(1)`` per candidate, in order."""
    last = None
    for r in readers:
        try:
            df = r()
        except Exception:  # noqa: BLE001  (an unavailable source falls through)
            continue
        last = df
        if df.take(1):
            return df
    if last is None:
        raise RuntimeError("no readable source")
    return last


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema.fields)


def create_tables(spark: SparkSession, tables: Mapping[str, T.StructType], location_root: str | None = None,
                  database: str | None = None) -> list[str]:
    """CREATE TABLE IF NOT EXISTS .. USING parquet for each schema."""
    created = []
    for name, schema in tables.items():
        full = f"{database}.{name}" if database else name
        loc = f" LOCATION '{location_root.rstrip('/')}/{name}'" if location_root else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({ddl(schema)}) USING parquet{loc}")
        created.append(full)
    return created


# --- parquet tables -----------------------------------------------------------------
def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet data at ``path``, or None when the path is missing or holds no data files."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of a table written by this module, or None."""
    table = read_or_none(spark, root)
    return None if table is None else table.drop(BUCKET)


def _writer(df: DataFrame, mode: str, key: str | None = None):
    """A parquet writer; with a key, every row group gets a Bloom filter of it, sized to its keys."""
    w = df.write.mode(mode)
    if key is not None:
        for name, value in BLOOM.items():
            w = w.option(f"parquet.bloom.filter.{name}".replace("KEY", key), value)
    return w


def write_rows(df: DataFrame, root: str, partition_by: Sequence[str] = (), mode: str = "append", key: str | None = None) -> str:
    """Write ``df`` by partition with few files: rows are rebalanced on the partition
    columns first, so a partition gets one file, and a hot one several (by size)."""
    parts = list(partition_by)
    if not parts:
        _writer(df, mode, key).parquet(root)
        return root
    even = df.hint("rebalance", *parts)
    w = _writer(even, mode, key).partitionBy(*parts)
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(root)
    return root


def replace_table(df: DataFrame, root: str, partition_by: Sequence[str] = (), key: str | None = None) -> str:
    """``mode="replace"`` (S3): the frame becomes the table; ``key`` is the column that appends look up."""
    even = df.hint("rebalance", *partition_by) if partition_by else df
    w = _writer(even, "overwrite", key).option("partitionOverwriteMode", "static")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(root)
    return root


def append_table(df: DataFrame, root: str, key: str = "transaction_id", partition_by: Sequence[str] = ()) -> str:
    """``mode="append"`` (S4): add rows whose key is absent, as new files; creates the table when absent.

    A batch of up to ``LOOKED_UP`` keys is looked up (``known_keys``): of files
    written by this module with their key, only row groups whose Bloom filter
    lets one of the keys pass are read. A larger batch is joined with the key column.
    """
    cur = read_or_none(df.sparkSession, root)
    if cur is not None:
        keys = [r[0] for r in df.select(key).distinct().limit(LOOKED_UP + 1).collect()]
        if len(keys) <= LOOKED_UP:
            known = known_keys(cur, keys, key)
            df = df.where(~F.col(key).isin(known)) if known else df
        else:
            df = append_new(cur, df, key)
    return write_rows(df, root, partition_by, key=key)


BUCKET_ROWS = 1_000_000  # of a table that ``upsert_table`` writes: about so many rows a bucket, at most four times as many


def _layout(spark: SparkSession, root: str) -> int | None:
    """The number of buckets of a table, kept beside it."""
    path = f"{root.rstrip('/')}/_layout"
    return spark.read.parquet(path).first()["buckets"] if FO.finished(spark, path) else None


def _in_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _dealt_anew(spark: SparkSession, root: str, keys: Sequence[str], buckets: int | None) -> None:
    """Deal the table over another number of buckets; with None, go on with what a lost job has begun.

    The table is written whole beside itself first, with its layout; from then on that copy is what counts.
    """
    stage, layout = f"{root.rstrip('/')}/_dealt", f"{root.rstrip('/')}/_layout"
    if buckets is not None:
        FO.delete(spark, stage)
        rows = read_current(spark, root)
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{root.rstrip('/')}/_dealt_layout")
        replace_table(_in_buckets(rows, keys, buckets), stage, [BUCKET])
    if FO.finished(spark, stage):
        for folder in FO.numbered(spark, root, BUCKET):
            FO.delete(spark, f"{root.rstrip('/')}/{BUCKET}={folder}")
        # copied, not moved: until the stage is deleted a retry can repeat all of this
        write_rows(spark.read.parquet(stage), root, [BUCKET], "overwrite")
        spark.read.parquet(f"{root.rstrip('/')}/_dealt_layout").write.mode("overwrite").parquet(layout)
        FO.delete(spark, stage)


def upsert_table(updates: DataFrame, root: str, keys: Sequence[str], order_by: Column | str | None = None,
                 buckets: int | None = None) -> dict:
    """Keyed upsert into a parquet table partitioned by a hash bucket of the key.

    Only the buckets that the updates touch are read and overwritten. Returns
    the path and inserted/updated/kept counts (kept: within touched buckets),
    which ride on the write job as an ``Observation``. The number of buckets is
    taken from the first batch (``BUCKET_ROWS`` rows each, or as given), kept
    beside the table, and raised fourfold when the table has outgrown it, so
    that a bucket stays a few files and a batch rewrites what it has to.
    """
    spark = updates.sparkSession
    _dealt_anew(spark, root, keys, None)
    cur = read_or_none(spark, root)
    n = _layout(spark, root)
    if n is None:
        n = buckets or (64 if cur is not None else max(1, -(-updates.count() // BUCKET_ROWS)))  # 64: tables without a layout
        spark.createDataFrame([(n,)], "buckets int").write.mode("overwrite").parquet(f"{root.rstrip('/')}/_layout")
    upd = _in_buckets(updates, keys, n)
    touched = spark.createDataFrame([], upd.schema) if cur is None else restrict_to_touched(cur, upd, [BUCKET])
    obs = Observation(f"upsert_{uuid.uuid4().hex[:8]}")
    merged = upsert(touched, upd, keys, order_by, flag="_op").observe(
        obs,
        F.count_if(F.col("_op") == "inserted").alias("inserted"),
        F.count_if(F.col("_op") == "updated").alias("updated"),
        F.count_if(F.col("_op") == "kept").alias("kept"),
    )
    write_rows(merged.drop("_op"), root, [BUCKET], "overwrite")
    table = read_or_none(spark, root)
    rows = 0 if table is None else table.count()  # from the files' footers
    if buckets is None and rows > 4 * BUCKET_ROWS * n:
        _dealt_anew(spark, root, keys, 4 * n)
    return {"path": root, **obs.get}


def merge_sql(table: str, source: str, keys: Sequence[str], columns: Sequence[str]) -> str:
    """``MERGE INTO`` of the rows of ``source`` by key, field by field."""
    q = lambda c: f"`{c}`"
    on = " AND ".join(f"t.{q(k)} <=> s.{q(k)}" for k in keys)
    sets = ", ".join(f"t.{q(c)} = s.{q(c)}" for c in columns if c not in keys)
    names = ", ".join(q(c) for c in columns)
    matched = f" WHEN MATCHED THEN UPDATE SET {sets}" if sets else ""
    return (f"MERGE INTO {table} AS t USING {source} AS s ON {on}{matched}"
            f" WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join('s.' + q(c) for c in columns)})")


def merge_into(updates: DataFrame, table: str, keys: Sequence[str]) -> None:
    """Keyed upsert into a catalog table that supports row-level operations; updates must be unique by key."""
    view = f"updates_{uuid.uuid4().hex[:8]}"
    updates.createOrReplaceTempView(view)
    updates.sparkSession.sql(merge_sql(table, view, keys, updates.columns))


def save_records(records: DataFrame, root: str, id_col: str, json_cols: Sequence[str] = ()) -> str:
    """Append report or simulation records (S15): JSON text is checked, ``created_at`` stamped where absent.

    A record without an id gets a random one. JSON stays text on disk; ``with_variant`` reads it as VARIANT.
    """
    out = records
    if id_col not in out.columns:
        out = out.withColumn(id_col, F.expr("uuid()"))
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    for c in json_cols:
        out = out.withColumn(c, F.when(F.try_parse_json(c).isNotNull(), F.col(c)))
    return write_rows(out, root)


# --- partition-scoped upsert for large partitioned tables -----------------------------
def upsert_partitions(updates: DataFrame, root: str, keys: Sequence[str], partition_by: Sequence[str] = ("year_month",)) -> str:
    """Keyed upsert that rewrites only the partitions the updates touch; the partition columns are part of the key.

    Reads only the touched partitions (``restrict_to_touched``), replaces rows
    by key, and writes them back with dynamic partition overwrite; all other
    partitions are left as they are. For keys that can move between partitions
    use ``upsert_table``.
    """
    keys, parts = list(keys), list(partition_by)
    if not set(parts) <= set(keys):
        raise ValueError(f"partition columns {parts} must be among the keys {keys}: a key could move between partitions")
    cur = read_or_none(updates.sparkSession, root)
    merged = updates if cur is None else upsert(restrict_to_touched(cur, updates, parts), updates, keys)
    return write_rows(merged, root, parts, "overwrite")
