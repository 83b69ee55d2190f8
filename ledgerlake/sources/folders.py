"""Folders of a table in shared storage: which exist, which a write has finished, and moving them.

Spark's writers mark a finished folder with ``_SUCCESS``; names that begin with
an underscore are no data to Spark's readers.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def finished(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _at(spark, source)
    if not fs.rename(p, _at(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


def numbered(spark: SparkSession, root: str, name: str) -> list[int]:
    """The numbers N of the folders ``name=N`` in ``root``, in order."""
    fs, p = _at(spark, root)
    if not fs.exists(p):
        return []
    found = [re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
    return sorted(int(m.group(1)) for m in found if m)
