"""Records: metadata beside vectors, names, and JSON."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Set an entry of the ``metadata`` map; an entry of that key is replaced."""
    rest = F.map_filter("metadata", lambda k, _: k != key)
    return df.withColumn("metadata", F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def pop(df: DataFrame, key: str, into: str) -> DataFrame:
    """Move an entry of the ``metadata`` map to a column of its own."""
    return df.withColumn(into, F.col("metadata")[key]).withColumn("metadata", F.map_filter("metadata", lambda k, _: k != key))


def to_record(df: DataFrame, vector: str = "vector", field: str = "vector") -> DataFrame:
    """The vector under the name ``field``, which wins over metadata of that name, then all else."""
    return df.select(F.col(vector).alias(field), *[c for c in df.columns if c not in (vector, field)])


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def type_name(column: str) -> Column:
    return F.typeof(F.col(column))


def url_file_name(url: Column) -> Column:
    """The last segment of an address, without its query."""
    return F.split_part(F.substring_index(url, "/", -1), F.lit("?"), F.lit(1))


def require(module: str, package: str | None = None) -> None:
    """Say clearly what is missing; nothing is ever installed."""
    if importlib.util.find_spec(module) is None:
        raise ModuleNotFoundError(f"this operator needs the package {package or module!r}, which isn't installed")
