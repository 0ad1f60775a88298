"""How outputs of several nodes are put together before the next node runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.storage import written


def numbered(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """Rows numbered from 0 in order, without bringing them together: ranges are sorted apart, and each adds the sizes of those before."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    inside = spread.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    inside = written(inside, "numbered")  # so that ranges can't fall otherwise when read again
    sizes = inside.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def zip_cycle(frames: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows side by side by position, shorter inputs repeated up to the longest; no rows if any input has none.

    Each input comes with the columns that order it; of columns with one name the last input's is kept.
    """
    rows = [numbered(df, order) for df, order in frames]
    counts = [df.agg(F.count("*").alias("n")).first()["n"] for df, _ in frames]
    longest = max(counts)
    if not all(counts):
        longest = 0
    out = frames[0][0].sparkSession.range(longest).select(F.col("id").alias("_row"))
    for r, n in zip(rows, counts):
        side = r.withColumnRenamed("_row", "_side")
        out = out.drop(*[c for c in side.columns if c != "_side"])
        out = out.withColumn("_side", F.col("_row") % F.lit(max(1, n))).join(side, "_side").drop("_side")
    return out.drop("_row")


def merge_last(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of one key merged; of columns with one name the last frame's wins."""
    out = frames[0]
    for df in frames[1:]:
        out = out.select(key, *[c for c in out.columns if c != key and c not in df.columns]).join(df, key)
    return out


def override(df: DataFrame, **values: object) -> DataFrame:
    """Columns set to constants for one node only."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def present(df: DataFrame, *columns: str) -> DataFrame:
    """A missing output goes no further: rows with a null in the columns are left out."""
    return df.dropna(subset=list(columns) or None)


def exploded(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """A list result gives as many rows, nested lists of lists too."""
    into = into or column
    kind = dict(df.dtypes)[column]
    while kind.startswith("array<array<"):
        df, kind = df.withColumn(column, F.flatten(column)), kind[6:-1]
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(into))
