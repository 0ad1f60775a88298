"""Sinks: a collection of vectors as a Parquet table that rows are inserted into and searched in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators import search as S

OPERATIONS = ("insert", "search")
_INSERT = "_insert"


class Collection:
    """``insert`` appends, making the table with the first rows; ``search`` finds the nearest. The vector field is found by its type unless named."""

    def __init__(self, spark: SparkSession, path: str, vector_field: str | None = None, id_field: str = "id"):
        self.spark, self.path, self.id_field = spark, path.rstrip("/"), id_field
        self._vector = vector_field

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self) -> DataFrame:
        return self._rows().drop(_INSERT)

    def _rows(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def ids(self, insert: str) -> DataFrame:
        """The ids of what one ``insert`` has written."""
        return self._rows().where(F.col(_INSERT) == insert).select(self.id_field)

    def fields(self) -> dict[str, str]:
        """Kinds of vector fields by name: dense, binary or sparse."""
        kinds = {}
        for f in self.read().schema.fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType | T.DoubleType):
                kinds[f.name] = "dense"
            elif isinstance(f.dataType, T.BinaryType) or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.BooleanType)):
                kinds[f.name] = "binary"
            elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.IntegerType | T.LongType):
                kinds[f.name] = "sparse"
        return kinds

    @property
    def vector_field(self) -> str:
        if self._vector:
            return self._vector
        dense = [n for n, k in self.fields().items() if k == "dense"]
        if not dense:
            raise ValueError(f"{self.path} has no dense vector field")
        return dense[0]

    def insert(self, df: DataFrame) -> DataFrame:
        """Append rows; a vector of another length than the table's is an error when it is written.

        Returns (type, insert_count, insert) as it was written: nothing upstream is computed again. ``ids(insert)`` has the ids."""
        field = self._vector or next(f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType))
        if self.exists():
            first = self.read().select(F.size(field).alias("n")).first()
            if first is not None:
                df = df.withColumn(field, F.when(F.coalesce(F.size(field), F.lit(first.n)) == first.n, F.col(field)).otherwise(F.raise_error(F.lit(f"a vector's length isn't {first.n}"))))
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{_INSERT}={name}")
        return insert_summary(self._rows().where(F.col(_INSERT) == name)).withColumn("insert", F.lit(name))

    def search(self, queries: DataFrame, limit: int = 10, metric: str = "l2", output_fields: tuple[str, ...] = (), filter: str | None = None, query_id: str = "query_id") -> DataFrame:
        field = self.vector_field
        return S.search(self.read(), queries, limit, metric, where=filter, output_fields=output_fields, id_col=self.id_field, vector=field, query_id=query_id, query_vector=field)

    def transact(self, df: DataFrame, operation: str = "insert", **kw) -> DataFrame:
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {operation!r}; there are {', '.join(OPERATIONS)}")
        return getattr(self, operation)(df, **kw)


def insert_summary(df: DataFrame) -> DataFrame:
    """(type, insert_count): how many rows of each modality."""
    kind = F.col("type") if "type" in df.columns else F.lit(None).cast("string")
    return df.groupBy(kind.alias("type")).agg(F.count("*").alias("insert_count"))
