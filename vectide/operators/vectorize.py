"""Vectorizers: providers that give vectors for data, as expressions or over Arrow batches.

A provider is made once a task and given whole batches, however the model behind it works.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import vectors as V
from vectide.functions.records import require
from vectide.operators.text import bucket

Provider = Callable[[list], np.ndarray]


def vectorize(df: DataFrame, make: Callable[[], Provider], data: str = "data", modality: str | None = None, normalize: bool = True, into: str = "vector") -> DataFrame:
    """All columns, ``type`` and the vector of each row. ``make`` builds the provider in the task, the first time it is needed.

    A null has a null vector. Boolean vectors are never normalised; a zero vector's elements become null.
    """
    kept = [c for c in df.columns if c not in (into, "type")]
    src = df.select(*kept, (F.lit(modality) if modality else F.col("type") if "type" in df.columns else F.lit(None).cast("string")).alias("type"), F.col(data).cast("string").alias("__data") if dict(df.dtypes)[data] not in ("string", "binary") else F.col(data).alias("__data"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(into, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = None
        for batch in batches:
            if not batch.num_rows:
                continue
            provider = provider or make()
            col = batch.column(batch.num_columns - 1)
            some = np.flatnonzero(~col.is_null().to_numpy(zero_copy_only=False))
            out = np.asarray(provider(col.take(pa.array(some)).to_pylist()))
            boolean = out.dtype == bool
            out = out.astype(np.float64).reshape(len(some), -1) if len(some) else np.zeros((0, 0))
            bad = np.zeros(len(some), bool)
            if normalize and not boolean and len(some):
                n = np.sqrt((out * out).sum(1, keepdims=True))
                bad = n[:, 0] == 0
                out = out / np.where(n == 0, 1, n)
            width = out.shape[1]
            size = np.zeros(batch.num_rows, np.int64)
            size[some] = width
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(out.ravel(), mask=np.repeat(bad, width)), mask=col.is_null())
            yield pa.record_batch([*batch.columns[:-1], lists], schema.names)

    return src.mapInArrow(run, schema)


def normalized(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Unit length; vectors that aren't of numbers are left as they are."""
    kind = dict(df.dtypes)[vector]
    return df if kind == "array<boolean>" else df.withColumn(vector, V.normalize(V.doubles(vector)))


def members(df: DataFrame, vectors: str, into: str = "vector") -> DataFrame:
    """A row for each vector of a sequence: (…, seq, vector)."""
    return df.select(*[c for c in df.columns if c not in (vectors, into)], F.posexplode(vectors).alias("seq", into))


def hashed_embedding(dimension: int = 64) -> Callable[[], Provider]:
    """A deterministic stand-in for a text model: words fall on signed dimensions by their CRC."""

    def make() -> Provider:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for i, text in enumerate(texts):
                for w in text.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dimension] += 1 if h >> 16 & 1 else -1
            return out

        return embed

    return make


def hashed_embedding_column(text: Column, dimension: int = 64) -> Column:
    """The same embedding as an expression, without leaving the JVM."""
    codes = F.transform(F.filter(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: w != ""), lambda w: F.crc32(w.cast("binary")))
    return V.bound(codes, lambda codes: F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda d: F.aggregate(codes, F.lit(0.0), lambda s, h: s + F.when(h % dimension == d, F.when(F.shiftright(h, 16).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)).otherwise(0.0)),
    ))


def shingles(text: Column, n: int = 3) -> Column:
    """The distinct shingles of ``n`` characters of a string; a shorter one is its own."""
    grams = F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array(text))
    return F.array_distinct(grams)


def fingerprint(text: Column, bits: int = 64, n: int = 3) -> Column:
    """A boolean fingerprint of a string: a bit is set for each of its shingles of ``n`` characters, by MD5."""
    codes = F.array_distinct(F.transform(shingles(text, n), lambda g: bucket(g, bits)))
    return V.bound(codes, lambda codes: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.array_contains(codes, b.cast("bigint"))))


def onnx(model: bytes | str, output: str | None = None) -> Callable[[], Provider]:
    """A provider that runs an ONNX model; inputs of several names are matched by what stands before a dot. One session a task.

    A model of several outputs gives all of them, by name, unless one is asked for."""
    require("onnxruntime")

    def make() -> Provider:
        import onnxruntime as ort

        session = ort.InferenceSession(model, providers=["CPUExecutionProvider"])
        names = [i.name for i in session.get_inputs()]

        def call(data) -> np.ndarray:
            if isinstance(data, dict):
                feed = {n: data[n.split(".")[0]] for n in names}
            elif isinstance(data, list) and len(names) > 1:
                feed = dict(zip(names, data))
            else:
                feed = {names[0]: data}
            found = session.run([output] if output else None, feed)
            return found[0] if output or len(found) == 1 else dict(zip([o.name for o in session.get_outputs()], found))

        return call

    return make


def text_features(texts: list[str]) -> np.ndarray:
    """A fixed numeric input for model providers: length, words, letters, digits of each text."""
    return np.array([[len(t), len(t.split()), sum(c.isalpha() for c in t), sum(c.isdigit() for c in t)] for t in texts], np.float32).reshape(len(texts), 4)


def route(df: DataFrame, ways: dict[str, Callable[[DataFrame], DataFrame]], column: str = "type") -> DataFrame:
    """Each modality's rows go its way; rows of another are left out."""
    out = None
    for kind, way in ways.items():
        part = way(df.where(F.col(column) == kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def transcribe(df: DataFrame, make: Callable[[], Callable[[list], list[str]]], data: str = "data") -> DataFrame:
    """(data, type): texts of sound by a provider; every other column goes, so that rows of any source fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or make()
            yield pa.record_batch([pa.array(model(batch.column(0).to_pylist()), pa.string()), pa.array(["text"] * batch.num_rows)], ["data", "type"])

    return df.select(data).mapInArrow(run, "data string, type string")
