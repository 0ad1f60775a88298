"""What the engine registers: makers of operators by kind and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.operators import graph, segments, text
from vectide.operators import vectorize as Z
from vectide.operators.sinks import Collection
from vectide.plans.registry import register
from vectide.sources import files


@register("source", "local")
def _local(spark, path: str, **kw):
    return lambda **_: files.walk(spark, path, **kw)


@register("source", "ingest")
def _ingest(spark, path: str, landing: str):
    return lambda **_: files.ingest(spark, path, landing)


@register("source", "youtube")
def _urls(fetch=None):
    """Any list of addresses, with the caller's way to fetch them."""
    return lambda df, **_: files.urls(df) if fetch is None else files.fetched(df, fetch)


@register("transform", "video-demux")
def _demux(interval: float = 2.0, id_col: str = "id"):
    return lambda df, **_: segments.demux(df, id_col, F.col("frame_count"), segments.frame_rate(F.col("fps")) if dict(df.dtypes)["fps"] == "string" else F.col("fps"), F.col("samples"), F.col("rate"), interval)


@register("transform", "speech-to-text")
def _speech(make):
    return lambda df, **_: Z.transcribe(df, make)


@register("transform", "document-screenshot")
def _pages(render):
    return lambda df, **_: files.document_pages(df, render)


@register("transform", "text-segments")
def _segments(id_col: str = "id", column: str = "text", width: int = 500):
    return lambda df, **_: segments.text_segments(df, id_col, column, width)


def _model(kind: str):
    def make(make=None, model=None, data: str = "data", normalize: bool = True):
        """By a provider of the caller's or an ONNX model; no name brings along a model of its own."""
        if make is None and model is not None:
            make = Z.onnx(model)
        if make is None:
            raise ValueError(f"a vectorizer for {kind} needs a provider or a model")
        return lambda df, **_: Z.vectorize(df, make, data, kind if kind != "multimodal" else None, normalize)

    return make


for _kind, _names in {"text": ["text", "sentence-transformers", "cohere", "voyageai", "imagebind"], "image": ["image", "pytorch-image-models"], "audio": ["audio", "torchaudio"]}.items():
    for _name in _names:
        register("vectorizer", _name)(_model(_kind))


@register("vectorizer", "hashed")
def _hashed(dimension: int = 64, data: str = "data", normalize: bool = True):
    return lambda df, **_: Z.vectorize(df, Z.hashed_embedding(dimension), data, "text", normalize)


@register("vectorizer", "scikit-learn")
def _counts(id_col: str = "id", column: str = "text", weight: str = "count"):
    ways = {"count": text.count_vectorize, "tfidf": text.tfidf_vectorize, "hashing": text.hashing_vectorize}
    if weight not in ways:
        raise ValueError(f"unknown weight {weight!r}; there are {', '.join(ways)}")
    return lambda df, **_: ways[weight](df, id_col, column)


@register("vectorizer", "molecule")
def _molecule(column: str = "smiles", bits: int = 2048, n: int = 3, make=None):
    """By a provider of boolean fingerprints, or of the string's shingles."""
    if make is not None:
        return lambda df, **_: Z.vectorize(df, make, column, "molecule", False)
    return lambda df, **_: df.withColumn("vector", Z.fingerprint(F.col(column), bits, n))


@register("vectorizer", "graph")
def _graph(method: str = "fastrp", **kw):
    if method != "fastrp":
        raise ValueError(f"unknown method {method!r}; there is fastrp")
    return lambda df, **_: graph.fastrp(graph.adjacency(df), **kw)


@register("vectorizer", "multimodal")
def _multimodal(ways: dict, column: str = "type"):
    return lambda df, **_: Z.route(df, ways, column)


def _sink(spark, path: str, operation: str = "insert", vector_field: str | None = None, id_field: str = "id"):
    if operation not in ("insert", "search"):
        raise ValueError(f"unknown operation {operation!r}; there are insert, search")
    collection = Collection(spark, path, vector_field, id_field)

    def run(df: DataFrame, **kw) -> DataFrame:
        return collection.transact(df, operation, **kw)

    return run


for _name in ("local", "parquet", "milvus", "mongodb"):
    register("sink", _name)(_sink)
