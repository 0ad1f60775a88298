"""Files and addresses as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions.records import url_file_name

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def walk(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a path; ``content`` is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream, a few files at a time."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)


def ingest(spark: SparkSession, path: str, landing: str, pattern: str | None = None) -> DataFrame:
    """Copy files into a landing folder, as rows of (name, content), that a stream may watch; returns what landed."""
    files = walk(spark, path, pattern).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), "content")
    files.write.mode("append").parquet(landing)
    return spark.read.parquet(landing).select("path", "name", "bytes")


def urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """(url, file_name): a list of addresses with the names that their contents are cached under."""
    return pages.select(F.col(url).alias("url"), url_file_name(F.col(url)).alias("file_name"))


def fetched(list_: DataFrame, fetch, schema: str = "url string, data binary") -> DataFrame:
    """Contents of each address by a ``fetch(url) -> bytes or None`` of the caller's; what isn't there is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, x) for u in batch.column(0).to_pylist() if u is not None and (x := fetch(u)) is not None]
            yield pa.record_batch([pa.array([u for u, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["url", "data"])

    return list_.select("url").mapInArrow(run, schema)


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """(name, smiles) of a CSV file without a header."""
    return spark.read.csv(path, schema="name string, smiles string", header=False)


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """(node, id) of files of one JSON object ``{"node": [ids]}`` each, a row for each member."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string, array<bigint>>")
    return text.select(F.explode(parsed).alias("node", "ids")).select(F.col("node").cast("int").alias("node"), F.explode("ids").alias("id"))


def media_kind(path: Column) -> Column:
    """The modality that a file name's suffix tells."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return (
        F.when(suffix.isin("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"), "image")
        .when(suffix.isin("wav", "mp3", "flac", "ogg", "m4a"), "audio")
        .when(suffix.isin("mp4", "mkv", "avi", "mov", "webm"), "video")
        .when(suffix == "pdf", "document")
        .otherwise("text")
    )


def image_bytes(data: Column) -> Column:
    """Bytes of an image given as a base64 text, with or without a data address before it; null where it is neither."""
    return F.try_to_binary(F.regexp_replace(data, "^data:[^,]*,", ""), F.lit("base64"))


def npy(files: DataFrame) -> DataFrame:
    """(path, row, vector) of the two-dimensional arrays in ``.npy`` files, read a file at a time where the file is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(np.float32)
                for at in range(0, len(a), 4096):
                    part = a[at : at + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                    yield pa.record_batch([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), lists], ["path", "row", "vector"])

    return files.select("path", "content").mapInArrow(run, "path string, row bigint, vector array<float>")


def document_pages(files: DataFrame, render) -> DataFrame:
    """(path, page, image): pages of documents by a ``render(bytes) -> iterable of bytes`` of the caller's; only names that end in .pdf are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                images = list(render(content))
                yield pa.record_batch([pa.array([path] * len(images), pa.string()), pa.array(range(len(images)), pa.int32()), pa.array(images, pa.binary())], ["path", "page", "image"])

    return files.where(F.lower("path").endswith(".pdf")).select("path", "content").mapInArrow(run, "path string, page int, image binary")
