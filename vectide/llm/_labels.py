"""Labels, and a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import plain


def verdicts(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, quality, toxic), a row an id. Labels of one id that differ count as the worst of them; a null label counts as good quality,
    or not toxic. Rows without an id aren't used."""
    return (
        labels.where(F.col(plain(doc_id)).isNotNull())
        .groupBy(F.col(plain(doc_id)).alias("doc_id"))
        .agg(F.coalesce(F.min("quality"), F.lit(1)).cast("int").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("toxic"))
    )


def labelled(docs: DataFrame, labels: DataFrame, most: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, quality, toxic, text) of at most ``most`` labelled documents, chosen by a hash of their id.

    Rows without a text aren't used. The labels are ranked without any text,
    so what is broadcast, and later collected, is bounded by ``most``.
    """
    chosen = verdicts(labels, doc_id).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col(plain(doc_id)).alias("doc_id"), F.col(plain(text)).cast("string").alias("text")).where("text IS NOT NULL")
    return own.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "toxic", "text")
