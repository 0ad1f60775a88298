"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then
answer totals, quantiles and truncated totals for every context limit without
touching a document again. Texts are encoded as the BPE operator does it, and only the tokens' number is kept.

Defined results
    null text      has no length and is not counted
    empty text     has length 0 and is counted
    very long text counted whole, however long one of its pieces is
    ties           texts of one length are one row
    repeated rows  each row counts
    empty table    the histogram and everything derived from it are empty
    other columns  are never read, so their names can't clash
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import slices, small_batches
from ._storage import plain, table
from .bpe import VOCABULARY, merges


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, documents): how many documents have each encoded length. Tasks send one row per length, not per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary)
        seen: Counter[int] = Counter()
        for batch in slices(batches, "text"):
            seen.update(m.lengths(batch.column(0).to_pylist()).tolist())
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "documents"])

    return (
        small_batches(docs).select(F.col(plain(text)).cast("string").alias("text"))
        .where("text IS NOT NULL")
        .mapInArrow(count, "n_tokens bigint, documents bigint")
        .groupBy("n_tokens")
        .agg(F.sum("documents").alias("documents"))
    )


def length_table(histogram: DataFrame) -> DataFrame:
    """Prefix and suffix sums at each length that occurs, in order of length.

    ``truncated_tokens`` is the total when every document is cut to ``n_tokens``. The window has
    no key on purpose: it runs over lengths, of which there are at most as many as the longest
    document has tokens, never over documents.
    """
    upto = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("documents")
    return (
        histogram.withColumns(
            {
                "documents_upto": F.sum("documents").over(upto),
                "tokens_upto": F.sum(tokens).over(upto),
                "_all": F.sum("documents").over(every),
                "_tokens": F.sum(tokens).over(every),
            }
        )
        # suffix sums as what the prefix leaves of the whole: a frame to the end would be summed up anew at every row
        .withColumns({"documents_over": F.col("_all") - F.col("documents_upto"), "tokens_over": F.col("_tokens") - F.col("tokens_upto")})
        .withColumn("truncated_tokens", F.col("tokens_upto") + F.col("n_tokens") * F.col("documents_over"))
        .withColumn("quantile", F.col("documents_upto") / F.col("_all"))
        .drop("_all", "_tokens")
    )


def truncated_totals(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, also those between lengths that occur: one row a limit, from ``length_table``'s rows."""
    wanted = lengths.sparkSession.createDataFrame([(x,) for x in sorted({int(x) for x in limits})], "context_limit bigint")
    at = lengths.select("n_tokens", "documents").crossJoin(F.broadcast(wanted))
    sums = at.groupBy("context_limit").agg(
        F.sum(F.least("n_tokens", "context_limit") * F.col("documents")).alias("truncated_tokens"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("documents"))).alias("documents_cut"),
        F.sum(F.greatest(F.col("n_tokens") - F.col("context_limit"), F.lit(0)) * F.col("documents")).alias("tokens_lost"),
    )
    return wanted.join(sums, "context_limit", "left").fillna(0)


def quantiles(lengths: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of the documents doesn't exceed."""
    wanted = lengths.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return lengths.crossJoin(F.broadcast(wanted)).where("quantile >= share - 1e-12").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(length_histogram(table(spark, sf_dir, "documents")))
