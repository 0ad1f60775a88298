"""Text vectorizers without a model: counts, tf-idf, and hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}_]{2,})"
#: Tokens that a task counts, or weighs, at a time, and the length from which a term's list is long.
TOKENS, LONG = 1 << 21, 64


def terms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term) of every token; what isn't a string is made one."""
    return df.select(F.col(id_col), F.explode(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(TOKEN), 1)).alias("term"))


def _tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col), F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(TOKEN), 1).alias("tokens"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, terms, place of the term, place of the id, count) of each term of each row of (id, tokens), some ``TOKENS`` at a time; in the order of terms."""
    for batch in batches:
        many = pc.fill_null(batch.column(1).value_lengths(), 0).to_numpy()
        upto = np.cumsum(many)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TOKENS, "right")))
            part = batch.slice(lo, hi - lo)
            words = part.column(1).flatten().dictionary_encode()
            key, n = np.unique(words.indices.to_numpy().astype(np.int64) * (hi - lo) + np.repeat(np.arange(hi - lo), many[lo:hi]), return_counts=True)
            yield part.column(0), words.dictionary, key // (hi - lo), key % (hi - lo), n
            lo = hi


def _alone(df: DataFrame, id_col: str) -> bool:
    """Whether each row has an id of its own."""
    return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def count_vectorize(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, term, n): the sparse count vector of each row; rows of one id count as one. Nothing is shuffled but ids, where no two rows have one."""
    if not _alone(df, id_col):
        return terms(df, id_col, text).groupBy(id_col, "term").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, term, row, n in _counted(batches):
            yield pa.record_batch([ids.take(pa.array(row)), words.take(pa.array(term)), pa.array(n)], [id_col, "term", "n"])

    return _tokens(df, id_col, text).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, term string, n bigint")


def tfidf_vectorize(df: DataFrame, id_col: str = "id", text: str = "text", digits: int = 4) -> DataFrame:
    """(id, term, weight), smoothed as if one more row had every term.

    Counts are shuffled once, by term: a task sends a term with lists of the ids that have it and of their counts. Where they meet, in the
    order of terms, what a term's lists hold together is its document frequency. Long lists come after the short ones and a count of them, so that no task has to hold them.
    """
    kind, rows = dict(df.dtypes)[id_col], df.count()
    alone = _alone(df, id_col)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, term, row, n in _counted(batches) if alone else _given(batches):
            begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            many = np.diff(np.append(begin, len(term)))
            own = words.take(pa.array(term[begin]))
            long = many >= LONG
            yield pa.record_batch([own, pa.array(long), pa.array(np.where(long, 0, many)), _list(begin, ids.take(pa.array(row))), _list(begin, pa.array(n))], names)
            none = np.zeros(long.sum(), np.int64)
            yield pa.record_batch([own.filter(pa.array(long)), pa.array(none > 0), pa.array(many[long]), _list(none, ids[:0]), _list(none, pa.array(n[:0]))], names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], None
        for batch in _and_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
            if not held:
                continue
            got = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            term = got.column(0)
            begin = np.flatnonzero(np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)))
            df_ = np.add.reduceat(got.column(2).to_numpy(), begin)
            if known and known[0] == term[0].as_py():
                df_[0] = known[1]
            last = int(begin[-1])
            done = batch is None or got.column(1)[got.num_rows - 1].as_py()  # long lists come last: the count is whole
            upto = got.num_rows if done else last
            known = (term[last].as_py(), df_[-1]) if done else None
            held = [] if done else [got.slice(last)]
            of = np.repeat(df_, np.diff(np.append(begin, got.num_rows)))
            size = got.column(3).value_lengths().to_numpy()
            at, sums = 0, np.cumsum(size)
            while at < upto:
                to = min(upto, max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + TOKENS, "right"))))
                part, row = got.slice(at, to - at), np.repeat(np.arange(at, to), size[at:to])
                yield pa.record_batch([part.column(3).flatten(), term.take(pa.array(row)), part.column(4).flatten(), pa.array(of[row])], [id_col, "term", "n", "df"])
                at = to

    names = ["term", "long", "df", "ids", "counts"]
    source = _tokens(df, id_col, text) if alone else count_vectorize(df, id_col, text)
    met = source.mapInArrow(lists, f"term string, long boolean, df bigint, ids array<{kind}>, counts array<bigint>").repartition("term").sortWithinPartitions("term", "long")
    tf = met.mapInArrow(spread, f"`{id_col}` {kind}, term string, n bigint, df bigint")
    weight = F.col("n") * (F.log((1.0 + F.lit(rows)) / (1.0 + F.col("df"))) + 1.0)
    return tf.select(id_col, "term", F.round(weight, digits).alias("weight"))


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_counted`` gives, of (id, term, n) rows."""
    for batch in batches:
        words = batch.column(1).dictionary_encode()
        by = np.argsort(words.indices.to_numpy(), kind="stable")
        yield batch.column(0), words.dictionary, words.indices.to_numpy()[by], by, batch.column(2).to_numpy()[by]


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _list(begin: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists that begin there; the last one ends with the values."""
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)).astype(np.int32)), values)


def bucket(term, width: int):
    """The term's place: the first 32 bits of its MD5, modulo the width. Any engine can compute it."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint"), F.lit(width))


def hashing_vectorize(df: DataFrame, id_col: str = "id", text: str = "text", width: int = 1024) -> DataFrame:
    """(id, bucket, n): counts without a vocabulary."""
    return terms(df, id_col, text).groupBy(id_col, bucket(F.col("term"), width).alias("bucket")).agg(F.count("*").alias("n"))


def as_map(sparse: DataFrame, id_col: str, key: str, value: str) -> DataFrame:
    """One row an id: ``map<key, value>``."""
    return sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("vector"))
