"""Quality rules: an isolation forest over rule statistics.

Each document is described by the statistics that hand-written quality rules look
at. Trees of random splits isolate rare rows after few splits, so a short mean path
marks an anomalous document. The score above which documents are rejected is
calibrated from labelled rows, not set by hand. All of them count: what is usual is summed over all good ones; half of them, by a hash
of the id, grow the forest; all of the others set the threshold, exactly. A tree of an isolation forest is grown on ``SAMPLE`` rows by definition;
where there are more rows than all trees take, so many are drawn for them from all rows, by hash.

Statistics are shares that are damped towards the sample's mean by ``DAMP`` words, so
that a document of one word isn't an anomaly for being short, and length itself is no
statistic: a very long clean document is kept.

Defined results
    null or empty text  ``score`` null, ``keep`` false: there is nothing to keep
    no words at all     judged by its symbols like any other text
    very long text      measured whole
    repeated rows, ties each row has its result; equal statistics have equal scores; a score at the threshold is kept
    empty table         no rows
    few labelled rows   of which a half is empty: all grow the forest and set the threshold
    no labelled rows    nothing is known to be bad: ``score`` null, ``keep`` true where there is text
    labels of one kind  the threshold is the highest score of the labelled rows, so nothing like them is rejected
    other columns       only those named in ``keep`` are carried along
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import buffers, filtered, flag_spans, slices, small_batches, span_hashes, words
from ._labels import verdicts
from ._storage import plain, table, written

TREES, SAMPLE = 200, 256
#: The share of labelled good rows that the threshold may reject.
FALSE_REJECTS = 0.002
#: Parts of the range of scores that are calibrated apart, for which counts come to the driver.
BINS = 1 << 14
DAMP = 20.0
STATISTICS = ("symbols", "symbol_runs", "capitals", "bars", "repeated_words", "repeated_lines", "word_bytes", "distinct_words")

_SYMBOL, _CAPITAL, _BAR, _SPACE = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL[[*b".,;:'\"()-?"]] = False
_CAPITAL[65:91] = True
_BAR[[*b"|<>{}[]\\"]] = True
_SPACE[[*b" \t\r\n\x0b\x0c"]] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """In each text, how many spans equal an earlier one."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    by = np.lexsort((hashes, doc))
    same = np.zeros(len(by), bool)
    same[1:] = (hashes[by][1:] == hashes[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    return np.bincount(doc[by][same], minlength=len(first) - 1)


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sizes) of each text and statistic; a statistic is their quotient, damped."""
    n = len(offs) - 1
    start, end, first = words(data, offs)
    h = span_hashes(data, start, end)
    n_words = np.diff(first).astype(float)
    runs, ends = flag_spans(_SYMBOL[data], offs)
    runs = np.diff(np.searchsorted(runs[ends - runs > 1], offs))
    follows = np.zeros(len(h), bool)
    follows[1:] = h[1:] == h[:-1]
    follows[first[:-1][n_words > 0]] = False
    lines, to = flag_spans(data != 10, offs)
    at = np.searchsorted(lines, offs)
    n_lines = np.diff(at).astype(float)
    size = np.diff(offs).astype(float)
    letters = size - _sums(_SPACE[data], offs)
    # of the first words of a text, distinctness hangs on length: it is taken over windows of 64 words
    window = np.arange(len(h)) - first[:-1].repeat(np.diff(first)) >> 6
    doc = np.repeat(np.arange(n), np.diff(first))
    border = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (window[1:] != window[:-1]))) if len(h) else np.zeros(0, np.int64)
    seen = _repeats(h, np.append(border, len(h)))
    seen = np.bincount(doc[border], seen, n) if len(h) else np.zeros(n)
    counts = np.stack([_sums(_SYMBOL[data], offs), runs, _sums(_CAPITAL[data], offs), _sums(_BAR[data], offs), _sums(follows, first) if len(h) else np.zeros(n), _repeats(span_hashes(data, lines, to), at), letters, seen], 1).astype(float)
    sizes = np.stack([letters, n_words, letters, n_words, n_words, n_lines, n_words, n_words], 1)
    return counts, sizes


_WEIGHT = np.array([5.0, 1, 5, 1, 1, 0.25, 1, 1])  # of a word, in the units of each statistic's size


def damped(counts: np.ndarray, sizes: np.ndarray, prior: np.ndarray) -> np.ndarray:
    weight = DAMP * _WEIGHT
    return (counts + weight * prior) / (sizes + weight)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays; children of node i are ``2i + 1`` and ``2i + 2``."""

    def __init__(self, rows: np.ndarray, seed: int = 7, trees: int = TREES, sample: int = SAMPLE):
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        n_nodes = (2 << self.depth) - 1
        self.feature = np.zeros((trees, n_nodes), np.int32)
        self.cut = np.full((trees, n_nodes), np.inf)
        self.length = np.zeros((trees, n_nodes))
        for t in range(trees):
            stack = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
            while stack:
                node, deep, own = stack.pop()
                low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(1), np.zeros(1))
                splits = np.flatnonzero(high > low)
                if deep == self.depth or not len(splits):
                    self._leaf(t, node, deep, deep + float(_mean_path(len(own))))
                    continue
                f = int(rng.choice(splits))
                cut = rng.uniform(low[f], high[f])
                self.feature[t, node], self.cut[t, node] = f, cut
                left = own[:, f] < cut
                stack += [(2 * node + 1, deep + 1, own[left]), (2 * node + 2, deep + 1, own[~left])]
        self.norm = max(float(_mean_path(size)), 1e-9)

    def _leaf(self, t: int, node: int, deep: int, length: float) -> None:
        """All nodes below a leaf carry its path length, so that each row walks the full depth."""
        first, wide = node, 1
        for _ in range(deep, self.depth + 1):
            self.length[t, first : first + wide] = length
            first, wide = 2 * first + 1, 2 * wide

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        i = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[i, self.feature[t][node]] >= self.cut[t][node])
            total += self.length[t][node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def calibrate(scores: DataFrame, false_rejects: float = FALSE_REJECTS) -> float:
    """The threshold that rejects the most bad rows less good ones, by share, while rejecting at most ``false_rejects`` of the good, of (score, good) rows.

    Exact over all rows: counts of each part of the range tell how many rows lie above it, and each part is then searched by itself."""
    part = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("part")
    each = written(scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).select(part, "*"), "scores")
    parts = each.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("most")).toArrow().sort_by("part")
    good, bad = (parts[c].to_numpy() for c in ("good", "bad"))
    if not good.any() or not bad.any():
        return float(parts["most"].to_numpy().max())
    n_good, n_bad = int(good.sum()), int(bad.sum())
    over = dict(zip(parts["part"].to_pylist(), zip((n_good - np.cumsum(good)).tolist(), (n_bad - np.cumsum(bad)).tolist())))

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("score")
        k, cuts, own = rows["part"][0].as_py(), rows["score"].to_numpy(), [rows[c].to_numpy() for c in ("good", "bad")]
        good_over, bad_over = ((over[k][i] + x.sum() - np.cumsum(x)) / n for i, (x, n) in enumerate(zip(own, (n_good, n_bad))))
        fit = np.where(good_over <= false_rejects, bad_over - good_over, -np.inf)
        at = int(np.argmax(fit))
        return pa.table({"least": cuts[:1], "fit": fit[at : at + 1], "cut": cuts[at : at + 1], "above": pa.array(cuts[at + 1 : at + 2] if at + 1 < len(cuts) else [None], pa.float64())})

    found = each.groupBy("part").applyInArrow(best, "least double, fit double, cut double, above double").toArrow().sort_by("least")
    k = int(np.argmax(found["fit"].to_numpy()))
    cut, above = found["cut"][k].as_py(), found["above"][k].as_py()
    if above is None:
        above = found["least"][k + 1].as_py() if k + 1 < len(found) else cut
    return float((cut + above) / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> dict | None:
    """The fitted model, or None without labelled rows. Statistics are taken on the executors; sums, counts and the trees' rows come to the driver."""
    k = len(STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, sizes = statistics(*buffers(batch.column(1)))
            yield pa.record_batch([batch.column(0), _vectors(np.concatenate([counts, sizes], 1))], ["doc_id", "x"])

    own = small_batches(docs).select("doc_id", F.col(plain(text)).cast("string").alias("text")).where("doc_id IS NOT NULL AND text != ''")
    # labels meet the statistics, not the texts
    x = own.mapInArrow(measure, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, x array<double>").join(verdicts(labels), "doc_id")
    rows = written(x.select(F.xxhash64("doc_id").alias("hash"), (F.col("quality") >= 1).alias("good"), "x"), "statistics")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, 2 * k + 1))  # a line a half and kind; whole numbers, so their order doesn't matter
        for batch in batches:
            half, good, both = _half(batch)
            np.add.at(total, half * 2 + good, np.concatenate([both, np.ones((len(both), 1))], 1))
        yield pa.record_batch([_vectors(total.reshape(1, -1))], ["x"])

    parts = rows.mapInArrow(summed, "x array<double>").toArrow()["x"].to_pylist()
    total = np.sum(np.array(parts).reshape(-1, 4, 2 * k + 1), 0) if parts else np.zeros((4, 2 * k + 1))
    n = total[:, -1].reshape(2, 2)  # by half, and bad or good
    if not n.any():
        return None
    base = total[1] + total[3] if n[:, 1].any() else total[0] + total[2]
    prior = base[:k] / np.maximum(base[k : 2 * k], 1)
    split = n.any(1).all() and n.any(0).all()
    grow, held = (rows.where(f"pmod(hash, 2) = {i}") for i in (0, 1)) if split else (rows, rows)
    share = min(1.0, TREES * SAMPLE / (n[0].sum() if split else n.sum()))
    got = grow.where(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).select("x").toArrow()
    both = np.array(got["x"].combine_chunks().flatten()).reshape(-1, 2 * k)
    both = both[np.lexsort(both.T)]
    forest = Forest(damped(both[:, :k], both[:, k:], prior))
    state = pickle.dumps({"prior": prior, "forest": forest})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(state)
        for batch in batches:
            _, good, both = _half(batch)
            yield pa.record_batch([pa.array(m["forest"].score(damped(both[:, :k], both[:, k:], m["prior"]))), pa.array(good.astype(bool))], ["score", "good"])

    return {"prior": prior, "forest": forest, "threshold": calibrate(held.mapInArrow(score, "score double, good boolean"))}


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _half(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(half, good, statistics) of (hash, good, x) rows."""
    return batch.column(0).to_numpy() % 2, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)


@functools.lru_cache(1)
def _loaded(model: bytes) -> dict | None:
    return pickle.loads(model)


def judge(docs: DataFrame, model: dict | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns with ``score`` and ``keep``."""
    kept = [c for c in keep if c not in ("score", "keep")]
    df = small_batches(docs).select(*[F.col(plain(c)) for c in kept], F.col(plain(text)).cast("string").alias("__text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    state = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(state)
        for batch in slices(batches, "__text"):
            data, offs = buffers(batch.column(batch.num_columns - 1))
            none = np.diff(offs) == 0
            if m is None:
                out = [pa.nulls(batch.num_rows, pa.float64()), pa.array(~none)]
            else:
                score = m["forest"].score(damped(*statistics(data, offs), m["prior"]))
                out = [pa.array(score, mask=none), pa.array((score <= m["threshold"]) & ~none)]
            yield pa.record_batch([*batch.columns[:-1], *out], schema.names)

    return df.mapInArrow(run, schema)


def kept(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The documents that aren't rejected, with their columns as they are."""
    state = pickle.dumps(model)

    def mask(col: pa.Array) -> np.ndarray:
        m = _loaded(state)
        data, offs = buffers(col)
        some = np.diff(offs) > 0
        return some if m is None else some & (m["forest"].score(damped(*statistics(data, offs), m["prior"])) <= m["threshold"])

    return filtered(docs, text, mask)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
