"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing: every token has a fixed sparse vector of +-1 (its index vector, drawn from the
token's hash) and a word vector, the index vectors of itself and of its neighbours in the labelled
sample summed up. A document is pooled from its tokens' word vectors, each weighted by how much the
token's presence tells about the labels in the sample (so that a few telling words aren't lost among
hundreds of others). A network of two layers in numpy gives the probabilities that the document is of
good quality and that it is toxic; a temperature for each, fitted on held-out labelled rows, makes
them honest. A document is kept if it is probably good and probably not toxic.

Tokens are words in lower case, runs of symbols, and single symbols that aren't punctuation; a marker token stands for a word that
repeats the one before it, and one for a word in capitals. Texts are read whole.

Defined results
    null or empty text     probabilities null, ``keep`` false: there is nothing to keep
    no token known         the network's answer for an empty pool
    very long text         pooled whole
    ties                   a probability of exactly a half counts as good, and as toxic
    empty table            no rows
    few labelled rows      tokens of fewer than ``MIN_DOCS`` documents are unknown, so very few rows give the network little but its bias; a
                           single one isn't held out, and temperatures stay 1
    repeated rows          each row has its result; labels of one id that differ count as the worst
    no labelled rows       nothing is known: probabilities null, ``keep`` true where there is text
    labels of one kind     the probability is near that kind for all
    other columns          only those named in ``keep`` are carried along
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import buffers, filtered, flag_spans, mix, slices, small_batches, span_hashes, _WORD
from ._labels import labelled
from ._storage import plain, table

#: Bound of the labelled rows that everything is trained on.
TRAIN_ROWS = 6000
DIMENSION, HIDDEN, NONZERO, WINDOW = 96, 32, 6, 2
#: Documents of the sample that a token must occur in.
MIN_DOCS = 5
HELD_OUT = 5
#: Weight below which a token isn't pooled.
TELLING = 0.15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\r\n\x0b\x0c"]] = True
_ODD = np.zeros(256, bool)  # signs that tell something even alone
_ODD[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = True
_REPEAT, _UPPER = np.uint64(1), np.uint64(2)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, where each text's begin); markers stand after the word they mark."""
    inside = _WORD[data]
    start, end = flag_spans(inside, offs)
    signs, to = flag_spans(~inside & ~_SPACE[data], offs)
    telling = (to - signs > 1) | _ODD[data[signs]]
    signs, to = signs[telling], to[telling]
    low = _LOWER[data]
    h = span_hashes(low, start, end)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    upper = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    loud = (upper[end] - upper[start] == end - start) & (end - start > 1)
    at = np.concatenate([start, signs, start[again], start[loud]])
    out = np.concatenate([h, span_hashes(low, signs, to), np.full(again.sum(), _REPEAT), np.full(loud.sum(), _UPPER)])
    by = np.argsort(at, kind="stable")
    return out[by], np.searchsorted(at[by], offs)


def index_vectors(hashes: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """A sparse +-1 vector for each token, drawn from its hash alone."""
    out = np.zeros((len(hashes), dimension), np.float32)
    for k in range(NONZERO):
        r = mix(hashes * np.uint64(2 * k + 3) + np.uint64(k))
        np.add.at(out, (np.arange(len(hashes)), (r >> np.uint64(8)) % np.uint64(dimension)), np.where(r & np.uint64(1), 1.0, -1.0).astype(np.float32))
    return out


def _information(present: np.ndarray, total: int, positive: int) -> np.ndarray:
    """How far the log odds of the label move when a token is present, in standard errors: [documents with it, those labelled 1]."""
    n, a = present
    rate = (positive + 1) / (total + 2)
    odds = np.log((a + 2 * rate) / (n - a + 2 * (1 - rate))) - np.log(rate / (1 - rate))
    error = np.sqrt(1 / (a + 2 * rate) + 1 / (n - a + 2 * (1 - rate)))
    return np.abs(odds) * np.minimum(np.abs(odds) / error / 3, 1) ** 2


class Network:
    """tanh hidden layer, two logistic outputs, trained by Adam on weighted cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60, batch: int = 128, rate: float = 2e-3, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        d, k = x.shape[1], y.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, k)), np.zeros(k)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                h = np.tanh(x[own] @ p[0] + p[1])
                z = (_logistic(h @ p[2] + p[3]) - y[own]) / len(own)
                back = (z @ p[2].T) * (1 - h * h)
                grads = [x[own].T @ back + decay * p[0], back.sum(0), h.T @ z + decay * p[2], z.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        self.temperature = np.ones(k)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross-entropy on rows that weren't trained on."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = np.array([(np.logaddexp(0, z / t) - y * z / t).mean(0) for t in grid])
        self.temperature = grid[loss.argmin(0)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Classifier:
    """``hashes`` and ``first`` hold the sample's tokens, ``y`` its labels: [good, toxic]."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, y: np.ndarray):
        n = len(y)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
        known, inverse = np.unique(hashes, return_inverse=True)
        inverse = inverse.astype(np.int32)
        once = np.unique(doc.astype(np.int64) * max(1, len(known)) + inverse)
        of, word = np.divmod(once, max(1, len(known)))
        del once
        # every fifth document calibrates; it isn't seen by weights, vectors or network
        train = np.arange(n) % HELD_OUT > 0 if n > 1 else np.ones(n, bool)
        seen = train[of]
        df = np.bincount(word[seen], minlength=len(known))
        take = df >= MIN_DOCS
        context = known[take]
        weights = []
        for k in range(y.shape[1]):
            a = np.bincount(word[seen], y[of[seen], k], len(known))
            weights.append(_information((df[take], a[take]), int(train.sum()), int(y[train, k].sum())))
        weight = np.stack(weights, 1).astype(np.float32)
        # tokens that tell nothing weigh nothing in a pool: they are neighbours, but need no vector of their own
        heavy = weight.max(1) > TELLING if len(weight) else np.zeros(0, bool)
        self.vocabulary, self.weight = context[heavy], weight[heavy]
        del of, word, seen
        near_id, own_id = np.full(len(known), -1, np.int32), np.full(len(known), -1, np.int32)
        near_id[take] = np.arange(len(context))
        own_id[np.flatnonzero(take)[heavy]] = np.arange(heavy.sum())
        near, own = near_id[inverse], own_id[inverse]
        del inverse
        base = index_vectors(context)
        vectors = base[heavy] * np.sqrt(np.bincount(own[(own >= 0) & train[doc]], minlength=int(heavy.sum())))[:, None]
        for k in [x for d in range(1, WINDOW + 1) for x in (d, -d)]:
            a, b = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
            pair = (doc[a] == doc[b]) & (own[a] >= 0) & (near[b] >= 0) & train[doc[a]]
            pairs, count = np.unique(own[a][pair].astype(np.int64) * len(base) + near[b][pair], return_counts=True)
            for at in range(0, len(pairs), 1 << 14):
                p, c = pairs[at : at + (1 << 14)], count[at : at + (1 << 14)]
                row = p // len(base)  # in order, as the pairs are
                edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                vectors[row[edge]] += np.add.reduceat(base[p % len(base)] * (np.log1p(c) / abs(k)).astype(np.float32)[:, None], edge, 0)
        vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.weighted = np.concatenate([vectors * self.weight[:, [k]] for k in range(y.shape[1])], 1)
        x = self.pool(hashes, first)
        self.network = Network(x[train], y[train])
        if (~train).any():
            self.network.calibrate(x[~train], y[~train])

    def pool(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each label: sums of weighted word vectors over the root of the length, and the weights' sum in the same measure."""
        n = len(first) - 1
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        doc = np.repeat(np.arange(n), np.diff(first))[hit]
        at = at[hit]
        out = np.zeros((n, self.weighted.shape[1] + self.weight.shape[1]), np.float32)
        wide = self.weighted.shape[1]
        for lo in range(0, len(at), 1 << 14):  # few rows at a time: a token's row is wide
            d, t = doc[lo : lo + (1 << 14)], at[lo : lo + (1 << 14)]
            begin = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            out[d[begin], :wide] += np.add.reduceat(self.weighted[t], begin, 0)
            out[d[begin], wide:] += np.add.reduceat(self.weight[t], begin, 0)
        out /= 1 + np.sqrt(np.diff(first))[:, None].astype(np.float32)
        return np.arcsinh(4 * out)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = TRAIN_ROWS) -> bytes:
    """The trained classifier, pickled (b"" without labelled rows). The executors split the sample's texts into tokens."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, first = tokens(*buffers(batch.column(3)))
            yield pa.record_batch([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], ["doc_id", "quality", "toxic", "h"])

    rows = labelled(docs, labels, most, text).where("text != ''")
    idtype = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(split, f"doc_id {idtype}, quality int, toxic int, h array<bigint>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return b""
    lists = got.column("h").combine_chunks()
    y = np.stack([got.column("quality").to_numpy() >= 1, got.column("toxic").to_numpy() >= 1], 1).astype(float)
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return pickle.dumps(Classifier(lists.flatten().to_numpy().view(np.uint64), first, y))


@functools.lru_cache(1)
def _loaded(model: bytes) -> Classifier | None:
    return pickle.loads(model) if model else None


def classify(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns with ``p_good``, ``p_toxic`` and ``keep``."""
    new = ("p_good", "p_toxic", "keep")
    df = small_batches(docs).select(*[F.col(plain(c)) for c in keep if c not in new], F.col(plain(text)).cast("string").alias("__text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("p_good", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in slices(batches, "__text"):
            data, offs = buffers(batch.column(batch.num_columns - 1))
            none = np.diff(offs) == 0
            if m is None:
                out = [pa.nulls(len(none), pa.float64()), pa.nulls(len(none), pa.float64()), pa.array(~none)]
            else:
                p = m.network.probabilities(m.pool(*tokens(data, offs)))
                out = [pa.array(p[:, 0], mask=none), pa.array(p[:, 1], mask=none), pa.array((p[:, 0] >= 0.5) & (p[:, 1] < 0.5) & ~none)]
            yield pa.record_batch([*batch.columns[:-1], *out], schema.names)

    return df.mapInArrow(run, schema)


def kept(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The documents that are probably good and not toxic, with their columns as they are."""

    def mask(col: pa.Array) -> np.ndarray:
        m = _loaded(model)
        data, offs = buffers(col)
        some = np.diff(offs) > 0
        if m is None:
            return some
        p = m.network.probabilities(m.pool(*tokens(data, offs)))
        return some & (p[:, 0] >= 0.5) & (p[:, 1] < 0.5)

    return filtered(docs, text, mask)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
