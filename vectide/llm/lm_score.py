"""LM scoring by cross-entropy difference.

Two trigram models over words are counted, one over the target documents and one over the whole corpus as background. They
share one vocabulary (every word of the corpus), one order and one smoothing, and are matched in everything but their text. A
document's score is the mean over its tokens of the target's loss less the background's: the lower, the more the document is like the target.

Words are runs of letters, digits and all other signs beyond ASCII, in lower case. Two border tokens stand before a text and one, which is
predicted like a word, after it. The probability of a word is interpolated with that of the order below,

    p(w | uv) = (n(uvw) + PRIOR p(w | v)) / (n(uv) + PRIOR),   p(w | v) likewise,   p(w) = (n(w) + PRIOR / WORDS) / (n() + PRIOR)

which needs nothing but counts of n-grams. A token's loss is rounded to a thousandth of a bit, so that sums don't hang on their order.

Every document is counted, whole, and what is gathered grows with the corpus: a task reads its documents in slices of
``SLICE`` bytes, and asks for the counts of each slice's distinct n-grams, by a hash that spreads them over all partitions. Where the
questions about an n-gram meet, its counts are summed up, and each slice is answered in the order in which it asked. Slices are put together with
their answers and score their documents. So an n-gram of a third of all tokens is one question a slice, no partition
holds more than its share, and no table is broadcast. Questions are packed: hashes of 56 bits as differences of 5 bytes (of 1e9 different
n-grams some seven share theirs), counts as bits where they are 1. Slices aren't sent along with their questions; documents are
read twice, and join the answers as ranks of their words.

Defined results
    null or empty text   no tokens: null losses and score; so too for texts without words
    very long text       counted and scored whole, as a slice of its own
    no target document   the target model is the same for all words; scores are still defined
    null id              never a target; scored like any other
    ties, repeated rows  each counts, and each has its result
    empty table          no rows
    other columns        aren't read

Documents are read twice in the same order, as files are; those that aren't read from files are written first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import buffers, mix, release, slices, small_batches, span_hashes, words
from ._storage import plain, table, written

ORDER, DIGITS = 3, 6
PRIOR, WORDS = 4.0, 1 << 20
#: Bytes of text whose n-grams are asked for together.
SLICE = 8 << 20
TASK_IDS = 1 << 20
#: Parts that each partition of questions is cut into; one is held at a time.
PARTS = 4
_BORDER = np.uint64(0x5B0DE7)
_TOTAL = np.uint64(0x107A1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram, from that of its beginning and its last word."""
    return mix(before * _STEP + word + _SALT)


def sequences(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of at least a word, with two borders before and one after: (tokens, where each text's begin)."""
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(np.where(n > 0, n + 3, 0))])
    out = np.full(begin[-1], _BORDER)
    out[np.repeat(begin[:-1] + 2 - first[:-1], n) + np.arange(first[0], first[-1])] = word
    return out, begin


def grams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the 1-, 2- and 3-gram that end at each token; those that begin before their text are never asked for."""
    one = mix(tokens + _SALT)
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[1:] = _chained(one[:-1], tokens[1:])
    three[2:] = _chained(two[1:-1], tokens[2:])
    return one, two, three


def predicted(begin: np.ndarray) -> np.ndarray:
    """Places of the tokens that are predicted: all but the two borders at each text's beginning."""
    live = np.ones(begin[-1], bool)
    at = begin[:-1][np.diff(begin) > 0]
    live[at] = live[at + 1] = False
    return np.flatnonzero(live)


class Questions:
    """A slice's distinct n-grams of each order, sorted by hash, and which of them each predicted token needs."""

    def __init__(self, tokens: np.ndarray, begin: np.ndarray):
        grams_ = grams(tokens)
        at = self.at = predicted(begin)
        start, end = begin[:-1][np.diff(begin) > 0], begin[1:][np.diff(begin) > 0]
        pair = np.ones(len(tokens), bool)
        pair[start] = False
        self.pair = np.flatnonzero(pair)  # all 2-grams are counted, that of the borders too: they are contexts
        # the number of all tokens is counted as if it were a word
        one, two, three = np.append(grams_[0][at], np.repeat(_TOTAL, min(1, len(at)))), grams_[1][self.pair], grams_[2][at]
        del grams_
        self.code, self.to = [], []
        for x in (one, two, three):
            x >>= np.uint64(8)
            code, to = np.unique(x, return_inverse=True)
            self.code.append(code)
            self.to.append(to.astype(np.int32))
        self.total = int(self.to[0][-1]) if len(at) else 0
        single, double = np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int32)
        single[at], double[self.pair] = self.to[0][: len(at)], self.to[1]
        single[start + 1] = single[end - 1]  # the border before a text is as frequent as the one after it
        #: of each predicted token (order, place): its 1-, 2- and 3-gram, and the contexts of the last two
        self.of = [(0, single[at]), (1, double[at]), (2, self.to[2]), (0, single[at - 1]), (1, double[at - 1])]

    def counts(self, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(background, target) counts of each n-gram by order; ``target`` tells of each token whether its text is one."""
        out = []
        for code, to, at in zip(self.code, self.to, (self.at, self.pair, self.at)):
            own = target[at]
            to = to[: len(at)]
            out.append((np.bincount(to, minlength=len(code)), np.bincount(to[own], minlength=len(code))))
        if len(self.at):
            out[0][0][self.total], out[0][1][self.total] = len(self.at), target[self.at].sum()
        return out


def pack_numbers(x: np.ndarray) -> bytes:
    """Small counts as bytes; those of 255 and more follow."""
    large = x[x >= 255].astype(np.int64)
    return struct.pack("<q", len(x)) + np.minimum(x, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_numbers(blob: memoryview) -> tuple[np.ndarray, memoryview]:
    """(counts, what comes after them)."""
    n = struct.unpack("<q", blob[:8])[0]
    out = np.frombuffer(blob[8 : 8 + n], np.uint8).astype(np.int64)
    large = np.flatnonzero(out == 255)
    end = 8 + n + 8 * len(large)
    out[large] = np.frombuffer(blob[8 + n : end], np.int64)
    return out, blob[end:]


def pack_counts(n: np.ndarray, t: np.ndarray) -> bytes:
    """Two counts of each n-gram, the first at least 1, the second at most the first: bits where the first is 1."""
    one = n == 1
    return struct.pack("<q", len(n)) + np.packbits(one).tobytes() + np.packbits(t[one] > 0).tobytes() + pack_numbers(n[~one]) + pack_numbers(t[~one])


def unpack_counts(blob: memoryview) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """(both counts, what comes after them)."""
    k = struct.unpack("<q", blob[:8])[0]
    at = 8 + -(-k // 8)
    one = np.unpackbits(np.frombuffer(blob[8:at], np.uint8), count=k).astype(bool)
    m = int(one.sum())
    n, t = np.ones(k, np.int64), np.zeros(k, np.int64)
    t[one] = np.unpackbits(np.frombuffer(blob[at : at + -(-m // 8)], np.uint8), count=m)
    n[~one], rest = unpack_numbers(blob[at + -(-m // 8) :])
    t[~one], rest = unpack_numbers(rest)
    return n, t, rest


def pack_codes(x: np.ndarray) -> bytes:
    """Sorted distinct hashes as the differences between them, in 5 bytes where they fit."""
    gap = np.diff(x, prepend=np.uint64(0))[1:]
    width = 8 if len(gap) and int(gap.max()) >> 40 else 5
    planes = _planes(gap, width)
    last = squeezed(planes[(width - 1) * len(gap) :])
    return struct.pack("<qqQq", len(x), width, int(x[0]) if len(x) else 0, len(last)) + planes[: (width - 1) * len(gap)] + last


def unpack_codes(blob: memoryview) -> tuple[np.ndarray, memoryview]:
    n, width, first, last = struct.unpack("<qqQq", blob[:32])
    at = 32 + max(0, n - 1) * (width - 1)
    gap = np.zeros(n, np.uint64)
    if n:
        gap[0], gap[1:] = first, _from_planes(bytes(blob[32:at]) + zlib.decompress(blob[at : at + last]), width)
    return np.cumsum(gap, dtype=np.uint64), blob[at + last :]


def squeezed(x: bytes) -> bytes:
    """Frequent bytes in few bits; nothing else is looked for."""
    z = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, 8, zlib.Z_HUFFMAN_ONLY)
    return z.compress(x) + z.flush()


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all numbers, then the next, and so on."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def losses(n: list[np.ndarray], total: np.ndarray | float) -> np.ndarray:
    """Thousandths of bits, from the counts of each token's 1-, 2- and 3-gram and of the contexts of the last two."""
    p = (n[0] + PRIOR / WORDS) / (total + PRIOR)
    p = (n[1] + PRIOR * p) / (n[3] + PRIOR)
    p = (n[2] + PRIOR * p) / (n[4] + PRIOR)
    return np.rint(-np.log2(p) * 1000).astype(np.int64)


def _parts(code: np.ndarray, parts: int) -> np.ndarray:
    """Where the n-grams of each part begin among sorted hashes; parts are ranges of hashes."""
    edge = np.array([(k << 56) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(code, edge), [len(code)]])


_ASKED = "to int, part int, origin bigint, blob binary"


def _row(rows: list[tuple]) -> pa.RecordBatch:
    to, part, origin, blob = zip(*rows)
    return pa.record_batch([pa.array(to, pa.int32()), pa.array(part, pa.int32()), pa.array(origin, pa.int64()), pa.array(blob, pa.binary())], ["to", "part", "origin", "blob"])


def _home(origin: int, partitions: int) -> int:
    """The partition of a slice's answers."""
    return int(mix(np.array([origin], np.uint64))[0] % np.uint64(partitions))


def _cut(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number of the slice among those of all tasks, its rows) of (doc_id, text, target, task) rows."""
    held: list[pa.RecordBatch] = []
    size = number = 0

    def taken() -> tuple[int, pa.RecordBatch]:
        nonlocal size, number
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        size, number = 0, number + 1
        return batch.column(3)[0].as_py() << 32 | number, batch

    for batch in slices(batches, "text", slice_bytes // 4):
        more = int(batch.column(1).nbytes)
        if held and size + more > slice_bytes:
            yield taken()
        held.append(batch)
        size += more
    if held:
        yield taken()


def _some(rows: Iterator[tuple], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > most:
            yield _row(held)
            held, size = [], 0
    if held:
        yield _row(held)


def _ask(parts: int, partitions: int, known: np.ndarray | None, slice_bytes: int):
    """Questions of each slice: a row a part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for origin, batch in _cut(batches, slice_bytes):
            data, offs = buffers(batch.column(1))
            start, end, first = words(data, offs)
            tokens, begin = sequences(span_hashes(data, start, end), first)
            q = Questions(tokens, begin)
            if known is None:
                wanted = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            else:
                wanted = np.isin(batch.column(0).fill_null(0).to_numpy(), known) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            del data, start, end, tokens
            counts = q.counts(np.repeat(wanted, np.diff(begin)))
            edges = [_parts(code, parts) for code in q.code]
            for k in np.flatnonzero(sum(map(np.diff, edges))).tolist():
                own = [slice(e[k], e[k + 1]) for e in edges]
                yield k % partitions, k, origin, b"".join(pack_codes(code[o]) + pack_counts(n[o], t[o]) for code, (n, t), o in zip(q.code, counts, own))

    return lambda batches: _some(rows(batches))


def _send(partitions: int, slice_bytes: int):
    """The slices themselves: ids, and the words as ranks by frequency."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for origin, batch in _cut(batches, slice_bytes):
            data, offs = buffers(batch.column(1))
            start, end, first = words(data, offs)
            vocabulary, local, count = np.unique(span_hashes(data, start, end), return_inverse=True, return_counts=True)
            by = np.argsort(-count, kind="stable")
            rank = np.zeros(len(by), np.uint64)
            rank[by] = np.arange(len(by))
            width = max(1, -(-len(by).bit_length() // 8))
            ids = pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"]).serialize().to_pybytes()
            head = struct.pack("<qqqq", len(by), len(local), width, len(ids))
            yield _home(origin, partitions), -1, origin, head + ids + vocabulary[by].tobytes() + pack_numbers(np.diff(first)) + squeezed(_planes(rank[local], width))

    return lambda batches: _some(rows(batches))


def _answer(partitions: int):
    """Answers to questions that are sorted by part: the sums of all questions about an n-gram, in the order of each question."""

    def answers(held: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        rest = [memoryview(blob) for _, _, blob in held]
        out: list[list[bytes]] = [[] for _ in held]
        for _ in range(ORDER):
            code, n, t = [], [], []
            for i, blob in enumerate(rest):
                c, blob = unpack_codes(blob)
                a, b, rest[i] = unpack_counts(blob)
                code.append(c)
                n.append(a)
                t.append(b)
            edge = np.concatenate([[0], np.cumsum([len(c) for c in code])])
            _, to = np.unique(np.concatenate(code), return_inverse=True)
            code.clear()
            # sums of counts are exact as doubles up to 2 ** 53
            n, t = (np.bincount(to, np.concatenate(x).astype(np.float64))[to].astype(np.int64) if len(to) else to for x in (n, t))
            for x, lo, hi in zip(out, edge[:-1], edge[1:]):
                x.append(pack_counts(n[lo:hi], t[lo:hi]))
        for (part, origin, _), x in zip(held, out):
            yield _home(origin, partitions), part, origin, b"".join(x)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for part, origin, blob in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if held and held[0][0] != part:
                    yield from answers(held)
                    held.clear()
                held.append((part, origin, blob))
        if held:
            yield from answers(held)

    return lambda batches: _some(rows(batches))


def _score(parts: int, kind: pa.DataType):
    """Results of slices: rows sorted by slice, the slice itself first and then its answers by part."""

    def scored(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        head = memoryview(held[0][2])
        n_vocabulary, n_words, width, n_ids = struct.unpack("<qqqq", head[:32])
        ids = pa.ipc.read_record_batch(pa.py_buffer(head[32 : 32 + n_ids]), pa.schema([("doc_id", kind)])).column(0)
        at = 32 + n_ids
        vocabulary = np.frombuffer(head[at : at + 8 * n_vocabulary], np.uint64)
        at += 8 * n_vocabulary
        size, rest = unpack_numbers(head[at:])
        local = _from_planes(zlib.decompress(rest), width).view(np.int64)
        tokens, begin = sequences(vocabulary[local], np.concatenate([[0], np.cumsum(size)]))
        del local, rest
        q = Questions(tokens, begin)
        edges = [_parts(code, parts) for code in q.code]
        n = [[np.zeros(len(code)) for code in q.code] for _ in range(2)]
        answered = 0
        for _, part, blob in held[1:]:
            blob = memoryview(blob)
            for k, e in enumerate(edges):
                own = slice(e[part], e[part + 1])
                n[0][k][own], n[1][k][own], blob = unpack_counts(blob)  # an answer of another length doesn't fit, and is an error
                answered += own.stop - own.start
        if held[0][1] >= 0 or answered != sum(map(len, q.code)):
            raise RuntimeError("a slice and its answers don't agree: the documents came in another order when they were read again")
        count = np.where(np.diff(begin) > 0, np.diff(begin) - 2, 0)
        edge = np.concatenate([[0], np.cumsum(count)])
        sums = []
        for model in n:
            bits = np.concatenate([[0], np.cumsum(losses([model[k][x] for k, x in q.of], model[0][q.total] if len(q.at) else 0.0))])
            sums.append(bits[edge[1:]] - bits[edge[:-1]])
        return pa.record_batch([ids, pa.array(count), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n_tokens", "background", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for part, origin, blob in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if held and held[0][0] != origin:
                    yield scored(held)
                    held.clear()
                held.append((origin, part, blob))
        if held:
            yield scored(held)
        release()

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, text: str = "text", doc_id: str = "doc_id", task_ids: int = TASK_IDS, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, n_tokens, target_bits, background_bits, score) of each row: means a token, to ``DIGITS`` places.

    ``targets`` has the ids of the target documents in its first column.
    """
    df = small_batches(docs).select(F.col(plain(doc_id)).alias("doc_id"), F.lower(F.col(plain(text)).cast("string")).alias("text"))
    ids = targets.select(F.col(plain(targets.columns[0])).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    kind = df.schema["doc_id"].dataType
    known = None
    if kind.simpleString() == dict(ids.dtypes)["doc_id"] and kind.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        few = ids.limit(task_ids + 1).toArrow().column("doc_id")
        known = np.sort(few.to_numpy().astype(np.int64)) if len(few) <= task_ids else None
    if known is None:
        df = df.join(ids.withColumn("target", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    else:
        df = df.withColumn("target", F.lit(False))

    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = written(df, "texts")
    df = df.withColumn("task", F.spark_partition_id())

    from pyspark.sql.pandas.types import to_arrow_type

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS * partitions
    asked = df.mapInArrow(_ask(parts, partitions, known, slice_bytes), _ASKED)
    answered = asked.repartitionById(partitions, F.col("to")).sortWithinPartitions("part", "origin").mapInArrow(_answer(partitions), _ASKED)
    both = answered.unionByName(df.mapInArrow(_send(partitions, slice_bytes), _ASKED))
    sums = both.repartitionById(partitions, F.col("to")).sortWithinPartitions("origin", "part").mapInArrow(_score(parts, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_tokens bigint, background bigint, target bigint")
    n = F.nullif(F.col("n_tokens"), F.lit(0)) * F.lit(1000.0)
    mean = {"target_bits": F.col("target") / n, "background_bits": F.col("background") / n, "score": (F.col("target") - F.col("background")) / n}
    return sums.select("doc_id", "n_tokens", *[(F.round(v, DIGITS) + 0.0).alias(k) for k, v in mean.items()])


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS good, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w, row_number() OVER () AS r FROM documents
), x AS (SELECT r, good, list_concat(['', ''], w, ['']) AS x FROM d WHERE len(w) > 0),
g AS (SELECT r, good, x[i - 2] AS u, x[i - 1] AS v, x[i] AS w FROM (SELECT r, good, x, unnest(range(3, len(x) + 1)) AS i FROM x)),
c1 AS (SELECT w, count(*) AS b, count(*) FILTER (good) AS t FROM g GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS b, count(*) FILTER (good) AS t FROM g GROUP BY ALL UNION ALL SELECT '', '', count(*), count(*) FILTER (good) FROM x),
c3 AS (SELECT u, v, w, count(*) AS b, count(*) FILTER (good) AS t FROM g GROUP BY ALL),
n AS (SELECT sum(b) AS b, sum(t) AS t FROM c1),
p1 AS (SELECT w, (c1.b + {PRIOR / WORDS}::DOUBLE) / (n.b + {PRIOR}::DOUBLE) AS b, (c1.t + {PRIOR / WORDS}::DOUBLE) / (n.t + {PRIOR}::DOUBLE) AS t FROM c1, n),
p2 AS (SELECT c.v, c.w, (c.b + {PRIOR}::DOUBLE * p1.b) / (x.b + {PRIOR}::DOUBLE) AS b, (c.t + {PRIOR}::DOUBLE * p1.t) / (x.t + {PRIOR}::DOUBLE) AS t FROM c2 c JOIN p1 ON p1.w = c.w JOIN c1 x ON x.w = c.v),
p3 AS (SELECT c.u, c.v, c.w, round(-log2((c.b + {PRIOR}::DOUBLE * p2.b) / (x.b + {PRIOR}::DOUBLE)) * 1000) AS b, round(-log2((c.t + {PRIOR}::DOUBLE * p2.t) / (x.t + {PRIOR}::DOUBLE)) * 1000) AS t
  FROM c3 c JOIN p2 ON p2.v = c.v AND p2.w = c.w JOIN c2 x ON x.v = c.u AND x.w = c.v),
s AS (SELECT r, count(*) AS n, sum(b) AS b, sum(t) AS t FROM g JOIN p3 USING (u, v, w) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(t / (n * 1000.0::DOUBLE), {DIGITS}) + 0.0 AS target_bits, round(b / (n * 1000.0::DOUBLE), {DIGITS}) + 0.0 AS background_bits, round((t - b) / (n * 1000.0::DOUBLE), {DIGITS}) + 0.0 AS score FROM d LEFT JOIN s USING (r)"""
