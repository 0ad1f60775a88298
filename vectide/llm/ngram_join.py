"""N-gram Jaccard join by prefixes of rare n-grams.

A document is the set of its word n-grams. Sets are joined by their prefixes: of n n-grams the n - t n + k rarest, in one order for all sets, of which
any pair of similarity t shares k. So common n-grams make no buckets that grow with the corpus. The order is taken from a sample; any order loses no pair.

Hashing each n-gram to a bit and XOR-ing gives a parity sketch: a bit is set where an odd number of n-grams fell, so the Hamming distance of two
sketches never exceeds the symmetric difference of the sets. A Jaccard similarity of at least t bounds
that difference by D = (1 - t) / (1 + t) x (|A| + |B|).

Small sets share one key (k = 1), and take a parity sketch of 256 bits with each: all pairs of a bucket within the bound are connected, without loss.
Large sets share ``SHARED`` keys, and take 64 bits of minima with each, which of 16 such words, the key says. Two sets agree in
a bit where they have the least n-gram of a bin in common, or by chance: at the threshold in 4 of 5 bits, strangers in about half. All pairs of a bucket are compared, and those that agree in ``LEAST``
bits are connected by a maximum spanning forest. A word of a pair at the threshold falls short with a probability of 2 % by calculation, and the shared
keys name some ten different words; pairs that agree less than what leads from one to the other by way of strangers are left to their other buckets.
Ties whose dense parity sketches are further apart than the bound are cut.

Documents of equal sets are one node, named by a hash of the set: a task sends a set's keys once, however many copies it reads,
and a bucket takes what several tasks send as one. Keys move packed, many a row, by their first bits; only near pairs leave a bucket, so ties are linear in it.
What hangs together is a cluster, and all pairs of a cluster are counted exactly, from the n-grams themselves, where its members meet.

The result is linear in the documents: ``classes`` gives a row a document, with the class that similar pairs hold together, the least id
of the same set, and the number of other sets it is similar to. ``jaccard_join`` gives the pairs themselves, between the least ids of sets.
No table that grows with the input is broadcast by hand, nor sent to the driver.

Defined results
    null text, no words     a class of its own, without links; in no pair
    fewer words than n      all the words are the only n-gram
    very long text          all of it, like any other
    null id                 in no pair and no class
    repeated id             one document: of several texts the one with the least hash counts
    repeated rows           one document
    ties                    the pair is given once, the lesser id first; a class is named by its least id
    empty table             no pairs, no classes
    other columns           aren't read; ``one_of_each`` gives them back as they are, whatever their names
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import buffers, mix, shingles, slices, small_batches, span_hashes, words
from ._storage import plain, table, written

NGRAM, THRESHOLD = 2, 0.6
#: Keys that similar large sets share at least, and bits of 64 that they agree in.
SHARED, LEAST = 16, 45
#: Orders of the n-grams that minima are taken in, and bins of each.
ORDERS, BINS = 8, 128
#: Members of a cluster that are verified in one go; larger clusters are verified in pairs of such chunks.
CHUNK = 1024
#: N-grams of such a block that are counted at a time; those of a block with more come in parts, by ranges of their hashes.
GRAMS = 1 << 20
#: Sets of fewer than ``SMALL_SETS`` n-grams are joined by prefixes, with small sketches of so many bits. At that size
#: a sketch still sets sets at the bound apart from strangers, by more than four standard deviations.
SMALL, SMALL_SETS = 256, 160
#: Cells of the table of how common n-grams are, as a power of 2, and the shares of the small texts and of all (a text in so many) that fill it.
CELLS, SHARE, SHARE_ALL = 20, 16, 64
#: First bits of a key that keys are packed by, and the keys that a task packs, or compares, at a time.
PACK, HELD = 12, 1 << 19
#: Sets that a task remembers to have sent.
SEEN = 1 << 20


def prefix(sets: np.ndarray, common: np.ndarray | None, threshold: float, shared: int = 1) -> np.ndarray:
    """The rarest n-grams of a set, so many that similar sets have ``shared`` of them in common (or all that they share): the least of those that they share.

    Which n-grams count as rare is taken from a sample; that is only the order, and any order that is one for all sets loses no pair."""
    n = len(sets)
    most = n - math.ceil(threshold * n - 1e-9) + shared
    return sets[np.lexsort((sets, common[(sets >> np.uint64(64 - CELLS)).astype(np.int64)]))[:most]] if common is not None else sets[:most]


def _common(source: DataFrame, n: int) -> np.ndarray:
    """How common the n-grams of each cell are in a sample of the texts, of the small ones more, in powers of 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offs = buffers(batch.column(0))
            start, end, first = words(data, offs)
            grams, _ = shingles(span_hashes(data, start, end), first, n)
            cell, count = np.unique((grams >> np.uint64(64 - CELLS)).astype(np.int32), return_counts=True)
            yield pa.record_batch([pa.array(cell), pa.array(count)], ["cell", "count"])

    sample = source.where(f"pmod(xxhash64(id), {SHARE}) = 0 AND octet_length(text) < {SMALL_SETS * 16} OR pmod(xxhash64(id), {SHARE_ALL}) = 0").select("text")
    got = sample.mapInArrow(run, "cell int, count bigint").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(1 << CELLS, np.uint8)
    out[got.column("cell").to_numpy()] = np.frexp(got.column("count").to_numpy().astype(float))[1]
    return out


def _dense_bits(size: int) -> int:
    return max(512, 1 << int(np.ceil(np.log2(1.5 * max(1, size)))))


_SEEDS = mix(np.arange(1, ORDERS + 1, dtype=np.uint64))[:, None]
_EDGES = np.arange(ORDERS * BINS, dtype=np.uint64) << np.uint64(65 - (ORDERS * BINS).bit_length())


def minima(sets: np.ndarray) -> np.ndarray:
    """16 words: a bit of the least n-gram of each bin in each order; 0 where a bin is empty."""
    some = np.sort(mix(sets[None] ^ _SEEDS), axis=1) // np.uint64(ORDERS) + (np.arange(ORDERS, dtype=np.uint64) << np.uint64(65 - ORDERS.bit_length()))[:, None]
    some = some.ravel()
    at = np.searchsorted(some, _EDGES)
    least = some[np.minimum(at, len(some) - 1)]
    own = least >> np.uint64(65 - (ORDERS * BINS).bit_length()) == np.arange(ORDERS * BINS, dtype=np.uint64)
    return np.packbits((least & np.uint64(1)).astype(bool) & own).view(np.uint64)


def sketch(sets: np.ndarray, threshold: float, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, a word of minima for each) of a sorted large set of n-gram hashes."""
    keys = mix(prefix(sets, common, threshold, SHARED) ^ np.uint64(0x5851F42D4C957F2D))
    return keys, minima(sets)[(keys & np.uint64(15)).astype(np.int64)]


def parity(sets: np.ndarray, m: int) -> bytes:
    """The parity sketch of ``m`` bits."""
    return np.packbits(np.bincount((mix(sets) % np.uint64(m)).astype(np.int64), minlength=m).astype(np.uint8) & 1).tobytes()


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(id, size, signature of the set, keys with their words in turn, prefix keys, small and dense sketch) of each document that has words."""
    source = _source(docs, text, doc_id)
    common = _common(source, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _documents(batches, n):
            first, second = _sizes(ids, sets), _joined_by(sets, common, threshold)
            yield pa.record_batch([*first.columns[:3], *second.columns[1:], first.column(3)], ["id", "size", "signature", "keys", "rare", "small", "dense"])

    return source.mapInArrow(run, "id bigint, size int, signature bigint, keys array<bigint>, rare array<bigint>, small binary, dense binary")


def _documents(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sorted sets) of the (id, text) rows that have words."""
    for batch in slices(batches, "text"):
        data, offs = buffers(batch.column(1))
        start, end, first = words(data, offs)
        grams, begin = shingles(span_hashes(data, start, end), first, n)
        at = np.flatnonzero(np.diff(begin))
        yield batch.column(0).take(pa.array(at)), [np.unique(grams[begin[i] : begin[i + 1]]) for i in at]


def _sizes(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    dense = [parity(x, _dense_bits(len(x))) for x in sets]
    return pa.record_batch([ids, pa.array([len(x) for x in sets], pa.int32()), pa.array([_signature(x) for x in sets], pa.int64()), pa.array(dense, pa.binary())], ["id", "size", "signature", "dense"])


def _joined_by(sets: list[np.ndarray], common: np.ndarray, threshold: float) -> pa.RecordBatch:
    none = np.zeros(0, np.uint64)
    low = [threshold * len(x) < SMALL_SETS for x in sets]  # larger sets meet small ones there
    keys = [np.stack(sketch(x, threshold, common), 1).ravel() if len(x) >= SMALL_SETS else none for x in sets]
    rare = [prefix(x, common, threshold) if y else none for x, y in zip(sets, low)]
    small = [np.uint64(len(x)).tobytes() + parity(x, SMALL) if y else None for x, y in zip(sets, low)]
    return pa.record_batch([pa.array([_signature(x) for x in sets], pa.int64()), _lists(keys), _lists(rare), pa.array(small, pa.binary())], ["signature", "keys", "rare", "small"])


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return small_batches(docs).select(F.col(plain(doc_id)).cast("bigint").alias("id"), F.lower(F.col(plain(text)).cast("string")).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def _signature(sets: np.ndarray) -> int:
    """Of the whole set; equal sets have the same."""
    return int((sets.sum() ^ mix(np.bitwise_xor.reduce(sets)[None])[0]).astype(np.int64))


def _lists(x: list[np.ndarray]) -> pa.Array:
    """uint64 arrays as lists of bigint."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)))


def _runs(batches: Iterator[pa.RecordBatch], *keys: int) -> Iterator[pa.RecordBatch]:
    """Record batches, each of whole runs of equal values in the columns ``keys`` of sorted input."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], 0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
        elif held and any(held[-1].column(k)[-1].as_py() != x[0] for k, x in zip(keys, cols)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, word or small sketch) of each key of (signature, keys, rare, small sketch) rows; a set that the task has seen isn't sent again."""
    seen: set[int] = set()
    for batch in batches:
        at = []
        for i, x in enumerate(batch.column(0).to_pylist()):
            if x not in seen:
                seen.add(x)
                at.append(i)
        if len(seen) > SEEN:
            seen.clear()
        own = batch.take(pa.array(at, pa.int64()))
        both = own.column(1).flatten().to_numpy().reshape(-1, 2)
        of = pa.array(np.repeat(np.arange(len(at)), own.column(1).value_lengths().to_numpy() // 2))
        yield pa.record_batch([pa.array(both[:, 0]), own.column(0).take(of), _binary(both[:, 1].copy().view("V8"))], ["key", "node", "small"])
        of = pa.array(np.repeat(np.arange(len(at)), own.column(2).value_lengths().to_numpy()))
        yield pa.record_batch([own.column(2).flatten(), own.column(0).take(of), own.column(3).take(of)], ["key", "node", "small"])


def _binary(rows: np.ndarray, begin: np.ndarray | None = None) -> pa.Array:
    """The bytes of an array's rows, or of the runs of them that begin there and end with the next one's begin."""
    offs = np.arange(len(rows) + 1) if begin is None else np.append(begin, len(rows))
    return pa.BinaryArray.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * rows.dtype.itemsize).astype(np.int32)), pa.py_buffer(rows.tobytes())])


#: A packed key of a large set, and of a small one.
_PACKED = [np.dtype([("key", "<u4"), ("node", "<i8"), ("word", "<u8", (k,))]) for k in (1, SMALL // 64 + 1)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first bits of the keys and their kind, keys of that sort with their nodes and words) of (key, node, word or small sketch) rows, each batch of one kind."""
    held: list[list[np.ndarray]] = [[], []]

    def rows(kind: int) -> pa.RecordBatch:
        key = np.concatenate([x["full"] for x in held[kind]])
        by = np.argsort(key)
        first = (key[by] >> np.uint64(64 - PACK)).astype(np.int32)
        begin = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        out = np.zeros(len(key), _PACKED[kind])
        for name in ("node", "word"):
            out[name] = np.concatenate([x[name] for x in held[kind]])[by]
        out["key"] = key[by].astype(np.uint32)
        held[kind].clear()
        return pa.record_batch([pa.array(first[begin] * 2 + kind), _binary(out, begin)], ["part", "packed"])

    for batch in batches:
        if not batch.num_rows:
            continue
        word = buffers(batch.column(2))[0].view(np.uint64).reshape(batch.num_rows, -1)
        kind = int(word.shape[1] > 1)
        held[kind].append({"full": batch.column(0).to_numpy().view(np.uint64), "node": batch.column(1).to_numpy(), "word": word})
        if sum(len(x["full"]) for x in held[kind]) >= HELD:
            yield rows(kind)
    for kind in (0, 1):
        if held[kind]:
            yield rows(kind)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, keys, nodes, words), sorted by key and node and without repeats, of whole buckets of sorted (part, packed) rows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for kind in (0, 1):
            own = [(part, data, offs, at) for part, data, offs in held if len(at := np.flatnonzero(part % 2 == kind))]
            if not own:
                continue
            packed = np.concatenate([data[offs[i] : offs[i + 1]] for _, data, offs, at in own for i in at.tolist()]).view(_PACKED[kind])
            many = np.concatenate([np.diff(offs)[at] for _, _, offs, at in own]) // _PACKED[kind].itemsize
            part = np.concatenate([part[at] for part, _, _, at in own]).astype(np.uint64)
            key = np.repeat(part << np.uint64(32), many) | packed["key"]
            by = np.lexsort((packed["node"], key))
            key, packed = key[by], packed[by]
            fresh = np.append(True, (key[1:] != key[:-1]) | (packed["node"][1:] != packed["node"][:-1]))
            yield kind, key[fresh], packed["node"][fresh], packed["word"][fresh]
        held.clear()

    for batch in _runs(batches, 0):
        held.append((batch.column(0).to_numpy(), *buffers(batch.column(1))))
        if sum(len(x[1]) for x in held) >= HELD * _PACKED[0].itemsize:
            yield from rows()
    yield from rows()


def _bucket_ties(threshold: float):
    """Ties (a, b), a < b, within the buckets of packed rows that are sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = (1 - threshold) / (1 + threshold)
        for kind, key, ids, sk in _unpacked(batches):
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            many = np.diff(np.append(begin, len(key)))
            begin, many = begin[many > 1], many[many > 1]
            out: list[np.ndarray] = []
            held = 0
            # buckets of a size at a time; of the larger ones, those of similar sizes
            wide = many if kind else np.where(many > 8, np.ceil(1.2 ** np.ceil(np.log(many) / np.log(1.2) - 1e-9) - 1e-6), many).astype(np.int64)
            for s in np.unique(wide).tolist():
                of = wide == s
                for part in np.array_split(np.flatnonzero(of), max(1, of.sum() * s >> 18)):
                    rows = begin[part][:, None] + np.arange(s)
                    for x, y in _near(sk, rows, r) if kind else _forest(sk[:, 0], rows, many[part]):
                        out.append(np.stack([ids[x], ids[y]]))
                        held += len(x)
                        if held > 1 << 20:
                            yield _distinct(out)
                            out, held = [], 0
            if held:
                yield _distinct(out)

    return run


def _forest(word: np.ndarray, rows: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ties of buckets of large sets, a bucket's first ``many`` rows a row: a maximum spanning forest of the pairs that agree in ``LEAST`` bits."""
    n, s = rows.shape
    rows = np.minimum(rows, len(word) - 1)
    words, every = word[rows], np.arange(n)
    out = np.arange(s) >= many[:, None]  # what is in the forest, or isn't in the bucket
    best, to = np.full((n, s), -1, np.int8), np.zeros((n, s), np.int32)
    at = np.zeros(n, np.int64)
    for _ in range(s - 1):
        out[every, at] = True
        agree = (64 - np.bitwise_count(words ^ words[every, at][:, None])).astype(np.int8)
        np.copyto(to, at[:, None], where=agree > best, casting="same_kind")
        np.maximum(best, agree, out=best)
        at = np.where(out, np.int8(-1), best).argmax(1)
        tied = np.flatnonzero((best[every, at] >= LEAST) & ~out[every, at])
        if len(tied):
            yield rows[tied, at[tied]], rows[tied, to[tied, at[tied]]]


def _near(sk: np.ndarray, rows: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ties of buckets of sets with small sketches: a spanning forest of all near pairs of small sets, and each near pair of a small and a larger one."""
    n, s = rows.shape
    size = sk[:, 0].astype(np.int64)
    small = size[rows] < SMALL_SETS
    mixed = ~small.all(1)
    part = np.tile(np.arange(s), (n, 1))  # what hangs together in each bucket
    for k in range(1, s):
        y = rows[:, k]
        left = np.arange(n)
        step = max(1, 256 // n) if n else 1
        for lo in range(0, k, step):
            if not len(left):
                break
            hi = min(k, lo + step)
            a, b = rows[left, lo:hi], y[left, None]
            far = np.zeros(a.shape, np.int64)
            for c in range(1, sk.shape[1]):
                far += np.bitwise_count(sk[a, c] ^ sk[b, c])
            total = size[a] + size[b]
            least = np.minimum(size[a], size[b])
            near = (far <= r * total + 1e-9) & (least * (1 + r) >= (total - least) * (1 - r) - 1e-9)
            one, other = small[left, lo:hi], small[left, k][:, None]
            own, at = np.nonzero(near & (one != other))
            if len(own):
                yield rows[left[own], lo + at], y[left[own]]
            near &= one & other
            while True:
                fresh = near & (part[left, lo:hi] != part[left, k][:, None])
                hit = np.flatnonzero(fresh.any(1))
                if not len(hit):
                    break
                own, at = left[hit], lo + fresh[hit].argmax(1)
                yield rows[own, at], y[own]
                part[own] = np.where(part[own] == part[own, k][:, None], part[own, at][:, None], part[own])
            left = left[(part[left, :k] != part[left, k][:, None]).any(1) | mixed[left]]


def _distinct(out: list[np.ndarray]) -> pa.RecordBatch:
    pairs, _ = _counted(np.sort(np.concatenate(out, 1), 0))
    return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((pairs[1], pairs[0]))
    pairs = pairs[:, by]
    begin = np.flatnonzero(np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(0)))
    return pairs[:, begin], np.diff(np.append(begin, pairs.shape[1]))


def ties(every: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): pairs of sets, a < b, that share keys and whose parity sketches are within the bound; enough of them to hold clusters together."""
    source = _source(docs, text, doc_id)
    common = _common(source, n)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(_keys(_joined_by(sets, common, threshold) for _, sets in _documents(batches, n)))

    # keys are taken from the texts again, which costs less than keeping them
    packed = source.mapInArrow(keys, "part int, packed binary").repartition("part").sortWithinPartitions("part")
    found = written(packed.mapInArrow(_bucket_ties(threshold), "a bigint, b bigint").distinct(), "ties")
    # written, so that a join with it can be split where one set has many ties
    dense = written(every.select("signature", "size", "dense").dropDuplicates(["signature"]), "dense")
    left, right = (dense.select(F.col("signature").alias(k), F.col("size").alias(f"size_{k}"), F.col("dense").alias(f"dense_{k}")) for k in "ab")

    def bound(pairs: DataFrame) -> DataFrame:
        # the same plan at every size, whatever a small input would allow
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "size_a", "size_b", "dense_a", "dense_b")
        return both.mapInArrow(_bound(threshold), "a bigint, b bigint").distinct()

    return bound(found)


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): connected components of (a, b) rows; a cluster is named by its least id.

    Each round maps every id to its least neighbour and contracts the graph to those; a few rounds leave no edge.
    """
    edges = written(pairs.select("a", "b").where("a != b").distinct(), "edges")
    assigned = None
    while True:
        both = edges.union(edges.select("b", "a"))
        to = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("cluster")), "labels")
        if assigned is None:
            assigned = to
        else:
            step = to.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
            assigned = written(assigned.join(step, "cluster", "left").select("id", F.coalesce("next", "cluster").alias("cluster")), "assigned")
        if edges.isEmpty():
            return assigned
        ends = edges.join(to.select(F.col("id").alias("a"), F.col("cluster").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("cluster").alias("y")), "b")
        edges = written(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")


def _sets(n: int):
    """The n-grams of (cluster, side, id, signature, parts, text) rows whose text has the signature, a row for each of so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offs = buffers(batch.column(5))
            start, end, first = words(data, offs)
            grams, begin = shingles(span_hashes(data, start, end), first, n)
            sets = [np.unique(grams[begin[i] : begin[i + 1]]) for i in range(batch.num_rows)]
            signature = batch.column(3).to_pylist()
            at = [i for i, x in enumerate(sets) if len(x) and _signature(x) == signature[i]]
            sets = [sets[i] for i in at]
            parts = batch.column(4).to_numpy()[at]
            own = batch.take(pa.array(np.repeat(at, parts).astype(np.int64)))
            size = np.repeat([len(x) for x in sets], parts).astype(np.int32)
            part = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in parts)])
            yield pa.record_batch([own.column(0), pa.array(part), *own.columns[1:3], pa.array(size), _lists([y for x, k in zip(sets, parts.tolist()) for y in _split(x, k)])], ["cluster", "part", "side", "id", "size", "grams"])

    return run


def _split(sets: np.ndarray, parts: int) -> list[np.ndarray]:
    """A sorted set in ``parts`` equal ranges of hashes."""
    return np.split(sets, np.searchsorted(sets, np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)))


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, Jaccard of the pairs that this block decides, which of them are similar) of each block of rows (cluster, part, side, id, size, grams), sorted by cluster and part.

    Sides 0 and 1 are two chunks of a cluster, side 2 is a whole one. Pairs are in the upper triangle. Every part has a row a member; what members share is summed over the parts."""

    def decided(ids: np.ndarray, side: np.ndarray, size: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = size.astype(np.float64)
        met = np.triu(np.ones(common.shape, bool), 1) & ((side == 2)[:, None] | (side[:, None] != side[None, :]))
        # the same division as in SQL: both are exact integers
        j = common / (s[:, None] + s[None, :] - common)
        return ids, j, met & (j >= threshold)

    held, last = None, None
    for batch in _runs(batches, 0, 1):
        cluster, part, side, ids, size = (batch.column(k).to_numpy() for k in range(5))
        grams = batch.column(5)
        flat, offs = grams.flatten().to_numpy(), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
        edges = np.append(np.flatnonzero(np.append(True, (cluster[1:] != cluster[:-1]) | (part[1:] != part[:-1]))), len(cluster))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and last != cluster[lo]:
                yield decided(*held)
                held = None
            own = np.arange(lo, hi)
            own = own[np.unique(ids[lo:hi], return_index=True)[1]]  # repeated rows
            n = len(own)
            if n < 2:
                continue
            count = offs[own + 1] - offs[own]
            at = np.repeat(offs[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = _intersections(flat[at], np.repeat(np.arange(n), count), n)
            if held:
                np.add(held[3], common, out=held[3])
            else:
                held, last = (ids[own], side[own], size[own], common), cluster[lo]
    if held:
        yield decided(*held)


def _similar(threshold: float):
    """Similar pairs (doc_id_a, doc_id_b, jaccard) of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, j, near in _blocks(batches, threshold):
            x, y = np.nonzero(near)
            if len(x):
                yield pa.record_batch([pa.array(ids[x]), pa.array(ids[y]), pa.array(j[x, y])], ["doc_id_a", "doc_id_b", "jaccard"])  # ids are in order

    return run


def _linked(threshold: float):
    """(id, least id that similar pairs of the block join it to, number of its similar pairs), a row a member, of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, near in _blocks(batches, threshold):
            near |= near.T
            links = near.sum(1)
            root = np.arange(len(ids))
            np.fill_diagonal(near, True)
            while True:
                new = np.where(near, root, len(ids)).min(1)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = links > 0
            yield pa.record_batch([pa.array(ids[some]), pa.array(ids[root][some]), pa.array(links[some])], ["id", "root", "links"])

    return run


def _intersections(grams: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all pairwise intersections; n-grams of one member only are left out, the others counted by a matrix product."""
    by = np.argsort(grams, kind="stable")
    g, d = grams[by], of[by]
    edge = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(g)))
    out = np.zeros((n, n))
    pos = np.repeat(np.arange(len(edge)), count)
    shared = count[pos] > 1
    column = np.cumsum(count > 1) - 1
    d, pos = d[shared], column[pos[shared]]
    wide = max(1, (1 << 22) // n)
    for lo in range(0, int(pos[-1]) + 1 if len(pos) else 0, wide):
        a, b = np.searchsorted(pos, [lo, lo + wide])
        m = np.zeros((n, min(wide, int(pos[-1]) + 1 - lo)), np.float32)
        m[d[a:b], pos[a:b] - lo] = 1
        out += m @ m.T
    return out


def _bound(threshold: float):
    """Keeps pairs whose dense sketches' distance is within the bound: rows (a, b, size_a, size_b, dense_a, dense_b). Small sets have been compared already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = (1 - threshold) / (1 + threshold)
        for batch in batches:
            size_a, size_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b) - 1e-9
            dense_a, dense_b = batch.column(4), batch.column(5)
            for i in np.flatnonzero(ok & (np.maximum(size_a, size_b) >= SMALL_SETS)):
                x, y = (np.frombuffer(z[int(i)].as_buffer(), np.uint8) for z in (dense_a, dense_b))
                if len(x) != len(y):  # the longer is folded: bits of equal remainder have the parity of their sum
                    x, y = (x, y) if len(x) < len(y) else (y, x)
                    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
                ok[i] = int(np.bitwise_count(x ^ y).sum()) <= r * (size_a[i] + size_b[i]) + 1e-9
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(ok))

    return run


def _members(docs: DataFrame, text: str, doc_id: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id and signature of each document, least id of each signature, and members of clusters with their n-grams where they are to be verified)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_sizes(ids, sets) for ids, sets in _documents(batches, n))

    every = written(_source(docs, text, doc_id).mapInArrow(measured, "id bigint, size int, signature bigint, dense binary"), "sketches")
    by_id = written(every.groupBy("id").agg(F.min("signature").alias("signature"), F.min_by("size", "signature").alias("size")), "ids")
    # texts that no id counts as its own have no least id, and drop out here
    least = written(by_id.groupBy("signature").agg(F.min("id").alias("least"), F.min("size").alias("size")), "least")
    home = clusters(ties(every, docs, text, doc_id, n, threshold)).select(F.col("id").alias("signature"), F.col("cluster").alias("home"))
    home = written(home.join(least, "signature").select("signature", F.col("least").alias("id"), "size", "home"), "homes")

    # chunks of a cluster by a hash of the id, so that no row of a cluster needs to know the others
    sizes = home.groupBy("home").agg(F.count("*").alias("members"), F.sum("size").alias("grams"))
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    parts = F.ceil(F.col("grams") * F.least(chunks, F.lit(2)) / chunks / GRAMS).cast("int")
    member = home.join(sizes.where("members > 1"), "home").select("id", "signature", "home", chunks.alias("chunks"), parts.alias("parts"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))
    # of one chunk: the whole cluster; of more: each pair of chunks, and each chunk by itself
    spread = member.select("id", "signature", "parts", "home", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    spread = spread.select(
        "id",
        "signature",
        "parts",
        F.xxhash64("home", F.least("chunk", "with"), F.greatest("chunk", "with")).alias("cluster"),
        F.when(F.col("chunk") == F.col("with"), 2).otherwise((F.col("chunk") > F.col("with")).cast("int")).alias("side"),
    )
    # members' n-grams are taken from their texts again, which costs less than keeping everyone's
    sets = _source(docs, text, doc_id).join(spread.hint("merge"), "id").select("cluster", "side", "id", "signature", "parts", "text").mapInArrow(_sets(n), "cluster bigint, part int, side int, id bigint, size int, grams array<bigint>")
    return by_id.drop("size"), least.drop("size"), sets.repartition("cluster").sortWithinPartitions("cluster", "part")


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of all pairs of distinct sets that are similar, and of each copy with its least id."""
    by_id, least, members = _members(docs, text, doc_id, n, threshold)
    found = members.mapInArrow(_similar(threshold), "doc_id_a bigint, doc_id_b bigint, jaccard double")
    copies = by_id.join(least, "signature").where("id > least").select(F.col("least").alias("doc_id_a"), F.col("id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return found.unionByName(copies)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of each id.

    ``class_id`` is the least id that similar pairs, one after another, lead to; ``copy_of`` the least id of the same set of n-grams;
    ``n_links`` counts the other sets, at any place of the class, that this one is similar to. Every similar pair is counted.
    """
    by_id, least, members = _members(docs, text, doc_id, n, threshold)
    linked = written(members.mapInArrow(_linked(threshold), "id bigint, root bigint, links bigint"), "links")
    group = clusters(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    # a row a set; written, so that its join with the documents can be split where a set has many copies
    sets = written(least.withColumnRenamed("least", "id").join(links, "id", "left").join(group, "id", "left"), "sets")
    own = by_id.withColumnRenamed("id", "doc_id").join(sets, "signature")
    own = own.select("doc_id", F.coalesce("cluster", "id").alias("class_id"), F.col("id").alias("copy_of"), F.coalesce("links", F.lit(0)).alias("n_links"))
    every = docs.select(F.col(plain(doc_id)).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return every.join(own, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: the least id of each class stays.

    Of rows that share an id one stays; rows without an id, which are in no class, all stay and aren't moved.
    """
    name = "_"
    while name in docs.columns:
        name += "_"
    stay = classes(docs, text, doc_id, n, threshold).where("doc_id = class_id").select(F.col("doc_id").alias(name))
    key = F.col(plain(doc_id)).cast("bigint")
    left = docs.withColumn(name, key).where(F.col(name).isNotNull()).join(stay.hint("merge"), name, "left_semi").dropDuplicates([name]).drop(name)
    return left.unionByName(docs.where(key.isNull()))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM w WHERE len(w) > 0
), s AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS sig FROM g GROUP BY doc_id
), r AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS rep FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM (SELECT g.doc_id, g FROM g JOIN r ON g.doc_id = r.rep AND r.doc_id = r.rep) a
  JOIN (SELECT g.doc_id, g FROM g JOIN r ON g.doc_id = r.rep AND r.doc_id = r.rep) b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), p AS (
  SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE common / (x.n + y.n - common)::DOUBLE >= {THRESHOLD}
), k AS (
  SELECT a, a AS b FROM p UNION SELECT k.a, p.b FROM k JOIN p ON p.a = k.b
)
SELECT d.doc_id, coalesce((SELECT min(k.b) FROM k WHERE k.a = r.rep), r.rep, d.doc_id) AS class_id, coalesce(r.rep, d.doc_id) AS copy_of, (SELECT count(*) FROM p WHERE p.a = r.rep) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN r USING (doc_id)
"""
