"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item is cut into overlapping windows of ``WINDOW`` bytes (a shorter item is one
window; an item of fewer than ``LEAST`` bytes is found where all of its words stand in a row, without edits). A document is contaminated by an item if some part of it is within the edit budget, ``RATE`` of the
window's length, of one of its windows, after case, punctuation and spacing are evened out.

Within e edits, w bytes keep w - q + 1 - q e of their q-grams, and all of them lie on
diagonals (position in the document less position in the window) at most e apart. So shared q-grams are
counted in overlapping bands of diagonals, regions that reach the bound are kept, and a banded
alignment decides them. The bound is at least 3 for every length of a window, and each length has its own. No region within the budget is missed, and none is reported without its alignment.

Documents are read whole and never shuffled: the benchmark's q-grams go to the tasks. A benchmark of more than
``PASS_BYTES`` is searched in several passes, each with an index that is bounded in size.

Defined results
    null or empty text       contaminated by nothing
    null id                  rows of documents give a null ``doc_id``; items without an id aren't searched
    items under ``LEAST``    bytes after evening out: found by whole words, exactly; items without a word aren't searched
    very long texts          documents and items are searched whole
    repeated items or rows   each (row, item) is reported
    ties between windows     the fewest edits, then the first place
    empty tables             nothing is found
    other columns            aren't read
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import buffers, filtered, shingles, slices, small_batches, span_hashes, words, _WORD
from ._storage import plain, table

Q, WINDOW, RATE, LEAST = 8, 64, 0.09, 32  # with q-grams of 9 bytes, windows of 34 and 35 bytes would keep none for certain
PASS_BYTES = 4 << 20
_BITS = 22
_M = np.uint64(0x9E3779B97F4A7C15)


def even_out(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with every run of other signs than letters and digits made one space, none at the ends: (bytes, offsets, places in ``data``).

    Letters are expected in lower case already.
    """
    word = _WORD[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first other sign after a word stands for the run
    begin = offs[:-1][np.diff(offs) > 0]
    keep[begin] = word[begin]
    at = np.flatnonzero(keep)
    new = np.searchsorted(at, offs)
    out = np.where(word[at], data[at], 32).astype(np.uint8)
    last = new[1:][np.diff(new) > 0] - 1
    drop = last[out[last] == 32]
    if len(drop):
        stay = np.ones(len(at), bool)
        stay[drop] = False
        out, at = out[stay], at[stay]
        new = new - np.searchsorted(drop, new)
    return out, new, at


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the ``Q`` = 8 bytes from each place on."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h, n, m = x.astype(np.uint64) + np.uint64(1), 1, np.array([_M])
    while n < 8:
        h = h[:-n] * m + h[n:]
        n, m = 2 * n, m * m
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def windows(length: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of an item of so many bytes: a step of half a window, the last one ends with the item."""
    if length <= WINDOW:
        return [(0, length)] if length else []
    starts = [*range(0, length - WINDOW, WINDOW // 2), length - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def budget(w: int) -> tuple[int, int]:
    """(edits allowed, q-grams then kept at least) for a window of ``w`` bytes."""
    e = int(RATE * w) if w >= LEAST else 0
    return e, w - Q + 1 - Q * e


class Index:
    """q-grams of all windows of some items, sorted by hash."""

    def __init__(self, texts: list[bytes]):
        self.text: list[np.ndarray] = []
        item, edits, least, hashes, of, place = [], [], [], [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(texts):
            raw = np.frombuffer(t, np.uint8)
            x, _, _ = even_out(raw, np.array([0, len(raw)]))
            for s, end in windows(len(x)):
                w = x[s:end]
                e, need = budget(len(w))
                h = gram_hashes(w) if len(w) >= LEAST else np.zeros(0, np.uint64)
                if len(w) < LEAST:
                    start, to, first = words(w, np.array([0, len(w)]))
                    own, _ = shingles(span_hashes(w, start, to), first, len(start))
                    short.setdefault(len(start), []).append((int(own[0]), len(self.text)))
                hashes.append(h)
                of.append(np.full(len(h), len(self.text)))
                place.append(np.arange(len(h)))
                self.text.append(w)
                item.append(i)
                edits.append(e)
                least.append(need)
        self.item, self.edits, self.least = (np.array(v, np.int64) for v in (item, edits, least))
        self.size = np.array([len(w) for w in self.text], np.int64)
        #: by number of words: hashes of short items, and their windows
        self.short = {k: tuple(np.array(v, np.uint64 if i == 0 else np.int64) for i, v in enumerate(zip(*sorted(x)))) for k, x in sorted(short.items())}
        sizes, kind = np.unique(self.size[self.size >= LEAST], return_inverse=True)
        self.kind = np.zeros(len(self.size), np.int64)
        self.kind[self.size >= LEAST] = kind
        self.bounds = [(budget(int(w))[1], int(w) + 3 * (budget(int(w))[0] + 1)) for w in sizes]  # (q-grams kept, bytes that hold them) by length
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        by = np.argsort(h, kind="stable")
        self.window = np.concatenate(of)[by] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[by] if hashes else np.zeros(0, np.int64)
        self.hash, self.first = np.unique(h[by], return_index=True)
        self.first = np.append(self.first, len(h))
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, x: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, window, edits, start, end) of all windows found in evened-out texts, one row a text and window."""
        parts = [self._search_grams(x, offs), *self._search_words(x, offs)]
        doc, window, *rest = (np.concatenate(p) for p in zip(*parts))
        by = np.lexsort((window, doc))
        return doc[by], window[by], *(p[by] for p in rest)

    def _search_words(self, x: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Short items, by the number of their words."""
        if not self.short:
            return
        start, end, first = words(x, offs)
        h = span_hashes(x, start, end)
        for k, (wanted, window) in self.short.items():
            at = np.flatnonzero(np.arange(len(h)) + k <= first[1:].repeat(np.diff(first)))
            if not len(at):
                continue
            own, _ = shingles(np.concatenate([h[i : len(h) - k + 1 + i] for i in range(k)]).reshape(k, -1).T[at].ravel(), np.arange(0, k * len(at) + 1, k), k)
            lo, hi = np.searchsorted(wanted, own, "left"), np.searchsorted(wanted, own, "right")
            hit = np.flatnonzero(hi > lo)
            count = (hi - lo)[hit]
            entry = np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place, w = np.repeat(at[hit], count), window[entry]
            a, b = start[place], end[place + k - 1]
            same = np.array([x[i:j].tobytes() == self.text[v].tobytes() for i, j, v in zip(a, b, w)], bool)
            a, b, w = a[same], b[same], w[same]
            doc = np.searchsorted(offs, a, "right") - 1
            by = np.lexsort((a, w, doc))
            doc, w, a, b = doc[by], w[by], a[by], b[by]
            new = np.append(True, (doc[1:] != doc[:-1]) | (w[1:] != w[:-1])) if len(doc) else np.zeros(0, bool)
            yield doc[new], w[new], np.zeros(new.sum(), np.int64), a[new] - offs[doc[new]], b[new] - offs[doc[new]]

    def _search_grams(self, x: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(self.hash) or len(x) < Q:
            return none
        h = gram_hashes(x)
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).view(np.int64)])
        to = np.searchsorted(self.hash, h[at])
        to[to == len(self.hash)] = 0
        hit = self.hash[to] == h[at]
        doc = np.searchsorted(offs, at, "right") - 1
        hit &= at + Q <= offs[doc + 1]
        at, to, doc = at[hit], to[hit], doc[hit]
        # a region holds at least ``need`` of the places, within a window's length and its bands
        live = np.zeros((len(self.bounds), len(at)), bool)
        for k, (need, span) in enumerate(self.bounds):
            if len(at) >= need:
                tight = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span)
                mark = np.zeros(len(at) + 1, np.int64)
                mark[tight] += 1
                mark[tight + need] -= 1
                live[k] = np.cumsum(mark[:-1]) > 0
        some = live.any(0)
        at, to, doc, live = at[some], to[some], doc[some], live[:, some]
        count = self.first[to + 1] - self.first[to]
        begin = np.cumsum(count) - count
        entry = np.repeat(self.first[to] - begin, count) + np.arange(count.sum())
        own = np.repeat(np.arange(len(at)), count)
        dense = live[self.kind[self.window[entry]], own]
        entry, own = entry[dense], own[dense]
        at, doc, window = at[own], doc[own], self.window[entry]
        wide = self.edits[window] + 1
        diagonal = at - offs[doc] - self.place[entry] + 2 * WINDOW
        band = diagonal // wide
        # each diagonal lies in two bands of twice the width
        doc, window, band = np.tile(doc, 2), np.tile(window, 2), np.concatenate([band, band - 1])
        by = np.lexsort((band, window, doc)) if len(offs) * len(self.text) >= 1 << 31 else np.argsort((doc * len(self.text) + window) << 32 | band, kind="stable")
        doc, window, band = doc[by], window[by], band[by]
        edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (window[1:] != window[:-1]) | (band[1:] != band[:-1]))) if len(doc) else np.zeros(0, np.int64)
        enough = np.diff(np.append(edge, len(doc))) >= self.least[window[edge]]
        edge = edge[enough]
        if not len(edge):
            return none
        doc, window, band = doc[edge], window[edge], band[edge]
        low = band * (self.edits[window] + 1) - 2 * WINDOW  # the least diagonal of the band, from the text's start
        edits, end = self._align(x, offs, doc, window, low)
        ok = edits <= self.edits[window]
        doc, window, edits, end = doc[ok], window[ok], edits[ok], end[ok]
        by = np.lexsort((end, edits, window, doc))
        doc, window, edits, end = doc[by], window[by], edits[by], end[by]
        first = np.append(True, (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])) if len(doc) else np.zeros(0, bool)
        doc, window, edits, end = doc[first], window[first], edits[first], end[first]
        return doc, window, edits, np.maximum(end - self.size[window], 0), end

    def _align(self, x: np.ndarray, offs: np.ndarray, doc: np.ndarray, window: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window against any part of the text within its band, widened by the edits; and where that part ends."""
        edits, end = np.full(len(doc), 1 << 20), np.zeros(len(doc), np.int64)
        for w in np.unique(self.size[window]):
            group = np.flatnonzero(self.size[window] == w)
            e, _ = budget(int(w))
            wide = 2 * (e + 1) + 2 * e + 1
            columns = np.arange(wide)
            for at in range(0, len(group), 2048):
                own = group[at : at + 2048]
                pattern = np.stack([self.text[k] for k in window[own]])
                start = low[own] - e  # column c of row i is the text's byte start + c + i
                base, stop = offs[doc[own]], offs[doc[own] + 1]
                far = 1 << 20

                def place(i: int) -> np.ndarray:
                    return (base + start)[:, None] + columns + i

                p = place(0)
                d = np.where((p >= base[:, None]) & (p <= stop[:, None]), 0, far)
                for i in range(int(w)):
                    p = place(i)
                    inside = (p >= base[:, None]) & (p < stop[:, None])
                    byte = np.where(inside, x[np.clip(p, 0, len(x) - 1)], 0)
                    take = np.where(inside, d + (byte != pattern[:, [i]]), far)
                    skip = np.append(d[:, 1:], np.full((len(own), 1), far), 1) + 1
                    d = np.minimum(take, skip)
                    p = place(i + 1)
                    d = np.where((p >= base[:, None]) & (p <= stop[:, None]), d, far)
                    d = np.minimum.accumulate(d - columns, 1) + columns
                    d = np.where((p >= base[:, None]) & (p <= stop[:, None]), d, far)
                best = d.argmin(1)
                edits[own] = d[np.arange(len(own)), best]
                end[own] = start + best + w
        return edits, end


@functools.lru_cache(1)
def index(texts: tuple[bytes, ...]) -> Index:
    return Index(list(texts))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, windows, edits, start, end): how many of the item's windows are found, the fewest edits, and the characters they span, about."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    df = small_batches(docs).select(F.col(plain(doc_id)).alias("doc_id"), F.col(plain(text)).cast("string").alias("text")).where("text IS NOT NULL")
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, item_id {kind}, windows int, edits int, start bigint, end bigint"
    out = None
    for ids, texts in _passes(benchmark, item_id, item_text, pass_bytes):
        found = _pass(df, ids, texts, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _passes(benchmark: DataFrame, item_id: str, item_text: str, pass_bytes: int) -> Iterator[tuple[list, tuple[bytes, ...]]]:
    """(ids, texts in lower case) of the items of each pass."""
    items = benchmark.select(F.col(plain(item_id)).alias("item_id"), F.col(plain(item_text)).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        got = sorted((r.item_id, r.text) for r in part.collect())
        yield [i for i, _ in got], tuple(t.encode() for t in pc.utf8_lower(pa.array([t for _, t in got], pa.string())).to_pylist())


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents that no item contaminates, with their columns as they are."""

    def mask(texts: tuple[bytes, ...]):
        def own(col: pa.Array) -> np.ndarray:
            x, new, _ = even_out(*buffers(pc.utf8_lower(col)))
            good = np.ones(len(col), bool)
            good[index(texts).search(x, new)[0]] = False
            return good

        return own

    for _, texts in _passes(benchmark, item_id, item_text, pass_bytes):
        docs = filtered(docs, text, mask(texts))
    return docs


def _pass(df: DataFrame, ids: list, texts: tuple[bytes, ...], schema: str) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(texts)
        for batch in slices(batches, "text"):
            data, offs = buffers(pc.utf8_lower(batch.column(1)))
            x, new, at = even_out(data, offs)
            doc, window, edits, start, end = ix.search(x, new)
            if not len(doc):
                continue
            item = ix.item[window]
            by = np.lexsort((item, doc))
            doc, item, edits, start, end = (v[by] for v in (doc, item, edits, start, end))
            edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
            doc_, item_ = doc[edge], item[edge]
            first, last = np.minimum.reduceat(start, edge), np.maximum.reduceat(end, edge)
            letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            place = [letters[at[new[doc_] + first]] - letters[offs[doc_]], letters[at[new[doc_] + last - 1] + 1] - letters[offs[doc_]]]
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(doc_)),
                    pa.array([ids[i] for i in item_]).cast(kind_of),
                    pa.array(np.diff(np.append(edge, len(doc))).astype(np.int32)),
                    pa.array(np.minimum.reduceat(edits, edge).astype(np.int32)),
                    *[pa.array(p.astype(np.int64)) for p in place],
                ],
                ["doc_id", "item_id", "windows", "edits", "start", "end"],
            )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind_of = to_arrow_type(_parse_datatype_string(schema)["item_id"].dataType)
    return df.mapInArrow(run, schema)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
