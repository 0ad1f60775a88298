"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the distinct pieces of its part of the corpus, ``CORPUS_BYTES`` of text at a time, and keeps what it has learnt of them: a piece is
merged once, however often it comes. New pieces lie in one symbol array. An
inverted index leads from each mergeable pair to the positions where it stands;
merges are applied in rank order, each to all its positions at once, and only
the neighbours that a merge touched are looked up again. Documents are then put
together from their pieces' tokens. A task needs nothing from another task, so
encoding shuffles nothing at any size.

Defined results
    null text      null tokens and a null count; decoding null gives null
    empty text     no tokens, count 0; decoding no tokens gives the empty text
    repeated rows  each is encoded
    very long text one slice of its own; nothing is cut, and a single piece may be as long as the text
    ties           two places of one pair that overlap: the left one is merged
    empty table    no rows
    other columns  pass through; one that is named as a new column is replaced
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import buffers, release, SLICE_BYTES, slices, small_batches
from ._storage import plain, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text whose pieces are merged together.
CORPUS_BYTES = 8 << 20
#: Pieces, and bytes of them, that a worker keeps; beyond, it begins anew.
PIECES, PIECE_BYTES = 1 << 18, 8 << 20


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Numbers pieces as they come."""

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        return k


class Merges:
    """A vocabulary's merges: ranks by pair, and the bytes of every token."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte[b] = vocab[c]
        texts = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        size = np.array([len(texts.get(i, b"")) for i in range(max(vocab.values()) + 1)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(len(size))), np.uint8)
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known, self.known_bytes = _Pieces(), 0
        self.tokens, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's pieces, of which ``tokens`` and ``first`` have the tokens until the next call."""
        if len(self.known) > PIECES or self.known_bytes > PIECE_BYTES:
            self.forget()
        had = len(self.known)
        ids = [np.fromiter(map(self.known.__getitem__, self.split(x)), np.int32) if x else np.zeros(0, np.int32) for x in texts]
        fresh = [p.encode() for p in itertools.islice(self.known, had, None)]
        if fresh:
            offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))])
            self.known_bytes += int(offs[-1])
            tokens, first = self.replay(np.frombuffer(b"".join(fresh), np.uint8), offs)
            self.tokens, self.first = np.append(self.tokens, tokens), np.append(self.first, self.first[-1] + first[1:])
        return ids

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        ids = self.pieces(texts)
        count = np.diff(self.first)
        return np.array([count[x].sum() for x in ids], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair doesn't merge."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def replay(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces ``data[offs[i]:offs[i + 1]]``: (tokens, where each piece's begin)."""
        n = len(data)
        sym = np.append(self.byte[data], -1)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        full = np.diff(offs) > 0
        nxt[offs[1:][full] - 1] = n  # n stands for a piece's border
        prv[offs[:-1][full]] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at) == 1:
                groups = [(int(rank[0]), at)]
            elif len(at):
                by = np.argsort(rank, kind="stable")
                at, rank = at[by], rank[by]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts))
            else:
                return
            for r, own in groups:
                if (there := index.get(r)) is None:
                    index[r] = [own]
                    heapq.heappush(heap, r)
                else:
                    there.append(own)

        add(np.flatnonzero(nxt[:n] < n))
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of the same symbol, pairs form from the left
                chained = np.append(False, at[1:] == nxt[at[:-1]])
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.made[r], -1
            nxt[at], prv[after] = after, at
            before = prv[at]
            add(np.concatenate([before[before < n], at[after < n]]))
        live = np.flatnonzero(sym[:n] >= 0)
        return sym[live].astype(np.int32), np.searchsorted(live, offs)

    def decode(self, tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lists of tokens: (bytes, where each list's begin)."""
        size = (self.starts[1:] - self.starts[:-1])[tokens]
        begin = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.starts[tokens] - begin[:-1], size) + np.arange(begin[-1])], begin[offs]


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def encode_slice(m: Merges, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Encode texts together. Yields (number of texts, their tokens, where each text's begin), about 2 MB of text at a time."""
    ids = m.pieces(texts)
    tokens, first = m.tokens, m.first
    count = np.diff(first)
    at = 0
    while at < len(ids):
        to, size = at, 0
        while to < len(ids) and (to == at or size < SLICE_BYTES // 4):
            size += len(ids[to])
            to += 1
        own = np.concatenate(ids[at:to])
        n = count[own]
        begin = np.concatenate([[0], np.cumsum(n)])
        yield to - at, tokens[np.repeat(first[own] - begin[:-1], n) + np.arange(begin[-1])], begin[np.concatenate([[0], np.cumsum([len(x) for x in ids[at:to]])])]
        at = to


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """``keep``'s columns (all by default), with ``n_tokens`` and ``tokens``; ``check`` adds ``round_trip``: decoding gives the text again."""
    new = {"n_tokens", "tokens"} | ({"round_trip"} if check else set())
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    df = small_batches(docs).select(*[F.col(plain(c)) for c in kept], F.col(plain(text)).cast("string").alias("__text"))
    fields = [*df.schema.fields[:-1], T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    if check:
        fields.append(T.StructField("round_trip", T.BooleanType()))
    names = [x.name for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            col = part.column(part.num_columns - 1)
            at = 0
            for n, tokens, first in encode_slice(m, col.to_pylist()):
                own = col.slice(at, n)
                null = own.is_null()
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens), mask=null) if own.null_count else pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens))
                out = [part.column(k).slice(at, n) for k in range(part.num_columns - 1)]
                out += [pa.array(np.diff(first).astype(np.int32), mask=null.to_numpy(zero_copy_only=False)), lists]
                if check:
                    back, begin = m.decode(tokens, first)
                    data, offs = buffers(own)
                    if len(back) == len(data) and np.array_equal(begin, offs):
                        differs = np.concatenate([[0], np.cumsum(back != data)])
                        same = differs[offs[1:]] == differs[offs[:-1]]
                    else:
                        same = np.array([back[begin[i] : begin[i + 1]].tobytes() == data[offs[i] : offs[i + 1]].tobytes() for i in range(n)])
                    out.append(pa.array(same, mask=null.to_numpy(zero_copy_only=False)))
                yield pa.record_batch(out, names)
                at += n

        for batch in slices(batches, "__text"):
            held.append(batch)
            size += batch.nbytes
            if size >= CORPUS_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        release()

    return df.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, tokens: str = "tokens", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns, with ``text`` decoded from ``tokens``; bytes that aren't UTF-8 become U+FFFD, an id outside the vocabulary is an error."""
    kept = [c for c in df.columns if c != text]
    src = df.select(*[F.col(plain(c)) for c in kept], F.col(plain(tokens)).cast("array<int>").alias("__tokens"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary)
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            lists = col.to_pylist()
            flat = np.array([t for x in lists for t in x or ()], np.int64)
            offs = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            if len(flat) and not 0 <= flat.min() <= flat.max() < len(m.starts) - 1:
                raise ValueError("a token id is outside the vocabulary")
            data, begin = m.decode(flat, offs)
            texts = [None if x is None else data[begin[i] : begin[i + 1]].tobytes().decode("utf-8", "replace") for i, x in enumerate(lists)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return src.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"], check=True)
