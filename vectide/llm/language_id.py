"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A document is
parsed greedily into the longest phrases that occur in that text; the fewer
phrases it needs, the closer it is to the language. Phrases are normalised to
bits a byte (phrases x log2 of the labelled text's length / bytes), so languages
with more or less labelled text compare.

Documents are parsed side by side: automata are dense tables, and one numpy step
moves thousands of (segment, language) lanes on by a byte. For that a text is cut into
segments of ``SEGMENT`` bytes, each parsed as if a phrase began with it. Then the phrase that really crosses each
border is followed until it and the segment's own parse begin a phrase at the same byte, from where on they are the same.
So the phrases are those of the whole text, parsed from its beginning.

Defined results
    null or empty text   no language: null ``language``, ``bits`` and ``margin``
    very long text       parsed whole
    ties                 the first language in alphabetical order
    empty tables         no rows; no labelled text
    repeated rows        each row has its result
    no labelled text     every ``language`` is null
    one language only    ``margin`` is null
    other columns        only those named in ``keep`` are carried along; one that is named as a new column is left out
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import buffers, slices, small_batches
from ._storage import plain, table

SEGMENT = 1024
#: Bounds of the labelled text a language: documents, and bytes of them. Documents are taken whole.
TRAIN_DOCS, TRAIN_BYTES = 64, 40_000
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[[*range(33), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton whose paths from state 0 are exactly the substrings of ``text``."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Dense tables of all languages' automata; ``phrases`` parses many texts at once."""

    def __init__(self, texts: tuple[tuple[str, bytes], ...]):
        self.languages = [name for name, _ in texts]
        raw = [_CLASS[np.frombuffer(x, np.uint8)].tobytes() for _, x in texts]
        seen = sorted({*b"".join(raw)})
        self.symbol = np.zeros(256, np.int32)  # 0: in no labelled text
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbol = self.symbol[_CLASS]
        a = len(seen) + 1
        tables, self.start = [], []
        base = 0
        for x in raw:
            states = suffix_automaton(self._symbols(x, seen))
            fresh = np.full(a, base * a, np.int64)
            for c, to in states[0].items():
                fresh[c] = (base + to) * a
            t = np.tile(fresh | int(np.int64(1) << 31), (len(states), 1))  # a phrase begins; the bit marks it
            for s, row in enumerate(states):
                if s:
                    for c, to in row.items():
                        t[s, c] = (base + to) * a
            tables.append(t)
            self.start.append(base * a)
            base += len(states)
        self.table = np.concatenate(tables).astype(np.uint32).view(np.int32).ravel() if tables else np.zeros(0, np.int32)
        self.bits = np.array([np.log2(max(2, len(x))) for x in raw])

    @staticmethod
    def _symbols(x: bytes, seen: list[int]) -> bytes:
        to = np.zeros(256, np.uint8)
        to[seen] = np.arange(1, len(seen) + 1)
        return to[np.frombuffer(x, np.uint8)].tobytes()

    def phrases(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases that each text needs in each language: [text, language]."""
        n, k = len(offs) - 1, len(self.languages)
        size = np.diff(offs)
        parts = -(-size // SEGMENT)
        doc = np.repeat(np.arange(n), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offs[doc] + nth * SEGMENT
        end = np.minimum(offs[doc + 1], start + SEGMENT)
        out = np.zeros((n, k), np.int64)
        if not len(doc) or not k:
            return out
        sym = np.append(self.symbol[data], 0)
        begins = np.zeros((len(data), k), bool)  # where each segment's own parse begins phrases
        fresh = np.tile(np.array(self.start, np.int32), (len(doc), 1))
        count, own_end = self._run(sym, start, end, fresh, begins)
        state = own_end.copy()
        # follow what crosses each border; where it has come to nothing new at a segment's end, it goes on into the next one
        into = np.flatnonzero(nth > 0)
        came = state[into - 1]
        while len(into):
            seen, there, left, synced = self._follow(sym, start[into], end[into], came, begins)
            count[into] = seen + there
            # the state at the segment's end is another than the next one was given: that one is parsed again, from its own beginning on
            own = np.where(synced, own_end[into], left)
            changed = (own != state[into]).any(1)
            state[into] = own
            on = into[changed] + 1
            on = on[(on < len(doc))]
            on = on[nth[on] > 0]
            into, came = on, state[on - 1]
        np.add.at(out, doc, count)
        return out

    def _run(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin in each segment, state at its end); ``begins`` is told where."""
        by = np.argsort(start - end, kind="stable")
        left = (end - start)[by]
        live = np.searchsorted(-left, -np.arange(left[0]), "left")  # lanes longer than each step
        at, state = start[by].copy(), state[by].copy()
        count = np.zeros(state.shape, np.int64)
        for w in live.tolist():
            v = self.table.take(state[:w] + sym[at[:w], None])
            hit = v < 0
            begins[at[:w]] = hit
            count[:w] += hit
            state[:w] = v & 0x7FFFFFFF
            at[:w] += 1
        back = np.argsort(by)
        return count[back], state[back]

    def _follow(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each segment that is entered in a state: phrases that begin up to where both parses agree, those of the segment's own parse from there on, the state at the end, and whether they agreed."""
        m, k = state.shape
        state = state.copy()
        seen, there = np.zeros((m, k), np.int64), np.zeros((m, k), np.int64)
        lane, lang = (x.ravel() for x in np.indices((m, k)))
        synced = np.zeros((m, k), bool)
        step = 0
        while len(lane):
            at = start[lane] + step
            over = at >= end[lane]
            if over.any():
                lane, lang, at = lane[~over], lang[~over], at[~over]
                if not len(lane):
                    break
            v = self.table.take(state[lane, lang] + sym[at])
            hit = v < 0
            state[lane, lang] = v & 0x7FFFFFFF
            both = hit & begins[at, lang]
            seen[lane[hit & ~both], lang[hit & ~both]] += 1
            a, b = lane[both], lang[both]
            synced[a, b] = True
            for x, y, z in zip(a.tolist(), b.tolist(), at[both].tolist()):
                there[x, y] = np.count_nonzero(begins[z : end[x], y])
            lane, lang = lane[~both], lang[~both]
            step += 1
        return seen, there, state, synced

@functools.lru_cache(1)
def parser(texts: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(texts)


def labelled_text(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> tuple[tuple[str, bytes], ...]:
    """Labelled text a language, in lower case, of documents chosen by a hash of their id: at most ``most_docs`` documents, of which those that fit into ``most_bytes`` bytes, whole.

    Ids are ranked without the texts; only the chosen documents' texts come to the driver.
    """
    df = docs.select(F.col(plain(doc_id)).alias("doc_id"), F.col(plain(text)).cast("string").alias("text"), F.col(plain(label)).cast("string").alias("label"))
    by = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = df.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "label").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most_docs)
    ids = chosen.select("doc_id").distinct()  # most_docs x languages ids
    found = df.where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("label", "doc_id", F.lower("text").alias("text")).where("label IS NOT NULL").collect()
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for label_, own_id, text_ in sorted(found, key=lambda r: (r[0], r[1], r[2])):
        if text_:
            texts.setdefault(label_, []).append((own_id, text_.encode()))
    out = {}
    for name, parts in texts.items():
        # whole documents while there is room; if none fits, the shortest
        taken, room = [], most_bytes
        for _, p in parts:
            if len(p) <= room:
                taken.append(p)
                room -= len(p)
        out[name] = b"\n".join(taken or [min((p for _, p in parts), key=len)])
    return tuple(sorted(out.items()))


def identify(docs: DataFrame, texts: tuple[tuple[str, bytes], ...], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``'s columns with ``language``, ``bits`` (a byte, of the best) and ``margin`` (bits to the second)."""
    df = small_batches(docs).select(*[F.col(plain(c)) for c in keep if c not in ("language", "bits", "margin")], F.lower(F.col(plain(text)).cast("string")).alias("__text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("language", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("margin", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(texts)
        for batch in slices(batches, "__text"):
            data, offs = buffers(batch.column(batch.num_columns - 1))
            n = batch.num_rows
            none = np.diff(offs) == 0
            if p.languages:
                bits = p.phrases(data, offs) * p.bits / np.maximum(np.diff(offs), 1)[:, None]
                best = np.argmin(bits, 1)
                low = np.partition(bits, 1, 1)[:, :2] if len(p.languages) > 1 else None
                names = pa.array(p.languages).take(pa.array(best, mask=none))
                cost = pa.array(bits[np.arange(n), best], mask=none)
                margin = pa.array(low[:, 1] - low[:, 0], mask=none) if low is not None else pa.nulls(n, pa.float64())
            else:
                names, cost, margin = pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())
            yield pa.record_batch([*batch.columns[:-1], names, cost, margin], schema.names)

    return df.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, labelled_text(docs))
