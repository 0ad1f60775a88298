"""Chat formatting: roles recovered from transcripts by a hidden Markov model.

A transcript is a text of lines; some begin with a speaker's marker ("User:", "## Assistant:", "[bot]", "Q:"), which may not tell who it is
("Speaker:"), others don't, because they go on with a turn or the marker got lost. Hidden states are the roles, each as a turn's first line and
as a later line. A state emits the marker's role (or someone's, or none) and features of the line; start, transition and
emission probabilities are smoothed counts of labelled conversations, of whose markers a share is left out, and a share made
anonymous, so that such lines are known, too. Viterbi decoding recovers the roles, and the turns are rendered canonically.

Defined results
    null transcript        null text, roles and count
    empty transcript       no turns: empty text and roles
    blank lines            belong to the turn that they stand in; at a turn's ends they are dropped
    very long transcript   decoded whole, one step a line
    empty tables           no rows; no labelled lines
    no labelled lines      a line with a marker has its role, the others go on with the turn; the first is the user's, and after an
                           anonymous marker the other of user and assistant speaks
    a marker of no role    is text; a marker that decoding overrules is kept as text
    ties in decoding       the role that comes first in ``ROLES``
    conversations          rows of null id are left out; ties in ``turn`` stand in order of role and text; repeated rows are
                           repeated turns; a null text is an empty turn, a null role has no marker
    other columns          aren't read
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import slices
from ._storage import plain, table

ROLES = ("system", "user", "assistant")
#: Bound of the labelled conversations, and the shares of their markers that are left out and made anonymous.
TRAIN_CONVERSATIONS, LOST, ANONYMOUS = 2000, 0.02, 0.3

_ALIASES = {
    "system": "system sys instruction instructions context",
    "user": "user human prompter customer client question q me",
    "assistant": "assistant bot ai gpt chatgpt model answer a agent support",
}
_ROLE = {name: k for k, role in enumerate(ROLES) for name in _ALIASES[role].split()}
_SOME, _NONE = len(ROLES), len(ROLES) + 1
_SPEAKER = {**_ROLE, **dict.fromkeys("speaker participant person voice someone unknown".split(), _SOME)}
_MARKER = re.compile(r"\s*[#>*\[(<|\-]*\s*(" + "|".join(sorted(_SPEAKER, key=len, reverse=True)) + r")\s*(?:[*\])|>]*\s*:\s*[*]*|[\])|>]+\s*)\s*", re.I)
_SIZES = (_NONE + 1, 12, 2, 2, 2)


def marker(line: str) -> tuple[int, int]:
    """(role of the marker that the line begins with, its length); (none, 0) without one."""
    m = _MARKER.match(line)
    return (_SPEAKER[m[1].lower()], m.end()) if m else (_NONE, 0)


def observe(line: str) -> tuple[int, tuple[int, ...]]:
    """(length of the marker, what a state emits)."""
    role, n = marker(line)
    text = line[n:].strip()
    return n, (role, min(11, len(text).bit_length()), int(text.endswith("?")), int(text[:1].islower()), int(not text))


class Model:
    """Log probabilities of the chain; state 2r begins a turn of role r, 2r + 1 goes on with it."""

    def __init__(self, transcripts: list[list[tuple[int, tuple[int, ...]]]]):
        """``transcripts``: per line (state, emission)."""
        k = 2 * len(ROLES)
        start, move = np.full(k, 0.1), np.full((k, k), 0.1)
        emit = [np.full((k, n), 0.5) for n in _SIZES]
        if not transcripts:  # markers decide, and a line without one goes on
            move[range(k), [s | 1 for s in range(k)]] += 50
            start[2] += 50
            move[[2, 3, 4, 5], [4, 4, 2, 2]] += 1
        for s in range(k):  # what markers mean is known without any labels
            emit[0][s, s // 2 if s % 2 == 0 else _NONE] += 20 if transcripts else 20_000
            emit[0][s, _SOME] += (s % 2 == 0) * (5 if transcripts else 5_000)
        for lines in transcripts:
            for i, (s, x) in enumerate(lines):
                if i:
                    move[lines[i - 1][0], s] += 1
                else:
                    start[s] += 1
                for f, v in enumerate(x):
                    emit[f][s, v] += 1
        start[1::2] = 0  # a later line comes after a line of its turn
        for s in range(k):
            for to in range(1, k, 2):
                if to // 2 != s // 2:
                    move[s, to] = 0
        with np.errstate(divide="ignore"):
            self.start = np.log(start / start.sum())
            self.move = np.log(move / move.sum(1, keepdims=True))
            self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]

    def decode(self, transcripts: list[np.ndarray]) -> list[np.ndarray]:
        """States of the lines of each transcript, from their emissions; transcripts side by side."""
        size = np.array([len(t) for t in transcripts])
        out = [np.zeros(0, np.int64)] * len(transcripts)
        by = np.argsort(-size, kind="stable")
        by = by[size[by] > 0]
        for at in range(0, len(by), 512):
            own = by[at : at + 512]
            t = int(size[own[0]])
            live = np.searchsorted(-size[own], -np.arange(t), "left")
            e = np.zeros((t, len(own), len(self.start)))
            for j, i in enumerate(own):
                x = transcripts[i]
                e[: len(x), j] = sum(table_[:, x[:, f]].T for f, table_ in enumerate(self.emit))
            best = self.start + e[0]
            back = np.zeros((t, len(own), len(self.start)), np.int8)
            for k in range(1, t):
                w = live[k]
                x = best[:w, :, None] + self.move
                back[k, :w] = x.argmax(1)
                best[:w] = x.max(1) + e[k, :w]
            y = best.argmax(1)
            states = np.zeros((t, len(own)), np.int64)
            for k in range(t - 1, -1, -1):
                w = live[k]
                states[k, :w] = y[:w]
                if k:
                    y[:w] = back[k, np.arange(w), y[:w]]
            for j, i in enumerate(own):
                out[i] = states[: size[i], j]
        return out


def turns(lines: list[str], cut: list[int], seen: np.ndarray, states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn; ``cut`` has the markers' lengths, ``seen`` their roles."""
    out: list[tuple[str, list[str]]] = []
    for line, n, m, s in zip(lines, cut, seen, states.tolist()):
        text = line[n:] if s % 2 == 0 and m in (s // 2, _SOME) else line
        if s % 2 == 0:
            out.append((ROLES[s // 2], []))
        out[-1][1].append(text.rstrip())
    return [(role, "\n".join(x).strip()) for role, x in out]


def render(said: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in said)


def train(conversations: DataFrame, most: int = TRAIN_CONVERSATIONS, lost: float = LOST, anonymous: float = ANONYMOUS) -> bytes:
    """The model, pickled, of labelled (conv_id, turn, role, text) rows of ``most`` conversations, chosen by a hash of their id."""
    rows = conversations.where(F.col("conv_id").isNotNull() & F.lower("role").isin(*_ROLE))
    ids = rows.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(most)
    got = rows.join(F.broadcast(ids), "conv_id").select("conv_id", "turn", F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).collect()
    said: dict = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn is not None, r.turn, r.role, r.text)):
        said.setdefault(r.conv_id, []).append(r)
    transcripts = []
    for conv in said.values():
        lines = []
        for k, r in enumerate(conv):
            role = _ROLE[r.role]
            chance = zlib.crc32(f"{r.conv_id}/{k}".encode()) / 2**32
            shown = "" if chance < lost else "Speaker: " if chance < lost + anonymous else f"{r.role}: "
            for i, text in enumerate(r.text.split("\n")):
                _, x = observe((shown if i == 0 else "") + text)
                lines.append((2 * role + (i > 0), x))
        transcripts.append(lines)
    return pickle.dumps(Model(transcripts))


@functools.lru_cache(1)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def parse(transcripts: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keep``'s columns with ``n_turns``, ``roles`` (in order, with commas) and the canonical ``text``."""
    new = ("n_turns", "roles", "text")
    df = transcripts.select(*[F.col(plain(c)) for c in keep if c not in new], F.col(plain(text)).cast("string").alias("__text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("n_turns", T.LongType()), T.StructField("roles", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in slices(batches, "__text"):
            raw = batch.column(batch.num_columns - 1).to_pylist()
            lines = [x.strip("\n").split("\n") if x and x.strip() else [] for x in raw]
            seen = [[observe(x) for x in own] for own in lines]
            arrays = [np.array([x for _, x in own], np.int64).reshape(len(own), len(_SIZES)) for own in seen]
            said = [turns(own, [n for n, _ in s], a[:, 0], y) for own, s, a, y in zip(lines, seen, arrays, m.decode(arrays))]
            none = [x is None for x in raw]
            yield pa.record_batch(
                [
                    *batch.columns[:-1],
                    pa.array([None if z else len(t) for z, t in zip(none, said)], pa.int64()),
                    pa.array([None if z else ",".join(r for r, _ in t) for z, t in zip(none, said)], pa.string()),
                    pa.array([None if z else render(t) for z, t in zip(none, said)], pa.string()),
                ],
                schema.names,
            )

    return df.mapInArrow(run, schema)


def transcripts_of(conversations: DataFrame, anonymous: float = 0.0) -> DataFrame:
    """(conv_id, text): the turns as a transcript, each after its role as marker.

    After a conversation's first turn a share of the markers, chosen by a hash of the conversation and the turn's place in it, is ``Speaker: `` instead.
    """
    turns_ = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("said"))))

    def line(t: Column, i: Column) -> Column:
        chance = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), i.cast("string"))), 1, 4), 16, 10).cast("int")
        mark = F.when(t["role"].isNull(), "").when((i > 0) & (chance < int(anonymous * 65536)), "Speaker: ").otherwise(F.concat(t["role"], F.lit(": ")))
        return F.concat(mark, t["said"])

    return conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(turns_.alias("turns")).select("conv_id", F.array_join(F.transform("turns", line), "\n").alias("text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all markers but the first of each conversation ``ANONYMOUS`` don't tell who speaks."""
    conversations = table(spark, sf_dir, "conversations")
    return parse(transcripts_of(conversations, ANONYMOUS), train(conversations))


#: The roles are known here, so that SQL can say what must be recovered.
ORACLE = r"""
SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
       string_agg('<|' || role || '|>' || chr(10) || trim(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), E' \n\t') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
"""
