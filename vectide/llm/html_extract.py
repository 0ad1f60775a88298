"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text within one block-level element. Features of a block are its ancestors' tags
and classes, and traits of its text. The field's weights are trained on labelled pages by the gradient
of the conditional likelihood (forward-backward over all chains at once), and Viterbi decoding finds the most likely
sequence of content and boilerplate. The content blocks' text, a line each, is the page's text.

Reading takes time linear in the page, however broken it is or deep: which features hold is kept as changes from block to
block, never as a path a block. Decoding runs over segments of ``SEGMENT`` blocks side by side, from either label, and
then joins the segments. In training a page of more than ``SEGMENT`` blocks counts as several chains.

Pages are labelled by the documents they were made from: a block is content where it equals a line of its document, or
begins a line and has at least ``TITLE`` characters.

Defined results
    null html          null text and counts
    empty html         empty text, 0 blocks; so too for pages without text
    broken html        unclosed and stray tags are put up with; an open comment or script runs to the end, a tag without an
                       end is text, and where quotes don't close, tags end at the next ">"
    very long pages    read and decoded whole; for training, labelled pages are used while they fit into ``TRAIN_BLOCKS``
    repeated rows      each row has its result
    empty tables       no rows; no labelled pages
    no labelled pages  every block is content
    ties in decoding   boilerplate
    other columns      only those named in ``keep`` are carried along
"""

from __future__ import annotations

import functools
import html as entities
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import slices, small_batches
from ._storage import plain, table

#: Bounds of the labelled pages that the field is trained on, and of their blocks.
TRAIN_PAGES, TRAIN_BLOCKS = 400, 100_000
SEGMENT = 256
TITLE = 20

_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_TAG = re.compile(r"</?[a-zA-Z][\w:-]*((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"</?[a-zA-Z][\w:-]*([^>]*+)>")
_OPAQUE = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style template noscript svg title".split()}
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag closes when it is still open, within the nearest list or table.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "select")

#: A block: its text, traits, and what has changed since the one before: features that hold now, and such that no longer do.
Block = tuple[str, tuple, list[str], list[str]]


def _pieces(page: str) -> Iterator[tuple[str, bool, str]]:
    """(tag or "", whether it closes, attributes or text) in order. Each sign of the page is looked at a few times at most."""
    at, n, last = 0, len(page), page.rfind(">")
    tag_at = _TAG
    while at < n:
        to = page.find("<", at)
        if to < 0 or to > last:  # no tag ends any more
            to = page.find("<!--", at if to < 0 else to)
            to = n if to < 0 else to
        if to > at:
            yield "", False, page[at:to]
        at = to
        if at == n:
            return
        if page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            at = n if to < 0 else to + 3
            continue
        if page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
            continue
        name = _NAME.match(page, at)
        if name is None:
            yield "", False, "<"
            at += 1
            continue
        m = tag_at.match(page, at)
        if m is None:  # quotes that don't close, which is found out once a page
            tag_at = _LOOSE
            m = tag_at.match(page, at)
        at = m.end()
        tag, closes = name[1].lower(), page[name.start() + 1] == "/"
        if tag in _OPAQUE and not closes:
            end = _OPAQUE[tag].search(page, at)
            at = end.end() if end else n
            continue
        yield tag, closes, m[1]


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[tuple] = []
    stack: list[tuple[str, list[str]]] = []
    places: dict[str, list[int]] = {}  # of open tags in the stack
    holds: dict[str, int] = {}  # features of the open tags
    before: dict[str, bool] = {}  # what the last block knew of the features that have changed since
    parts: list[str] = []
    linked = links = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = _SPACE.sub(" ", text).strip()
            if text:
                new = [f for f, was in before.items() if not was and holds.get(f)]
                old = [f for f, was in before.items() if was and not holds.get(f)]
                before.clear()
                out.append((text, min(1.0, linked / len(text)), min(len(stack), 8), stack[-1][0] if stack else "", new, old))
            parts.clear()
        linked = 0

    def push(tag: str, features: list[str]) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, features))
        for f in features:
            had = holds.get(f, 0)
            if not had:
                before.setdefault(f, False)
            holds[f] = had + 1

    def pop() -> None:
        tag, features = stack.pop()
        places[tag].pop()
        for f in features:
            holds[f] -= 1
            if not holds[f]:
                before.setdefault(f, True)

    def innermost(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    for tag, closes, more in _pieces(page):
        if not tag:
            parts.append(more)
            if links:
                linked += len(more)
        elif closes:
            if tag == "a":
                links = max(0, links - 1)
            if tag in _INLINE:
                continue
            end()
            if places.get(tag):
                for _ in range(len(stack) - places[tag][-1]):
                    pop()
        elif tag in _VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
        elif tag in _INLINE:
            if tag == "a":
                links += 1
        else:
            end()
            links = 0
            if stack and stack[-1][0] == "p":
                pop()
            if tag in _CLOSES:
                to = max(innermost((t,)) for t in _CLOSES[tag])
                if to > innermost(_LISTS):
                    for _ in range(len(stack) - to):
                        pop()
            features = ["under=" + tag]
            if "=" in more:
                for c in _CLASS.finditer(more):
                    features += ["class=" + word for word in (c[1] or c[2] or c[3] or "").lower().split()]
            push(tag, features)
    end()
    n = len(out)
    return [(text, _traits(text, share, i / n, depth, parent), new, old) for i, (text, share, depth, parent, new, old) in enumerate(out)]


def _traits(text: str, linked: float, place: float, depth: int, parent: str) -> tuple:
    n = len(text)
    return (min(12, n.bit_length()), min(8, (text.count(" ") + 1).bit_length()), int(linked * 3.999), text[-1] in ".!?:;", text[0].isupper(), "©" in text, any(c in text for c in "0123456789"), "|" in text or "·" in text, int(place * 4.999), depth, parent)


def _trait_features(key: tuple) -> list[str]:
    return [f"t{i}={v}" for i, v in enumerate(key)]


class Field:
    """Weights of a two-label linear chain; label 1 is content."""

    def __init__(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int = 200, rate: float = 0.1, decay: float = 1e-3):
        names: dict[str, int] = {}
        # a row a change: the feature, the block from which on it counts, in all of its page, and whether it comes or goes
        feature, since, sign, until, trait = [], [], [], [], []
        size = np.array([len(p) for p in pages])
        first = np.concatenate([[0], np.cumsum(size)])
        for page, at in zip(pages, first.tolist()):
            for i, (_, key, new, old) in enumerate(page):
                for names_, s in ((new, 1.0), (old, -1.0)):
                    for f in names_:
                        feature.append(names.setdefault(f, len(names)))
                        since.append(at + i)
                        until.append(at + len(page))
                        sign.append(s)
                trait.append([names.setdefault(f, len(names)) for f in _trait_features(key)])
        feature, since, until, sign, trait = np.array(feature, np.int64), np.array(since, np.int64), np.array(until, np.int64), np.array(sign), np.array(trait)
        y = np.concatenate(labels)
        # chains side by side
        begin = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first[:-1], first[1:])])
        end = np.minimum(begin + SEGMENT, first[np.searchsorted(first, begin, "right")])
        real = np.arange((end - begin).max()) < (end - begin)[:, None]
        n = len(begin)
        w, a = np.zeros((len(names), 2)), np.zeros((2, 2))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]

        def spread(per_block: np.ndarray) -> np.ndarray:
            """Each feature's sum over the blocks in which it holds."""
            total = np.concatenate([np.zeros((1, 2)), np.cumsum(per_block, 0)])
            out = np.zeros_like(w)
            np.add.at(out, feature, (total[until] - total[since]) * sign[:, None])
            np.add.at(out, trait, per_block[:, None, :])
            return out

        def score(w: np.ndarray) -> np.ndarray:
            change = np.zeros((len(y) + 1, 2))
            np.add.at(change, since, w[feature] * sign[:, None])
            np.subtract.at(change, until, w[feature] * sign[:, None])
            return np.cumsum(change[:-1], 0) + w[trait].sum(1)

        own = np.eye(2)[y]
        gold_w = spread(own)
        labels_ = np.zeros(real.shape, np.int64)
        labels_[real] = y
        both = real[:, 1:] & real[:, :-1]
        gold_a = np.zeros((2, 2))
        np.add.at(gold_a, (labels_[:, :-1][both], labels_[:, 1:][both]), 1.0)
        for step in range(1, epochs + 1):
            e = np.zeros((*real.shape, 2))
            e[real] = score(w)
            p, pair = self._marginals(e, a, real)
            grads = [(spread(p[real]) - gold_w) / n + decay * w, (pair - gold_a) / n + decay * a]
            for k, (x, g) in enumerate(zip((w, a), grads)):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weight = {f: w[i] for f, i in names.items()}
        self.change = a
        self._traits: dict[tuple, np.ndarray] = {}

    @staticmethod
    def _marginals(e: np.ndarray, a: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of each block, and the expected count of each change of label."""
        n, t, _ = e.shape
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for j in range(1, t):
            f[:, j] = np.where(real[:, j, None], e[:, j] + np.logaddexp(f[:, j - 1, [0]] + a[0], f[:, j - 1, [1]] + a[1]), f[:, j - 1])
        for j in range(t - 2, -1, -1):
            x = e[:, j + 1] + b[:, j + 1]
            b[:, j] = np.where(real[:, j + 1, None], np.logaddexp(a[:, 0] + x[:, [0]], a[:, 1] + x[:, [1]]), 0.0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f + b - z[:, None, None])
        x = (e + b)[:, 1:]
        pair = np.exp(f[:, :-1, :, None] + a + x[:, :, None, :] - z[:, None, None, None])
        return p, (pair * real[:, 1:, None, None]).sum((0, 1))

    def _sum(self, names: list[str]) -> np.ndarray:
        return sum((self.weight[f] for f in names if f in self.weight), np.zeros(2))

    def emissions(self, page: list[Block]) -> np.ndarray:
        """A row a block."""
        traits = self._traits
        if len(traits) > 200_000:
            traits.clear()
        change, own = np.zeros((len(page), 2)), np.zeros((len(page), 2))
        for i, (_, key, new, old) in enumerate(page):
            if (z := traits.get(key)) is None:
                z = traits[key] = self._sum(_trait_features(key))
            own[i] = z
            for f in new:
                if f in self.weight:
                    change[i] += self.weight[f]
            for f in old:
                if f in self.weight:
                    change[i] -= self.weight[f]
        return np.cumsum(change, 0) + own

    def decode(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The most likely labels of each page."""
        size = np.array([len(p) for p in pages], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        e = np.concatenate([np.zeros((0, 2)), *[self.emissions(p) for p in pages if p]])
        begin = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b, SEGMENT) for a, b in zip(first[:-1], first[1:])]]).astype(np.int64)
        if not len(begin):
            return [np.zeros(0, np.int64)] * len(pages)
        page = np.searchsorted(first, begin, "right") - 1
        count = np.minimum(begin + SEGMENT, first[page + 1]) - begin
        opens = begin == first[page]
        # lanes in order of length; the best scores of each lane for (label before it, label now)
        by = np.argsort(-count, kind="stable")
        at, t = begin[by], int(count[by[0]])
        live = np.searchsorted(-count[by], -np.arange(t), "left")
        best = np.where(opens[by, None, None], np.zeros((1, 2, 2)), self.change[None]) + e[at][:, None, :]
        back = np.zeros((len(e), 2, 2), np.int8)
        for k in range(1, t):
            w = live[k]
            x = best[:w, :, :, None] + self.change
            back[at[:w] + k] = x[:, :, 1] > x[:, :, 0]
            best[:w] = x.max(2) + e[at[:w] + k][:, None, :]
        score = np.empty_like(best)
        score[by] = best
        # from segment to segment: the label before each, given that at its end
        through = np.zeros((len(begin), 2), np.int64)
        last = np.zeros(len(begin), np.int64)
        rest = np.zeros(2)
        for i in range(len(begin)):
            if opens[i]:
                rest = score[i, 0]
            else:
                x = rest[:, None] + score[i]
                through[i] = x[1] > x[0]
                rest = x.max(0)
            if i + 1 == len(begin) or opens[i + 1]:
                last[i] = rest[1] > rest[0]
        for i in range(len(begin) - 1, 0, -1):
            if not opens[i]:
                last[i - 1] = through[i, last[i]]
        enter = np.where(opens, 0, through[np.arange(len(begin)), last])
        label = np.zeros(len(e), np.int64)
        y, came = last[by], enter[by]
        for k in range(t - 1, -1, -1):
            w = live[k]
            label[at[:w] + k] = y[:w]
            y[:w] = back[at[:w] + k, came[:w], y[:w]]
        return [label[a:b] for a, b in zip(first[:-1], first[1:])]


def _labels(blocks: list[Block], document: str) -> np.ndarray:
    lines = {_SPACE.sub(" ", x).strip() for x in document.split("\n")} - {""}
    long = [x for x in lines if len(x) >= TITLE]
    return np.array([t in lines or (len(t) >= TITLE and any(x.startswith(t) for x in long)) for t, *_ in blocks], np.int64)


def train(labelled: DataFrame, most: int = TRAIN_PAGES) -> bytes:
    """The trained field, pickled (b"" without labelled pages). ``labelled``: (html, document) rows; the first ``most`` by hash are used."""
    rows = labelled.where("html IS NOT NULL AND document IS NOT NULL").orderBy(F.xxhash64("html"), "html").limit(most).collect()
    pages, labels, room = [], [], TRAIN_BLOCKS
    for r in rows:
        blocks = leaf_blocks(r.html)
        if 0 < len(blocks) <= room:
            room -= len(blocks)
            pages.append(blocks)
            labels.append(_labels(blocks, r.document))
    return pickle.dumps(Field(pages, labels)) if pages else b""


@functools.lru_cache(1)
def _loaded(model: bytes) -> Field | None:
    return pickle.loads(model) if model else None


def extract(pages: DataFrame, model: bytes, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``'s columns with ``text``, ``n_blocks`` and ``n_content``."""
    new = ("text", "n_blocks", "n_content")
    df = small_batches(pages).select(*[F.col(plain(c)) for c in keep if c not in new], F.col(plain(html)).cast("string").alias("__html"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_content", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _loaded(model)
        for batch in slices(batches, "__html"):
            raw = batch.column(batch.num_columns - 1).to_pylist()
            blocks = [leaf_blocks(x) if x else [] for x in raw]
            labels = field.decode(blocks) if field else [np.ones(len(b), np.int64) for b in blocks]
            text = [None if x is None else "\n".join(t for (t, *_), y in zip(b, l) if y) for x, b, l in zip(raw, blocks, labels)]
            n = [None if x is None else len(b) for x, b in zip(raw, blocks)]
            m = [None if x is None else int(l.sum()) for x, l in zip(raw, labels)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(m, pa.int32())], schema.names)

    return df.mapInArrow(run, schema)


def labelled_pages(pages: DataFrame, documents: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    """(html, document): pages whose address ends in the id of the document they show; ids are chosen before any page or text is moved."""
    number = F.regexp_extract("url", r"/(\d+)(?:[?#].*)?$", 1)
    own = pages.select("html", F.when(number != "", number).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL AND html IS NOT NULL")
    ids = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = own.join(F.broadcast(ids), "doc_id")
    docs = documents.where("text IS NOT NULL").select("doc_id", F.col("text").alias("document")).join(F.broadcast(ids), "doc_id")
    return own.join(docs, "doc_id").select("html", "document")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(labelled_pages(pages, table(spark, sf_dir, "documents"))))
