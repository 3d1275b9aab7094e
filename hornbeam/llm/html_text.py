"""Main text of HTML pages by a tree-structured graphical model.

A page is a tree of blocks (:mod:`html_tree`).  Each node is main text or not.  A node's own potential is a sum of weights of
its features: element, class words, length, share of links, place, neighbours.  Potentials of each edge tie a child to its
parent.  Two passes of sum-product messages, from the leaves up and from the root down, give the exact marginal of every
node, and the leaves with at least ``threshold`` are the text.  Weights are the maximum-likelihood ones for labelled pages,
fitted with the same two passes: the gradient is what the labels have minus what the marginals expect.

Messages pass level by level for all trees of some hundred pages at once.  Pages are independent: there is no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.llm.html_labels import labelled_pages
from hornbeam.llm.html_tree import CONTROLS, Page, read_page
from hornbeam.llm.kernels import slices


@dataclass(frozen=True)
class Settings:
    """At most ``max_pages`` labelled pages of at most ``max_bytes`` together reach the driver to fit on; class words count from
    ``min_pages`` pages on and ``max_words`` of them at most."""

    max_pages: int = 2000
    max_bytes: int = 20_000_000
    min_pages: int = 2
    max_words: int = 4000
    rounds: int = 200
    step: float = 0.08
    ridge: float = 5e-5  # of class words a tenth: they are rare, and say more than looks
    threshold: float = 0.5


class Forest:
    """Trees whose nodes are listed parents first.  Messages go level by level."""

    def __init__(self, parent: np.ndarray, kind: np.ndarray, depth: np.ndarray):
        self.parent, self.kind = parent, kind
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange((depth.max() if len(depth) else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
        place = np.empty(len(parent), np.int64)
        for level in self.levels:
            place[level] = np.arange(len(level))
        self.up = [place[parent[level]] for level in self.levels]  # where a level's parents are in the level above

    def _gather(self, d: int, values: np.ndarray, out: np.ndarray) -> None:
        """Add values of level ``d`` to their parents in ``out``."""
        above = self.levels[d - 1]
        out[above] += np.bincount(self.up[d], values, len(above))

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree."""
        out = values.astype(np.float64)
        for d in range(len(self.levels) - 1, 0, -1):
            self._gather(d, out[self.levels[d]], out)
        return out

    def marginals(self, unary: np.ndarray, edges: np.ndarray, expected: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """(probability of each node to be 1, ``expected`` edges by kind and states, log of the partition function) where 1 has
        the potential ``unary`` against 0, and ``edges[kind, state of parent, state of child]``."""
        own = [np.zeros(len(unary)), unary.astype(np.float64)]  # what a node knows from below
        sent = np.zeros((len(unary), 2))
        for d in range(len(self.levels) - 1, 0, -1):
            level = self.levels[d]
            tie = edges[self.kind[level]]
            for state in (0, 1):
                sent[level, state] = np.logaddexp(own[0][level] + tie[:, state, 0], own[1][level] + tie[:, state, 1])
                self._gather(d, sent[level, state], own[state])
        got = np.zeros((len(unary), 2))
        pairs = np.zeros_like(edges)
        for level in self.levels[1:]:
            up = self.parent[level]
            rest = np.stack([own[s][up] + got[up, s] - sent[level, s] for s in (0, 1)], axis=1)  # what the parent knows without this child
            both = rest[:, :, None] + edges[self.kind[level]]
            got[level] = np.logaddexp(both[:, 0, :], both[:, 1, :])
            if expected:
                joint = both + np.stack([own[0][level], own[1][level]], axis=1)[:, None, :]
                joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                for k in range(len(edges)):
                    pairs[k] += joint[self.kind[level] == k].sum(axis=0)
        roots = self.levels[0]
        total = float(np.logaddexp(own[0][roots], own[1][roots]).sum())
        return 1 / (1 + np.exp(np.clip(own[0] + got[:, 0] - own[1] - got[:, 1], -700, 700))), pairs, total


_TAGS = (
    "#page #text address article aside blockquote button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label legend "
    "li main menu nav ol option output p pre search section select summary table tbody td tfoot th thead tr ul"
).split()  # a fixed list; others share a place
_TAG = {t: i for i, t in enumerate(_TAGS)}
_OTHER = len(_TAGS)
_INSIDE = {**dict.fromkeys(("article", "main"), 1), **dict.fromkeys(("nav", "aside", "footer", "form", "dialog"), 2)}
_FLOWING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption caption".split())
_ENDS = tuple(".!?…。！？:;\"”»")
#: Edge kinds: to a leaf, to an element that holds running text, to any other element.
KINDS = 3


def _words_of(names: str) -> list[str]:
    """Class words: parts between signs and at changes of case, and the first five letters of longer ones.  A leaf has those
    of its element after a ``>``, as words of their own."""
    if names[0] == ">":
        return [">" + w for w in _words_of(names[1:])]
    parts, word, low = [], "", False
    for c in names:
        if not c.isalpha() or (c.isupper() and low):
            parts.append(word)
            word = c if c.isalpha() else ""
        else:
            word += c
        low = c.islower()
    out = [w.lower() for w in (*parts, word) if len(w) > 1]
    if "#hidden" in names.split():
        out.append("#hidden")
    return list(dict.fromkeys([*out, *(w[:5] + "~" for w in out if len(w) > 5)]))


def _tables(pages: list[Page]) -> tuple[Forest, dict[str, np.ndarray], list[list[int]]]:
    """The forest of some pages, categorical features of its nodes, and the kept nodes of each page in page order.  Elements
    without any text are left out."""
    parent, depth, tag, kind, names, chars, linked, inputs, ends, sign, fixed, inside, mark, page_of = ([] for _ in range(14))
    kept: list[list[int]] = []
    for number, page in enumerate(pages):
        n = len(page.tag)
        full = [t is not None for t in page.text]
        for i in range(n - 1, 0, -1):
            if full[i]:
                full[page.parent[i]] = True
        full[0] = True
        place, own, within = {}, [], [0] * n
        for i in range(n):
            up = page.parent[i]
            if i:
                within[i] = _INSIDE.get(page.tag[i], within[up])
            if not full[i]:
                if up >= 0:
                    page.inputs[up] += page.inputs[i]
                continue
            place[i] = len(parent)
            own.append(i)
            text, leaf = page.text[i], page.text[i] is not None
            parent.append(place[up] if up >= 0 else -1)
            depth.append(depth[parent[-1]] + 1 if up >= 0 else 0)
            tag.append(_TAG.get(page.tag[up] if leaf else page.tag[i], _OTHER))
            kind.append(0 if leaf else 1 if page.tag[i] in _FLOWING else 2)
            names.append((page.names[up] and ">" + page.names[up]) if leaf else page.names[i])
            chars.append(len(text) if leaf else 0)
            linked.append(page.linked[i])
            ends.append(leaf and text.endswith(_ENDS))
            sign.append(leaf and ("©" in text or "(c)" in text.lower()))
            fixed.append(page.fixed[i])
            inside.append(within[i])
            mark.append(page.mark[i])
            page_of.append(number)
        for i in own:
            inputs.append(page.inputs[i])
        kept.append(own)
    a = lambda x: np.array(x, np.int64)
    forest = Forest(a(parent), a(kind), a(depth))
    parent, tag, kind, page_of = a(parent), a(tag), a(kind), a(page_of)
    leaf = kind == 0
    size, links, ending, count = (forest.total(a(x)) for x in (chars, linked, np.where(leaf, ends, 0), leaf))
    whole = np.bincount(page_of[leaf], size[leaf], len(pages)) if len(parent) else np.zeros(0)
    length = np.minimum(np.log2(size + 1).astype(np.int64), 11)
    share = np.digitize(links / np.maximum(size, 1), [0.02, 0.2, 0.5, 0.9])
    before = np.cumsum(np.where(leaf, size, 0)) - np.where(leaf, size, 0)
    first = np.searchsorted(page_of, np.arange(len(pages)))
    before = before - before[first][page_of] if len(parent) else before
    around = np.zeros((2, len(parent)), np.int64)
    at = np.flatnonzero(leaf)
    told = 1 + np.minimum(length[at], 9) * 3 + np.minimum(share[at], 2)
    same = page_of[at][1:] == page_of[at][:-1]
    around[0][at[1:]], around[1][at[:-1]] = np.where(same, told[:-1], 0), np.where(same, told[1:], 0)
    control = np.minimum(forest.total(a(inputs)), 2).astype(np.int64)
    own_control = np.where(leaf, np.minimum(a(inputs)[parent] if len(parent) else 0, 2), control)
    side = leaf.astype(np.int64)
    out = {
        "element": tag * 2 + side,
        "element, around": (tag * 3 + a(inside)) * 2 + side,
        "length, links": (length * 5 + share) * 2 + side,
        "length, end": (length * 3 + np.digitize(ending / np.maximum(count, 1), [0.01, 0.5])) * 2 + side,
        "share of page": np.digitize(size / np.maximum(whole[page_of], 1), [0.02, 0.1, 0.3, 0.6, 0.9]) * 2 + side if len(parent) else tag,
        "place": np.minimum(10 * before / np.maximum(whole[page_of], 1), 9).astype(np.int64) * 2 + side if len(parent) else tag,
        "before": around[0], "after": around[1],
        "controls": own_control * 2 + side,
        "sign": a(sign) * 2 + side,
        "parent": np.where(parent >= 0, tag[parent], _OTHER) * (_OTHER + 1) + tag if len(parent) else tag,
    }
    out["#fixed"], out["#mark"], out["#leaf"], out["#size"] = a(fixed), a(mark), side, size
    forest.names = names
    return forest, out, kept


@dataclass
class Model:
    """Weights: by feature and value, by class word, and of edges.  Its size is bounded by :class:`Settings`."""

    tables: dict[str, np.ndarray]
    words: dict[str, float]
    edges: np.ndarray
    threshold: float

    def unary(self, forest: Forest, features: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(forest.parent))
        for name, w in self.tables.items():
            out += w[np.minimum(features[name], len(w) - 1)]
        seen: dict[str, float] = {}
        for i, names in enumerate(forest.names):
            if names:
                if names not in seen:
                    seen[names] = sum(self.words.get(w, 0.0) for w in _words_of(names))
                out[i] += seen[names]
        return np.where(features["#fixed"] > 0, -60.0, out)

    def marginals(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        forest, features, kept = _tables(pages)
        return forest.marginals(self.unary(forest, features), self.edges)[0], features["#leaf"], kept

    def blocks(self, pages: list[Page]) -> list[list[tuple[str, float]]]:
        """(text, marginal) of every block of each page, in page order."""
        p, _, kept = self.marginals(pages)
        out, at = [], 0
        for page, own in zip(pages, kept):
            out.append([(page.text[i], p[at + j]) for j, i in enumerate(own) if page.text[i] is not None])
            at += len(own)
        return out


def fit(sources: Iterable[str], s: Settings = Settings()) -> Model:
    """A model of labelled pages: HTML whose elements say by ``data-main`` 1 or 0 whether they hold main text; the nearest
    one around a text decides, and without any it is not main.  An element is main if half of the text in it is."""
    pages = [read_page(x) for x in sources]
    forest, features, _ = _tables(pages)
    n = len(forest.parent)
    main = forest.total(np.where(features["#leaf"] > 0, features["#size"] * features["#mark"], 0))
    y = np.where(features["#leaf"] > 0, features["#mark"], 2 * main >= features["#size"]).astype(np.float64)
    y = np.where(features["#fixed"] > 0, 0.0, y)
    listed = [_words_of(x) if x else [] for x in forest.names]
    counts = Counter(w for words in listed for w in words)
    vocabulary = {w: i for i, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: s.max_words]) if c >= s.min_pages}
    node = np.array([i for i, words in enumerate(listed) for w in words if w in vocabulary], np.int64)
    word = np.array([vocabulary[w] for words in listed for w in words if w in vocabulary], np.int64)
    names = [k for k in features if not k.startswith("#")]
    sizes = [int(features[k].max()) + 1 if n else 1 for k in names]
    starts = np.concatenate(([0], np.cumsum([*sizes, len(vocabulary)]))).astype(np.int64)
    weights = np.zeros(starts[-1] + KINDS * 4)
    first = second = np.zeros_like(weights)
    ridge = np.full(len(weights), s.ridge)
    ridge[starts[-2] : starts[-1]] /= 10
    child = np.flatnonzero(forest.parent >= 0)
    had = np.zeros((KINDS, 2, 2))
    np.add.at(had, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    for t in range(1, s.rounds + 1):
        unary = sum((weights[a + features[k]] for k, a in zip(names, starts)), np.zeros(n))
        np.add.at(unary, node, weights[starts[-2] + word])
        p, pairs, _ = forest.marginals(np.where(features["#fixed"] > 0, -60.0, unary), weights[starts[-1] :].reshape(KINDS, 2, 2), expected=True)
        off = np.where(features["#fixed"] > 0, 0.0, y - p)
        slope = np.concatenate([*(np.bincount(features[k], off, m) for k, m in zip(names, sizes)), np.bincount(word, off[node], len(vocabulary)), (had - pairs).ravel()])
        slope = slope / max(n, 1) - ridge * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights + s.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    tables = {k: np.append(weights[a : a + m], 0.0) for k, a, m in zip(names, starts, sizes)}  # an unseen value weighs nothing
    return Model(tables, {w: float(weights[starts[-2] + i]) for w, i in vocabulary.items()}, weights[starts[-1] :].reshape(KINDS, 2, 2), s.threshold)


def train(labelled: DataFrame, html: str = "html", s: Settings = Settings()) -> Model:
    """:func:`fit` on a table of labelled pages; those with the least hashes, as many as the bounds of ``s`` allow."""
    rows = labelled.where(F.col(html).isNotNull()).select(F.col(html).alias("html")).orderBy(F.xxhash64("html"), "html").limit(s.max_pages)
    taken, size = [], 0
    for (source,) in rows.toLocalIterator():
        size += len(source)
        if size > s.max_bytes:
            break
        taken.append(source)
    return fit(taken, s)


def default_model() -> Model:
    """The model of the pages that :mod:`html_labels` makes by rule."""
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (its columns ``keep``, or all) with ``text``, the main text, and ``n_chars``, its code points.

    Blocks of main text in page order, joined by two line ends; in a block character references are decoded, Unicode white
    space becomes one space and is trimmed; line breaks of a block are white space.  Nothing else is dropped or cut.  A null
    or empty page, and one without main text, has an empty ``text``.  Broken markup is read as far as it goes: an unclosed
    script or comment reaches to the end.  Repeated rows get a row each; columns of ``pages`` with the new names are replaced.
    """
    added = T.StructType.fromDDL("text string, n_chars long")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in set(added.names)]
    rows = pages.select(*kept, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            sources = batch.column(batch.num_columns - 1).to_pylist()
            texts = ["\n\n".join(t for t, p in found if p >= model.threshold) for found in model.blocks([read_page(x) for x in sources])]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, *added.names])

    return rows.mapInArrow(work, T.StructType([*pages.select(*kept).schema.fields, *added.fields]))
