"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags.  Words score by the elements and
class or id words around them, tags score below zero; the weights are fitted on
labelled pages (module labelled_pages) by logistic regression.  One linear scan
finds the best contiguous region; inside it, words that score below zero (a
notice or advert amid the article) are left out.  Text of scripts, styles and
other elements that never show is no word at all.

Defined cases.  Null or empty html, or no word that scores above zero: empty
text.  Of equal regions the first counts.  Broken markup: unclosed elements end
with their parent, stray end tags do nothing, an unclosed comment, script or
style ends with the page, `<` before no name is text.  Repeated rows give
equal rows; null ids and urls stay null; extra columns do not matter.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the HTML standard: elements without an end, elements inside a line, elements whose text never shows.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head title noscript template svg iframe select textarea object canvas audio video map math dialog datalist".split())
_BLOCK_IN_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# quotes hold a value only after =, as in the standard; nothing is tried twice (possessive), so a page is read in linear time
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>|<[!?][^>]*+>", re.S | re.I)
_CLOSED = re.compile(r"-->\Z|</(?:script|style)\s*>\Z", re.I)
_TAIL = re.compile(r"<!--.*|<(?:script|style)\b.*|<(?=[a-zA-Z/!?])[^<>]*\Z", re.S | re.I)
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

TAG_LEAST, TAG_MOST, DOWN = -0.05, -1.0, 0.25


@functools.lru_cache(4096)
def _hints(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, as features."""
    found = {p.lower() for m in _HINT.finditer(attributes) for v in m.groups() if v for p in _PART.findall(v)}
    return tuple(sorted(f".{p}" for p in found))


class _Open:
    """The elements around a place: how many of each name, and their features, each once, in the order in which they came."""

    def __init__(self, known):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.names: dict[str, int] = {}
        self.counts: dict[str, int] = {}
        self.known = known
        self.hidden = self.shown = 0  # hidden elements; elements below `shown` no longer hide
        self.tuple: tuple[str, ...] | None = ("",)

    def push(self, name: str, hints: tuple[str, ...]) -> None:
        features = tuple(f for f in dict.fromkeys((name, *hints)) if self.known is None or f in self.known)
        self.stack.append((name, features))
        self.names[name] = self.names.get(name, 0) + 1
        for f in features:
            self.counts[f] = self.counts.get(f, 0) + 1
        self.hidden += name in HIDDEN
        self.tuple = None

    def close(self, name: str) -> None:
        """Up to and with the last element of the name."""
        while self.stack:
            n, features = self.stack.pop()
            self.names[n] -= 1
            for f in features:
                self.counts[f] -= 1
                if not self.counts[f]:
                    del self.counts[f]
            self.hidden -= n in HIDDEN and len(self.stack) >= self.shown
            self.shown = min(self.shown, len(self.stack))
            self.tuple = None
            if n == name:
                break

    def show(self) -> None:
        self.hidden, self.shown = 0, len(self.stack)

    def features(self) -> tuple[str, ...]:
        if self.tuple is None:
            self.tuple = ("", *self.counts)
        return self.tuple


def tokens(page: str, known=None) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """('tag', name, ()) and ('text', raw text, features of the elements around) in page order; known: the only features that matter."""
    around = _Open(known)
    end = page.rfind(">") + 1  # no tag ends after this
    at = 0
    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > at and not around.hidden:
            yield "text", page[at : m.start()], around.features()
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            if at == end and (m.group(1) or m.group().startswith("<!--")) and not _CLOSED.search(m.group()):
                return  # a comment, script or style that never ends
            continue
        yield "tag", name, ()
        if m.group(2):
            if around.names.get(name):
                around.close(name)
        elif name not in VOID and not m.group(4).endswith("/"):
            if name in _BLOCK_IN_P and around.names.get("p"):
                around.close("p")
            if name == "body":
                around.show()
            around.push(name, _hints(m.group(4)))
    rest = page[at:]
    m = _TAIL.search(page, max(at, end)) if end <= len(page) else None
    rest = page[at : m.start()] if m else rest
    if rest and not around.hidden:
        yield "text", rest, around.features()


class Weights:
    """Scores of words by their features, and of tags by their names."""

    def __init__(self, words: dict[str, float], tags: dict[str, float]):
        self.words, self.tags = words, tags
        self.word = functools.lru_cache(8192)(self._word)

    def _word(self, features: tuple[str, ...]) -> float:
        s = sum(self.words.get(f, 0.0) for f in features)
        return min(s, 3.0) if s > 0 else max(s, -3.0) * DOWN

    def tag(self, name: str) -> float:
        return self.tags.get(name, TAG_LEAST)


def fit(pages: list[list[tuple[str, bool]]], rounds: int = 400, rate: float = 0.5, ridge: float = 2e-4) -> Weights:
    """Logistic regression of 'main text' on the features around each piece of text; log odds for tags."""
    rows, label, weight = [], [], []
    inside: dict[str, list[float]] = {}
    for page in pages:
        source = "".join(x for x, _ in page)
        edges = np.cumsum([len(x) for x, _ in page])
        at = 0
        for kind, value, features in tokens(source):
            at = source.index(value if kind == "text" else "<", at)
            main = page[int(np.searchsorted(edges, at, "right"))][1] if at < len(source) else False
            at += len(value) if kind == "text" else 1
            if kind == "tag":
                inside.setdefault(value, [1.0, 1.0])[0 if main else 1] += 1
            elif value.strip():
                rows.append(features)
                label.append(main)
                weight.append(len(value.split()))
    names = sorted({f for r in rows for f in r})
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [index[f] for f in r]] = 1.0
    y, w = np.array(label, float), np.sqrt(np.array(weight, float))
    w /= w.sum()
    beta, velocity = np.zeros(len(names)), np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        velocity = 0.9 * velocity - rate * (x.T @ (w * (p - y)) + ridge * beta) * 4
        beta = beta + velocity
    tags = {n: float(np.clip(0.1 * np.log(a / b), TAG_MOST, TAG_LEAST)) for n, (a, b) in inside.items()}
    return Weights(dict(zip(names, beta.tolist(), strict=True)), tags)


@functools.cache
def default_weights() -> Weights:
    from .labelled_pages import pages

    return fit(pages())


def extract(page: str | None, weights: Weights | None = None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    weights = weights or default_weights()
    # blocks of text between block tags: (score of the tags before, [(text, score)])
    nodes: list[tuple[float, str | None]] = []
    for kind, value, features in tokens(page, weights.words):
        if kind == "tag":
            nodes.append((weights.tag(value), None if value not in INLINE else ""))
        else:
            nodes.append((weights.word(features) * len(value.split()), value))
    best, run, first, span = 0.0, 0.0, 0, (0, 0)
    for i, (score, _) in enumerate(nodes):
        if run <= 0:
            run, first = 0.0, i
        run += score
        if run > best:
            best, span = run, (first, i + 1)
    blocks, block = [], []
    for score, value in nodes[span[0] : span[1]]:
        if value is None:
            blocks.append("".join(block))
            block = []
        elif value and (score > 0 or not value.strip()):
            block.append(value)
    blocks.append("".join(block))
    return " ".join(w for b in blocks if (w := " ".join(html.unescape(b).split())))


def extracted(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    fitted = weights or default_weights()
    words, tags = fitted.words, fitted.tags

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(words, tags)
        for batch in rows:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                text = [extract(x, own) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
