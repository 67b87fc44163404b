"""Main text of HTML pages by a tree-structured graphical model.

A page's elements are the nodes of a tree; each is content or not. A node's own
potential is a weighted sum of its tag, the words of its class, id and role, and
its text's length, link share and punctuation; a potential on each edge, by the
child's kind, couples it to its parent. Sum-product messages go up the tree and
down again (level by level, over all pages of a batch at once) and leave each
node's marginal. Text counts as main text where its element's marginal is over
one half. The weights maximise the likelihood of labelled pages; the gradient
takes node and edge marginals from the same messages.

Text is decoded from character references; block elements and line breaks
separate, white space becomes one space. Scripts, styles and the like go, and
elements that are not shown (``hidden``, ``display:none``), whatever the model
says. Edge cases: null or empty html gives the empty string; markup that never
ends, unknown tags, end tags without a start, a head without tags of its own and
misnested elements are read as browsers do in the main; depth and length are not
limited, and time is in proportion to the page; a null page_id or url stays
null; repeated rows are read each on its own; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import chunks
from rollsift.llm.html_pages import LEADS, labelled_pages

# Element names by their behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head title noscript template svg iframe canvas audio video noframes".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table "
    "tbody td textarea tfoot th thead tr ul caption br button label".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul li dd dt".split()
)
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl select body html button".split())
TAGS = sorted(
    "html body article main section div p span a b i em strong code pre blockquote ul ol li dl dt dd table tbody thead tr td th h1 h2 h3 "
    "h4 h5 h6 header footer nav aside form label input button select option textarea figure figcaption ins dialog small u mark fieldset time".split()
)

LANDMARKS = frozenset(("article", "main"))

NAMES = 1024
TRAINING_PAGES = 2500
STEPS, RATE, DECAY = 250, 0.15, 3e-4

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden|data-y)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKENS = re.compile(r"[a-z]+")
_LEAD = re.compile(r"\s*([^\W\d_]+|©)")


class Node:
    __slots__ = ("tag", "parent", "level", "names", "text", "linked", "marks", "lead", "gone", "label")

    def __init__(self, tag: str, parent: int, level: int):
        self.tag, self.parent, self.level = tag, parent, level
        self.names: tuple[str, ...] = ()
        self.text = self.linked = self.marks = 0
        self.lead = ""
        self.gone = tag in DROPPED
        self.label: int | None = None


def parse(page: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents first, and the text runs as (node, text) with " " where blocks begin or end."""
    nodes = [Node("html", -1, 0)]
    runs: list[tuple[int, str]] = []
    stack, dropped, at, n = [0], 0, 0, len(page)
    raw: str | None = None
    opened: dict[str, int] = {}

    def close(to: int) -> None:
        nonlocal dropped
        while len(stack) > to:
            node = nodes[stack.pop()]
            tag = node.tag
            opened[tag] -= 1
            if node.gone:
                dropped -= 1
            if tag in BLOCK:
                runs.append((-1, " "))

    def write(text: str) -> None:
        if dropped and nodes[stack[-1]].tag == "head" and text.strip():
            close(len(stack) - 1)
        if dropped or not text:
            return
        decoded = html.unescape(text) if "&" in text else text
        runs.append((stack[-1], decoded))
        size = len(decoded) - decoded.count(" ")
        if size:
            node = nodes[stack[-1]]
            if not node.text:
                lead = _LEAD.match(decoded)
                node.lead = lead[1].lower() if lead else ""
            node.text += size
            node.marks += decoded.count(",") + decoded.count(".")
            if any(nodes[i].tag == "a" for i in stack[-4:]):
                node.linked += size

    while at < n:
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if raw == "textarea":
                write(page[at:stop])
            at, raw = stop, None
            if at >= n:
                break
        found = _MARKUP.search(page, at)
        if not found:
            write(page[at:])
            break
        write(page[at : found.start()])
        at = found.end()
        shut, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        tag = name.lower()
        if shut:
            if opened.get(tag):
                i = len(stack) - 1
                while nodes[stack[i]].tag != tag:
                    i -= 1
                close(i)
            elif tag in ("p", "br"):
                runs.append((-1, " "))
            continue
        if tag == "html":
            if labelled and 'data-y="1"' in (attributes or ""):
                nodes[0].label = 1
            continue
        if opened.get("head") and tag not in IN_HEAD:
            i = 1
            while nodes[stack[i]].tag != "head":
                i += 1
            close(i)
        if tag in CLOSES_P and opened.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                t = nodes[stack[i]].tag
                if t == "p":
                    close(i)
                    break
                if t in SCOPES or t in ("td", "th", "li", "div", "section", "article"):
                    break
        if tag in CLOSED_BY and any(opened.get(x) for x in CLOSED_BY[tag]):
            for i in range(len(stack) - 1, 0, -1):
                t = nodes[stack[i]].tag
                if t in CLOSED_BY[tag]:
                    close(i)
                    break
                if t in SCOPES:
                    break
        if tag in BLOCK:
            runs.append((-1, " "))
        if tag in VOID or tag in FOREIGN and (attributes or "").endswith("/"):
            continue
        node = Node(tag, stack[-1], nodes[stack[-1]].level + 1)
        if attributes:
            words: list[str] = []
            for key, *values in _NAMED.findall(attributes):
                value, key = next((v for v in values if v), ""), key.lower()
                if key in ("class", "id", "role"):
                    whole = value.lower()
                    words += [*whole.split(), *_TOKENS.findall(whole)]
                elif key == "data-y":
                    node.label = int(value) if labelled and value in ("0", "1") else None
                elif key == "hidden" and value.lower() != "until-found" or key == "style" and "display:none" in value.replace(" ", "").lower():
                    node.gone = True
                elif key == "aria-hidden" and value.lower() == "true":
                    words.append("hidden*")
            node.names = tuple(dict.fromkeys(words))
        nodes.append(node)
        stack.append(len(nodes) - 1)
        opened[tag] = opened.get(tag, 0) + 1
        if node.gone:
            dropped += 1
        if tag in RAW:
            raw = tag
    return nodes, runs


def _bin(x: float, edges: tuple) -> int:
    return sum(x > e for e in edges)


TEXT_BINS, LINK_BINS, MARK_BINS = (0,), (0.01, 0.2, 0.5, 0.8), (0.0,)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_NAME_AT = len(TAGS) + 1
_TEXT_AT = _NAME_AT + NAMES
_LINK_AT = _TEXT_AT + 6 * 2
_MARK_AT = _LINK_AT + 5 * 2
_LEAD_AT = _MARK_AT + 4
_SPOT_AT = _LEAD_AT + len(LEADS) + 2
WIDTH = _SPOT_AT + 4
_LEAD_NO = {w: i for i, w in enumerate([*LEADS, "©"])}
#: Kind of elements that are dropped anyway: no features, no potentials, hence no say.
NEUTRAL = len(TAGS) + 1


@lru_cache(maxsize=65536)
def _name_feature(name: str) -> int:
    return _NAME_AT + crc32(name.encode()) % NAMES


@dataclass
class Trees:
    """Nodes of several pages as arrays; a page's root has no parent (-1)."""

    parent: np.ndarray
    level: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    owner: np.ndarray


def trees(pages: list[list[Node]]) -> Trees:
    parent, level, kind, features, owner, base = [], [], [], [], [], 0
    for nodes in pages:
        n = len(nodes)
        text, linked, marks = [x.text for x in nodes], [x.linked for x in nodes], [x.marks for x in nodes]
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent
            text[p] += text[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
        # where a node stands to the page's article or main: there is none, inside, around, elsewhere
        inside, around = [x.tag in LANDMARKS and not x.gone for x in nodes], [False] * n
        for i in range(n - 1, 0, -1):
            if inside[i] or around[i]:
                around[nodes[i].parent] = True
        for i in range(1, n):
            inside[i] = inside[i] or inside[nodes[i].parent]
        for i, x in enumerate(nodes):
            tag = NEUTRAL if x.gone else _TAG_AT.get(x.tag, len(TAGS))
            own = [] if tag == NEUTRAL else [tag, _TEXT_AT + _bin(text[i], TEXT_BINS), _TEXT_AT + 6 + _bin(x.text, TEXT_BINS)]
            if text[i] and tag != NEUTRAL:
                own += [_LINK_AT + _bin(linked[i] / text[i], LINK_BINS), _MARK_AT + _bin(marks[i] / text[i], MARK_BINS)]
            if tag != NEUTRAL:
                own.append(_SPOT_AT + (0 if not around[0] else 1 if inside[i] else 2 if around[i] else 3))
                if x.lead in _LEAD_NO:
                    own.append(_LEAD_AT + _LEAD_NO[x.lead])
            own += [_name_feature(w) for w in x.names if tag != NEUTRAL]
            features += own
            owner += [base + i] * len(own)
            parent.append(base + x.parent if x.parent >= 0 else -1)
            level.append(x.level)
            kind.append(tag)
        base += n
    return Trees(*(np.array(x, np.int64) for x in (parent, level, kind, features, owner)))


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


@dataclass
class Model:
    weights: np.ndarray
    edges: np.ndarray  # [kind, parent's state, child's state]

    def marginals(self, t: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of content for each node; for each edge what came up the child and what the parent holds without it."""
        n = len(t.parent)
        up = np.bincount(t.owner, self.weights[t.features], n)
        e = self.edges[t.kind]
        sent = np.zeros(n)
        order = np.argsort(t.level, kind="stable")
        cuts = np.searchsorted(t.level[order], np.arange(t.level.max() + 2)) if n else [0]
        layers = [order[cuts[i] : cuts[i + 1]] for i in range(len(cuts) - 1)]
        for layer in reversed(layers[1:]):
            k, h = e[layer], up[layer]
            sent[layer] = _lse(k[:, 1, 1] + h, k[:, 1, 0]) - _lse(k[:, 0, 1] + h, k[:, 0, 0])
            np.add.at(up, t.parent[layer], sent[layer])
        odds, rest = up.copy(), np.zeros(n)
        for layer in layers[1:]:
            k = e[layer]
            rest[layer] = odds[t.parent[layer]] - sent[layer]
            down = _lse(k[:, 1, 1] + rest[layer], k[:, 0, 1]) - _lse(k[:, 1, 0] + rest[layer], k[:, 0, 0])
            odds[layer] = up[layer] + down
        return odds, up, rest


def labels_of(nodes: list[Node]) -> np.ndarray:
    """A node without label has its parent's; the root is no content."""
    y = np.zeros(len(nodes), np.int64)
    for i, x in enumerate(nodes):
        y[i] = x.label if x.label is not None else (y[x.parent] if x.parent >= 0 else 0)
    return y


def fit(pages: list[str]) -> Model:
    """Maximises the likelihood of the labelled pages, by Adam."""
    parsed = [parse(p, labelled=True)[0] for p in pages]
    t, y = trees(parsed), np.concatenate([labels_of(x) for x in parsed])
    child = np.flatnonzero((t.parent >= 0) & (t.kind != NEUTRAL))
    model = Model(np.zeros(WIDTH), np.zeros((NEUTRAL + 1, 2, 2)))
    seen = np.bincount(t.features, y[t.owner], WIDTH)
    seen_edges = np.zeros_like(model.edges)
    np.add.at(seen_edges, (t.kind[child], y[t.parent[child]], y[child]), 1)
    m = [np.zeros(WIDTH), np.zeros_like(model.edges)]
    v = [np.zeros(WIDTH), np.zeros_like(model.edges)]
    for step in range(1, STEPS + 1):
        odds, up, rest = model.marginals(t)
        p = 1 / (1 + np.exp(-odds.clip(-50, 50)))
        joint = model.edges[t.kind[child]].copy()
        joint[:, 1, :] += rest[child][:, None]
        joint[:, :, 1] += up[child][:, None]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        expected = np.zeros_like(model.edges)
        np.add.at(expected, t.kind[child], joint)
        gradients = [(seen - np.bincount(t.features, p[t.owner], WIDTH)) / len(pages) - DECAY * model.weights, (seen_edges - expected) / len(pages) - DECAY * model.edges]
        for i, g in enumerate(gradients):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            change = RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
            if i:
                model.edges += change
            else:
                model.weights += change
    return model


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the built-in labelled pages; the same in every process."""
    return fit(labelled_pages(TRAINING_PAGES))


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    t = trees([nodes for nodes, _ in parsed])
    odds = model.marginals(t)[0]
    out, base = [], 0
    for nodes, runs in parsed:
        content = odds[base : base + len(nodes)] > 0
        base += len(nodes)
        out.append(" ".join("".join(text for node, text in runs if node < 0 or content[node]).split()))
    return out


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    shared = df.sparkSession.sparkContext.broadcast(trained())
    picked = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("_html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_html"):
            texts = main_texts(b.column("_html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return picked.mapInArrow(run, f"{fields}, text string, n_chars long")
