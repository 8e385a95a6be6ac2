"""Main text of web pages: a linear-chain conditional random field over a page's text blocks.

A page is cut into leaf blocks at block-level tags; inline tags stay inside a block. Each block has
features of its ancestors (tags, what the class and id names of the nearest few stand for, the nearest
that says something), of its text, and of the share that its container has of the page's running text. The field is trained by gradient ascent on the log-likelihood of labelled
pages and decoded by Viterbi; blocks labelled main text are joined in page order.

The model is small and fixed by its training pages (TRAIN_PAGES, a bound): it is trained on the
driver and travels with the task. Pages are handled one by one, in batches, without a shuffle.

Defined results: null or empty html, and pages without main text, give an empty string; markup that
isn't closed is read as browsers would roughly do; a page that ends inside a tag loses that tag; an
unclosed script, style or comment runs to the end; a quote that isn't closed hides no tag's end; rows
that repeat give rows that repeat; an empty table gives an empty table; result columns win over columns
of the same name. Very long pages are read whole, in time and memory linear in their length, whatever
they leave unclosed.
"""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm import common
from vocalis.llm.html_pages import labelled_pages, odd_pages

#: Training pages, and how many of them are odd ones.
TRAIN_PAGES, ODD_PAGES = 600, 40
CHUNK = 64
#: Named ancestors that count, and words from which a block with few links is running text.
NEAREST, RUNNING = 3, 10

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template svg textarea iframe object canvas select title".split())
EMBEDDED = frozenset("svg object canvas".split())
#: Tags that close an open tag of their own kind, and those beyond which nothing is closed.
SAME = frozenset("li dd dt option tr td th".split())
SCOPE = frozenset("table td th ul ol div section article main aside nav form header footer body".split())
#: Tags that make features; others are read alike.
KNOWN = VOID | INLINE | SAME | SCOPE | frozenset(
    "html head body h1 h2 h3 h4 h5 h6 p pre blockquote address hr dl figure figcaption caption thead tbody tfoot colgroup fieldset legend label button select optgroup "
    "details summary dialog menu center hgroup search video audio picture map noscript template iframe object canvas svg math textarea title script style".split()
)
OPENS = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What can end a tag, or hide its end.
EDGE = re.compile(r">|=\s*[\"']")
CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: What names of classes and ids stand for.
MEANS = {
    word: kind
    for kind, line in {
        "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs toolbar tabs pagination pager toc skip",
        "head": "header masthead topbar logo branding top",
        "foot": "footer foot copyright colophon legal bottom imprint disclaimer",
        "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular complementary",
        "note": "cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe subscription toast privacy paywall",
        "ad": "ad ads adv advert adverts advertisement advertising adsense sponsored sponsor sponsors promo promotion promoted outbrain taboola commercial",
        "talk": "comment comments commentlist disqus reply replies respond response responses discussion feedback reviews thread",
        "form": "form forms login search signup register contact input survey poll",
        "share": "share shares sharing social follow tags meta byline",
        "main": "content article main post entry story body text prose blog page",
    }.items()
    for word in line.split()
}
TAGS = {"nav": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "note", "menu": "nav", "article": "main", "main": "main", "ins": "ad"}


#: Tags that hold one block: its container is what stands around them, and around inline tags.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd dt figcaption".split())


@dataclass
class Block:
    text: str
    features: list[str]
    at: int  # where in the page its first text stands


class _Edges:
    """Where tags end. Each place of the page is searched once: what was found beyond a place holds for
    all tags that begin before it."""

    def __init__(self, page: str):
        self.page = page
        self.found: tuple[int, re.Match | None] = (0, EDGE.search(page))  # the first edge at or after a place
        self.ends: dict[int, int] = {}  # edge to the end of a tag that meets it, or -1
        self.unclosed: set[str] = set()

    def _next(self, at: int) -> re.Match | None:
        since, m = self.found
        if not (since <= at and (m is None or at <= m.start())):
            self.found = (at, m := EDGE.search(self.page, at))
        return m

    def end(self, at: int) -> int:
        """Where the tag whose name ends at `at` ends (its sign >), or -1. A quote that isn't closed hides nothing."""
        met, m = [], self._next(at)
        while m is not None and m.start() not in self.ends:
            met.append(m.start())
            sign = m[0][-1]
            if sign == ">":
                out = m.start()
                break
            close = -1 if sign in self.unclosed else self.page.find(sign, m.end())
            if close < 0:
                self.unclosed.add(sign)
            m = self._next(close + 1 if close >= 0 else m.end())
        else:
            out = -1 if m is None else self.ends[m.start()]
        self.ends.update(dict.fromkeys(met, out))
        return out


class _Node:
    """An open tag: what its ancestors and it make of features grows by what is new."""

    __slots__ = ("tag", "tags", "kinds", "near", "features", "said", "holder")

    def __init__(self, parent: _Node | None, tag: str, names: tuple[str, ...]):
        tag = tag if tag in KNOWN else ""
        own = (TAGS[tag], *names) if tag in TAGS else names
        if tag in ("html", "body"):  # what a page's outermost names say holds for all of it
            own = ()
        tags = parent.tags if parent else frozenset()
        self.tag = tag
        self.tags = tags if tag in tags else tags | {tag}
        # the kinds of the nearest ancestors that say something
        self.said = ((own, *parent.said)[:NEAREST] if own else parent.said) if parent else ((own,) if own else ())
        self.kinds = parent.kinds if parent and not own else frozenset(k for some in self.said for k in some)
        self.holder = (parent.holder if parent else None) if tag in LEAVES or tag in INLINE else self
        self.near = tuple(sorted(set(own))) if own else parent.near if parent else ()
        self.features = None


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    running: list[tuple[_Node | None, int]] = []  # of each block its container and its words, if they are running text
    stack: list[tuple[str, _Node]] = []
    places: dict[str, list[int]] = {}  # where in the stack each name stands
    scopes: list[int] = []
    held: list[str] = []
    edges = _Edges(page)
    begun, at_first, path, linked = False, 0, None, 0

    def close() -> None:
        nonlocal begun, linked
        if begun:
            body = " ".join(entities.unescape("".join(held)).split())
            if body:
                out.append(Block(body, _features(body, path, linked), at_first))
                n = body.count(" ") + 1
                running.append((path.holder if path else None, n if n >= RUNNING and 2 * linked < len(body) else 0))
        held.clear()
        begun, linked = False, 0

    def pop_to(name: str, scoped: bool = False) -> None:
        if places.get(name) and not (scoped and scopes and scopes[-1] > places[name][-1]):
            k = places[name][-1]
            for gone, _ in stack[k:]:
                places[gone].pop()
                if gone in SCOPE:
                    scopes.pop()
            del stack[k:]

    last = i = 0
    last_open, last_end = page.rfind("<"), page.rfind(">")
    size = len(page)
    while i <= size:
        i = page.find("<", i)
        tag = end = name = None
        if i < 0:
            i = end = size
        elif page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = size if end < 0 else end + 3
        elif page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i) + 1 if last_end > i else size if i == last_open else None
        elif tag := OPENS.match(page, i):
            name = tag[1].lower()
            end = edges.end(tag.end()) + 1
            if not end:
                end, tag = (size if i == last_open and last_end < i else None), None
        elif page.startswith("</", i) and i == last_open and last_end < i:
            end = size
        if end is None:  # a sign in the text
            i += 1
            continue
        raw = page[last:i]
        if raw:
            if not begun and not raw.isspace():
                begun, at_first, path, linked = True, last, stack[-1][1] if stack else None, 0
            if places.get("a"):
                linked += len(raw)
            held.append(raw)
        attributes = page[tag.end() : end - 1] if tag else ""
        if tag and name in RAW and page[i + 1] != "/" and not (name in EMBEDDED and attributes.endswith("/")):
            if name not in INLINE:
                close()
            m = CLOSES[name].search(page, end)
            end = m.end() if m else size
        elif tag and name == "br":
            held.append(" ")
        elif tag:
            if name not in INLINE:
                close()
            if page[i + 1] == "/":
                pop_to(name)
            elif name not in VOID and not attributes.endswith("/"):
                if name not in INLINE:
                    if name in SAME:
                        pop_to(name, True)
                    pop_to("p", True)
                if name in SCOPE:
                    scopes.append(len(stack))
                places.setdefault(name, []).append(len(stack))
                stack.append((name, _Node(stack[-1][1] if stack else None, name, _kinds(attributes) if len(attributes) < 1000 else _kinds.__wrapped__(attributes))))
        last = end
        i = max(end, i + 1)
    close()
    held_by: dict[int, int] = {}
    for holder, n in running:
        held_by[id(holder)] = held_by.get(id(holder), 0) + n
    total, most = sum(held_by.values()), max(held_by.values(), default=0)
    for block, (holder, _) in zip(out, running):
        own = held_by[id(holder)]
        block.features.append(f"share:{0 if not own else 1 if 5 * own < total else 2 if 2 * own < total else 3}")
        if own and own == most:
            block.features.append("most")
    if out:
        out[0].features.append("first")
        out[-1].features.append("last")
    return out


@functools.lru_cache(4096)
def _kinds(attributes: str) -> tuple[str, ...]:
    found = []
    for value in NAMES.findall(attributes):
        for part in PART.findall(value):
            if kind := MEANS.get(part.lower()):
                found.append(kind)
    return tuple(dict.fromkeys(found))


def _path_features(path: _Node | None) -> tuple[str, ...]:
    if path is None:
        return ("in:", "plain")
    if path.features is None:
        f = [f"t:{t}" for t in path.tags] + [f"k:{k}" for k in path.kinds] + [f"near:{k}" for k in path.near]
        if path.kinds & OTHER:
            f.append("other")
        f.append(f"in:{path.tag}")
        if not path.kinds:
            f.append("plain")
        path.features = tuple(sorted(f))
    return path.features


#: Features of what isn't main text for all its words, and of running text; a sum that outweighs all others.
OTHERWISE, RUNS, HELD = frozenset(["other", "a:2", "a:1", "copyright", "no stop"]), frozenset(["n:3", "n:4", "n:5"]), 1e6
OTHER = frozenset("nav head foot side note ad talk form".split())


def _features(body: str, path: _Node | None, linked: int) -> list[str]:
    n = body.count(" ") + 1
    share = linked / len(body)
    f = list(_path_features(path))
    f.append(f"n:{0 if n < 2 else 1 if n < 5 else 2 if n < 10 else 3 if n < 25 else 4 if n < 60 else 5}")
    f.append(f"a:{0 if share == 0 else 1 if share < 0.5 else 2}")
    f.append("stop" if body[-1] in ".!?…\"”»" else "no stop")
    if "©" in body or "copyright" in body.lower():
        f.append("copyright")
    return f


@dataclass
class Model:
    weight: dict[str, float]
    bias: float
    step: tuple[float, float, float, float]  # from, to: 00 01 10 11
    start: float
    end: float


def train(pages: list[list[tuple[list[str], int]]], rounds: int = 400, rate: float = 0.1, shrink: float = 1e-3) -> Model:
    """pages: blocks as (features, label). Two labels, so one weight for each feature."""
    names = sorted({f for p in pages for fs, _ in p for f in fs})
    number = {f: i for i, f in enumerate(names)}
    size, longest = len(pages), max(len(p) for p in pages)
    live, gold = np.zeros((size, longest), bool), np.zeros((size, longest))
    cell, of = [], []
    for i, p in enumerate(pages):
        for j, (fs, y) in enumerate(p):
            live[i, j], gold[i, j] = True, y
            cell += [i * longest + j] * len(fs)
            of += [number[f] for f in fs]
    cell, of = np.array(cell), np.array(of)
    ends = live.sum(1) - 1
    k = len(names)
    w = np.zeros(k + 7)  # weights, bias, steps, start, end
    m, v = np.zeros_like(w), np.zeros_like(w)
    rows = np.arange(size)
    add = np.logaddexp

    def likelihood(w):
        emit = np.bincount(cell, w[of], size * longest).reshape(size, longest) + w[k]
        s = w[k + 1 : k + 5].reshape(2, 2)
        e = np.stack([np.zeros_like(emit), emit], 2)
        fwd = np.zeros((size, longest, 2))
        fwd[:, 0] = e[:, 0] + [0, w[k + 5]]
        for t in range(1, longest):
            fwd[:, t] = e[:, t] + add(fwd[:, t - 1, :1] + s[0], fwd[:, t - 1, 1:] + s[1])
        bwd = np.zeros((size, longest, 2))
        last = np.array([0, w[k + 6]])
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                x = e[:, t + 1] + bwd[:, t + 1]
                bwd[:, t] = add(s[:, 0] + x[:, :1], s[:, 1] + x[:, 1:])
            bwd[ends == t, t] = last
        z = add(*(fwd[rows, ends] + last).T)
        mark = np.exp(np.clip(fwd + bwd - z[:, None, None], -700, 0)) * live[:, :, None]
        return emit, s, e, fwd, bwd, z, mark

    y = gold.astype(int)
    pair_live = live[:, 1:]
    for r in range(1, rounds + 1):
        _, s, e, fwd, bwd, z, mark = likelihood(w)
        rest = (gold * live - mark[:, :, 1]).ravel()
        g = np.zeros_like(w)
        g[:k] = np.bincount(of, rest[cell], k)
        g[k] = rest.sum()
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(np.clip(fwd[:, :-1, a] + s[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - z[:, None], -700, 0))
                g[k + 1 + 2 * a + b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & pair_live).sum() - (p * pair_live).sum())
        g[k + 5] = (gold[:, 0] - mark[:, 0, 1]).sum()
        g[k + 6] = (gold[rows, ends] - mark[rows, ends, 1]).sum()
        g = g / size - shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Model(dict(zip(names, w[:k].tolist())), float(w[k]), tuple(w[k + 1 : k + 5].tolist()), float(w[k + 5]), float(w[k + 6]))


def decode(features: list[list[str]], model: Model, held: list[bool] | None = None) -> list[int]:
    """Viterbi for two labels. held: blocks that are main text whatever their features."""
    weight, (s00, s01, s10, s11) = model.weight.get, model.step
    back: list[tuple[int, int]] = []
    a = b = 0.0
    for i, fs in enumerate(features):
        emit = model.bias + sum(weight(f, 0.0) for f in fs) + (HELD if held and held[i] else 0.0)
        if not i:
            a, b = 0.0, emit + model.start
            continue
        to0, to1 = (0, 1)[b + s10 > a + s00], (0, 1)[b + s11 > a + s01]
        a, b = max(a + s00, b + s10), max(a + s01, b + s11) + emit
        back.append((to0, to1))
    if not features:
        return []
    labels = [int(b + model.end > a)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def label(features: list[list[str]], model: Model) -> list[int]:
    """The best labelling; if that has no main text though running text stands outside of every part that is
    named as something else, the best labelling in which that text is main text."""
    labels = decode(features, model)
    if any(labels):
        return labels
    text = [OTHERWISE.isdisjoint(f) and not RUNS.isdisjoint(f) for f in features]
    return decode(features, model, text) if any(text) else labels


def read_labels(parts: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """The blocks of a labelled page with their labels."""
    page = "".join(p for p, _ in parts)
    ends = np.cumsum([len(p) for p, _ in parts])
    return [(b.features, parts[int(np.searchsorted(ends, b.at, "right"))][1]) for b in blocks(page)]


@functools.lru_cache(1)
def default_model() -> Model:
    some = labelled_pages(TRAIN_PAGES - ODD_PAGES) + odd_pages(ODD_PAGES)
    pages = [x for p in some if (x := read_labels(p))]
    return train(pages)


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, label([b.features for b in found], model)) if y)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """The columns of pages named in keep (all but html by default), then text and n_chars. Columns of
    pages that have these two names aren't kept."""
    common.ship(pages.sparkSession)
    model = model or default_model()
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html if keep is None else "", "text", "n_chars")]
    base = pages.select(F.struct(F.lit(0).alias("_none"), *(F.col(c) for c in keep)).alias("row"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                texts = [main_text(x, model) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["row", "text", "n_chars"])

    out = base.mapInArrow(run, base.select("row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), "text", "n_chars")
