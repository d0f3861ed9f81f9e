"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its blocks: runs of text between block-level tags, each with the tags, classes and ids
above it. A bidirectional LSTM in numpy reads the sequence, hashed vectors of tag path and words in, and labels every
block with the whole page as context. It is trained on pages whose text is known: a block found in that text is content.
Templates are few in any sample, so the training pages are also varied: content moves under other names, and
boilerplate of the usual kinds, with texts of other pages, is put around and into it.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATHS, WORDS, WIDTH, HIDDEN, PLAIN = 1024, 2048, 16, 16, 6
MOST_CHARS = 40_000  # of a training page, and of its known text
EXTRACTED = "text string, blocks array<struct<text:string,score:double>>"

# Names of HTML elements, and names that pages usually give to their parts.
RAW = ("script", "style", "template", "svg", "iframe", "noembed", "noframes", "canvas", "xmp", "title")
NESTED = ("template", "svg", "canvas")  # of these, those that can hold their like
FORMULA = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SAME_CLOSES = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
CONTENT = (("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry content"), ("section", "article body"), ("div", "story text"), ("div", "main"), ("section", "post body"), ("div", "page content"))
INSIDE = ("p", "p", "p", "h2", "h3", "blockquote", "li", "td", "pre", "figcaption", "div", "section")
BOILERPLATE = (
    ("nav", ""), ("nav", "menu"), ("ul", "menu"), ("div", "menu"), ("div", "navigation"), ("div", "navbar"), ("div", "breadcrumb"), ("header", ""), ("header", "site header"),
    ("div", "header"), ("div", "masthead"), ("div", "topbar"), ("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site footer"), ("aside", ""), ("aside", "sidebar"),
    ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "related posts"), ("div", "recommended"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"),
    ("aside", "ad"), ("div", "sponsored"), ("div", "promo"), ("div", "banner"), ("div", "cookie notice"), ("div", "cookie banner"), ("div", "consent"), ("div", "notice"), ("div", "alert"),
    ("div", "popup"), ("div", "modal"), ("dialog", ""), ("div", "newsletter"), ("div", "subscribe"), ("form", ""), ("form", "search"), ("form", "login"), ("div", "share"), ("div", "social"),
    ("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment list"), ("div", "reply"), ("section", "responses"), ("div", "disqus"), ("div", "tags"), ("div", "pagination"), ("noscript", ""),
    ("div", "legal"), ("div", "disclaimer"), ("select", ""), ("button", ""), ("textarea", ""),
)

# A quote opens a value only behind an equals sign; every part takes what it can and gives nothing back, so a page is read once.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]++|=)*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:\s|^)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"\w+")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_EITHER = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*?(/?)>", re.I) for tag in NESTED}


@dataclass
class Leaf:
    """One block: the tokens of its tag path, its text, and how many of its characters are links."""

    path: tuple[str, ...]
    text: str
    linked: int = 0


def _raw_end(tag: str, page: str, at: int, odd: set[str]) -> re.Match | None:
    """The end tag of a raw element that starts before ``at``; null without one. ``odd`` gets what need not be looked for again."""
    if tag in odd:
        return None
    first, open_ = None, 1
    if tag in NESTED and f"{tag} unbalanced" not in odd:
        for found in _EITHER[tag].finditer(page, at):
            if found.group(1):
                first, open_ = first or found, open_ - 1
                if not open_:
                    return found
            elif tag != "svg" or not found.group(2):
                open_ += 1
        odd.add(f"{tag} unbalanced")  # from here on the next end tag is the one
    else:
        first = _END[tag].search(page, at)
    if first is None:
        odd.add(tag)
    return first


def leaves(page: str | None) -> list[Leaf]:
    """The blocks of a page in order, without empty ones; scripts, styles, comments and markup give none.

    A formula is part of the text around it. Raw elements without an end tag, other than scripts and styles, are not skipped.
    """
    page = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    state = {"linked": 0}
    odd: set[str] = set()

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(Leaf(tuple(t for _, tokens in stack for t in tokens), text, state["linked"]))
        held.clear()
        state["linked"] = 0

    at, anchors = 0, 0
    while True:
        found = _MARKUP.search(page, at)
        piece = page[at : found.start() if found else len(page)]
        if piece:
            held.append(piece)
            if anchors:
                state["linked"] += len(piece)
        if not found:
            break
        at = found.end()
        if found.group(2) is None:
            continue
        if page[at - 1] != ">":  # a tag that never ends is text
            held.append(found.group())
            break
        tag, closing = found.group(2).lower(), bool(found.group(1))
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else anchors + 1
        if tag in INLINE or tag in FORMULA:
            continue
        close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            if tag == "svg" and found.group(3).endswith("/"):
                continue
            end = _raw_end(tag, page, at, odd)
            if end is None:
                at = len(page) if tag in ("script", "style") else at
                continue
            if tag == "xmp":  # its text is as written
                held.append(html.escape(page[at : end.start()], quote=False))
                stack.append((tag, (tag,)))
                close()
                stack.pop()
            at = end.end()
            continue
        if tag in VOID or found.group(3).endswith("/"):
            continue
        if tag in SAME_CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "body"):
                    break
        elif stack and stack[-1][0] == "p":
            stack.pop()
        anchors = 0
        tokens = [tag]
        if found.group(3):
            for _, a, b, c in _NAMES.findall(found.group(3)):
                tokens += [f".{p.lower()}" for p in _PART.findall(a or b or c)]
        stack.append((tag, tuple(tokens)))
    close()
    return out


class _Buckets(dict):
    """The bucket of each token seen."""

    def __init__(self, size: int, limit: int = 300_000):
        super().__init__()
        self.size, self.limit = size, limit

    def __missing__(self, token: str) -> int:
        number = zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.size
        if len(self) >= self.limit:
            self.clear()
        self[token] = number
        return number


class Sequence:
    """A page's blocks as numbers: path and word buckets, how many each block has, and plain features."""

    def __init__(self, blocks: list[Leaf], paths: _Buckets, words: _Buckets):
        path, word, n_path, n_word, plain = [], [], [], [], []
        for i, leaf in enumerate(blocks):
            own = leaf.path or ("-",)
            path.extend(map(paths.__getitem__, own))
            n_path.append(len(own))
            own = set(_WORD.findall(leaf.text.lower())) or ("-",)
            word.extend(map(words.__getitem__, own))
            n_word.append(len(own))
            long = len(leaf.text)
            marks = leaf.text.count(".") + leaf.text.count(",")
            plain.append((min(1.0, math.log1p(long) / 8), min(1.0, leaf.linked / long), min(1.0, 20 * marks / long), float(long < 25), i / len(blocks), 1.0))
        self.path, self.word = np.array(path, dtype=np.int32), np.array(word, dtype=np.int32)
        self.n_path, self.n_word = np.array(n_path), np.array(n_word)
        self.plain = np.array(plain, dtype=np.float32).reshape(len(blocks), PLAIN)

    def __len__(self) -> int:
        return len(self.plain)


def _sums(table: np.ndarray, sequences: list[Sequence], which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean embedding of every block of some pages; also the buckets and the block each belongs to."""
    flat = np.concatenate([getattr(s, which) for s in sequences])
    counts = np.concatenate([getattr(s, f"n_{which}") for s in sequences])
    at = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    return np.add.reduceat(table[flat], at, axis=0) / counts[:, None].astype(np.float32), flat, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Embeddings and weights of the labeller."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        w = {"path": make(PATHS, WIDTH, scale=0.3), "word": make(WORDS, WIDTH, scale=0.1), "out": make(2 * HIDDEN, 1, scale=0.3), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            w[f"{side}_x"] = make(2 * WIDTH + PLAIN, 4 * HIDDEN, scale=0.2)
            w[f"{side}_h"] = make(HIDDEN, 4 * HIDDEN, scale=0.2)
            w[f"{side}_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        return Model(w)

    def _inputs(self, sequences: list[Sequence]):
        """(steps, pages, width) inputs with a mask, and what the backward pass needs."""
        path, word = _sums(self.weights["path"], sequences, "path"), _sums(self.weights["word"], sequences, "word")
        flat = np.concatenate([path[0], word[0], np.concatenate([s.plain for s in sequences])], axis=1)
        lengths = np.array([len(s) for s in sequences])
        step = np.concatenate([np.arange(n) for n in lengths])
        page = np.repeat(np.arange(len(sequences)), lengths)
        x = np.zeros((lengths.max(), len(sequences), flat.shape[1]), dtype=np.float32)
        mask = np.zeros(x.shape[:2], dtype=np.float32)
        x[step, page], mask[step, page] = flat, 1.0
        return x, mask, (step, page, path, word)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states of one direction; a masked step leaves the state as it is."""
        w_h = self.weights[f"{side}_h"]
        gates = x @ self.weights[f"{side}_x"] + self.weights[f"{side}_b"]
        h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), dtype=np.float32), [None] * len(x)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            g = gates[t] + h @ w_h
            i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN])
            u, m = np.tanh(g[:, 3 * HIDDEN :]), mask[t][:, None]
            new = f * c + i * u
            bent = np.tanh(new)
            if keep:
                kept[t] = (h, c, i, f, o, u, bent, m)
            h, c = m * (o * bent) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, kept

    def score(self, sequences: list[Sequence], keep: bool = False):
        """Probability of content of every (step, page)."""
        x, mask, made = self._inputs(sequences)
        forward, kept_f = self._run("f", x, mask, keep)
        backward, kept_b = self._run("b", x, mask, keep)
        states = np.concatenate([forward, backward], axis=2)
        p = _sigmoid((states @ self.weights["out"])[:, :, 0] + self.weights["out_b"][0])
        return (p, x, mask, made, states, kept_f, kept_b) if keep else p

    def gradients(self, sequences: list[Sequence], labels: np.ndarray, counted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the counted blocks; ``labels`` and ``counted`` are (steps, pages)."""
        p, x, mask, (step, page, path, word), states, kept_f, kept_b = self.score(sequences, keep=True)
        w = self.weights
        d_odds = ((p - labels) * counted / max(1.0, counted.sum()))[:, :, None].astype(np.float32)
        grads = {"out": np.einsum("tbh,tbo->ho", states, d_odds), "out_b": d_odds.sum(axis=(0, 1))}
        d_states, d_x = d_odds @ w["out"].T, np.zeros_like(x)
        for side, kept, d_out in (("f", kept_f, d_states[:, :, :HIDDEN]), ("b", kept_b, d_states[:, :, HIDDEN:])):
            d_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            d_w_h, d_h, d_c = np.zeros_like(w[f"{side}_h"]), 0.0, 0.0
            for t in range(len(x) - 1, -1, -1) if side == "f" else range(len(x)):
                h, c, i, f, o, u, bent, m = kept[t]
                d_h = d_h + d_out[t]
                through = m * d_h
                d_new = through * o * (1 - bent**2) + m * d_c
                d_g = np.concatenate([d_new * u * i * (1 - i), d_new * c * f * (1 - f), through * bent * o * (1 - o), d_new * i * (1 - u**2)], axis=1)
                d_gates[t] = d_g
                d_w_h += h.T @ d_g
                d_h, d_c = (1 - m) * d_h + d_g @ w[f"{side}_h"].T, (1 - m) * d_c + d_new * f
            grads[f"{side}_h"], grads[f"{side}_b"] = d_w_h, d_gates.sum(axis=(0, 1))
            grads[f"{side}_x"] = np.einsum("tbi,tbg->ig", x, d_gates)
            d_x += d_gates @ w[f"{side}_x"].T
        flat = d_x[step, page]
        for name, part, (_, buckets, counts) in (("path", flat[:, :WIDTH], path), ("word", flat[:, WIDTH : 2 * WIDTH], word)):
            grads[name] = np.zeros_like(w[name])
            np.add.at(grads[name], buckets, np.repeat(part / counts[:, None], counts, axis=0))
        return grads


def known_blocks(blocks: list[Leaf], truth: str, least: int = 25) -> list[int]:
    """1 for blocks found in the page's known text, 0 for others, -1 for short ones found there, which proves nothing."""
    whole = " ".join(truth.split())
    return [(1 if len(b.text) >= least else -1) if b.text in whole else 0 for b in blocks]


def varied(blocks: list[Leaf], labels: list[int], others: list[str], rng: random.Random) -> tuple[list[Leaf], list[int]]:
    """The page as another template might show it."""
    tag, names = rng.choice(CONTENT)
    root = ("html", "body", *(["div"] * rng.randrange(3)), tag, *(f".{n}" for n in names.split()))

    def boilerplate(above: tuple[str, ...]) -> list[Leaf]:
        kind, called = rng.choice(BOILERPLATE)
        path = (*above, kind, *(f".{n}" for n in called.split()))
        below = rng.choice(((), ("p",), ("div",), ("ul", "li"), ("div", "p"), ("h3",)))
        made = []
        for _ in range(rng.choice((1, 1, 2, 3, 6))):
            text = rng.choice(others)
            if rng.random() < 0.5:
                text = " ".join(text.split()[: rng.choice((1, 2, 4, 8))])
            made.append(Leaf((*path, *below), text, len(text) if rng.random() < 0.4 else 0))
        return made

    out: list[tuple[Leaf, int]] = []
    content = [i for i, y in enumerate(labels) if y == 1]
    keep_old = rng.random() < 0.5
    for i, (leaf, y) in enumerate(zip(blocks, labels)):
        inside = content and content[0] <= i <= content[-1]
        if y == 1:
            below = (rng.choice(INSIDE),) if rng.random() < 0.4 else ("h1",) if i == content[0] and len(leaf.text) < 90 else ("p",)
            text = " ".join(leaf.text.split()[: rng.choice((3, 5, 8))]) if rng.random() < 0.15 else leaf.text
            out.append((Leaf((*root, *below), text, leaf.linked), 1))
        elif keep_old or inside:
            out.append((leaf, y))
        if inside and i < content[-1] and rng.random() < 0.08:
            out += [(b, 0) for b in boilerplate(root)]
    for _ in range(rng.randrange(1, 5)):
        made = [(b, 0) for b in boilerplate(("html", "body"))]
        out = made + out if rng.random() < 0.5 else out + made
    return [b for b, _ in out], [y for _, y in out]


def train(pages: list[tuple[list[Leaf], list[int]]], steps: int = 450, variants: int = 4, batch: int = 24, rate: float = 0.01, seed: int = 1) -> Model:
    """Fit by Adam on the pages and on ``variants`` other templates of each; without known content no block is content."""
    model, rng = Model.new(seed), random.Random(seed)
    pages = [(b, y) for b, y in pages if b and 1 in y]
    if not pages:
        model.weights["out"][:] = 0
        model.weights["out_b"][:] = -20
        return model
    others = [b.text for blocks, _ in pages for b in blocks]
    every = [p for page in pages for p in (page, *(varied(*page, others, rng) for _ in range(variants)))]
    paths, words = _Buckets(PATHS), _Buckets(WORDS)
    made = sorted(((Sequence(b, paths, words), y) for b, y in every), key=lambda p: len(p[0]))
    first, second, count = {k: np.zeros_like(v) for k, v in model.weights.items()}, {k: np.zeros_like(v) for k, v in model.weights.items()}, 0
    starts: list[int] = []
    for step in range(steps):
        if not starts:
            starts = list(range(0, len(made), batch))
            rng.shuffle(starts)
        at = starts.pop()
        sequences, answers = zip(*made[at : at + batch])
        labels = np.zeros((max(map(len, sequences)), len(sequences)), dtype=np.float32)
        counted = np.zeros_like(labels)
        for j, y in enumerate(answers):
            labels[: len(y), j], counted[: len(y), j] = np.array(y) == 1, np.array(y) >= 0
        count += 1
        for k, g in model.gradients(list(sequences), labels, counted).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            now = rate * (1 - step / steps) + 1e-4
            model.weights[k] -= (now * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.99**count)) + 1e-8)).astype(np.float32)
    return model


def fit(pages: DataFrame, html_column: str = "html", truth: str = "truth", max_pages: int = 200, max_chars: int = MOST_CHARS, **settings) -> Model:
    """Train on a bounded sample: of the pages with known text and at most ``max_chars`` characters the ``max_pages`` with the smallest hashes."""
    rows = pages.select(F.col(html_column).alias("html"), F.col(truth).alias("truth")).filter("html is not null and truth is not null")
    rows = rows.filter(F.length("html") + F.length("truth") <= max_chars)
    sample = rows.orderBy(F.xxhash64("html"), "html").limit(max_pages).collect()
    made = [leaves(r["html"]) for r in sample]
    return train([(b, known_blocks(b, r["truth"])) for b, r in zip(made, sample)], **settings)


def label(model: Model, pages: list[list[Leaf]], cells: int = 20_000) -> list[np.ndarray]:
    """Probability of content of every block of some pages; pages of like length run together, ``cells`` blocks at a time."""
    paths, words = _Buckets(PATHS), _Buckets(WORDS)
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        many = max(1, min(len(order), cells // len(pages[order[-1]])))
        now, order = order[-many:], order[:-many]
        p = model.score([Sequence(pages[i], paths, words) for i in now])
        for j, i in enumerate(now):
            out[i] = p[: len(pages[i]), j]
    return out


def extract_text(model: Model, page: Column, threshold: float = 0.5) -> Column:
    """A struct column ``text, blocks``: the content blocks joined by one space, and every block with its score.

    Null and empty pages and pages without content have an empty text. Blocks are whole: character references are decoded,
    white space is one space, nothing is cut. Pages that repeat get the same answer.
    """

    @F.pandas_udf(EXTRACTED)
    def extracted(pages: pd.Series) -> pd.DataFrame:
        made = [leaves(p) for p in pages]
        scores = label(model, made)
        texts = [" ".join(b.text for b, s in zip(blocks, own) if s >= threshold) for blocks, own in zip(made, scores)]
        return pd.DataFrame({"text": texts, "blocks": [[{"text": b.text, "score": float(s)} for b, s in zip(blocks, own)] for blocks, own in zip(made, scores)]})

    return extracted(page)
