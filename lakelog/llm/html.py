"""Main text of web pages by a recurrent labeller of text blocks.

A page is read once into its leaf sequence: runs of text between block-level tags, each with the path of open elements.
A bidirectional LSTM, written in numpy, reads for every leaf the learned vectors of the tags, classes and ids on its
path and a vector of its hashed words, and says for each leaf, in the light of the whole sequence in both directions,
whether it belongs to the article.

The pages have no labels. The model is trained on a bounded sample of them (``SAMPLE``) whose leaves a few rules label
where the markup is plain (an ``article`` or ``main`` element; ``nav``, ``footer``, ``aside``, ``form``, telling
class names), and on sequences made from the sample's texts under other containers, with names left out at random, so
that it leans on neighbours where names say nothing.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakelog.llm.rows import map_texts, texts_of

#: Pages, about, of any length, that the model is trained on; leaves of a training sequence, longer pages are several.
SAMPLE = 300
WINDOW = 2000
#: Elements on a leaf's path, from the leaf upwards, of which every name counts; of those above, a name counts once.
PATH = 12
HIDDEN = 16
EPOCHS = 5
_NAMES = 2048  # rows of the table of path vectors
_NAME_SIZE = 16
_WORD_SIZE = 8
_CELLS = 1 << 15  # leaves of padded sequences that run together
_PATH_NAMES = 1 << 20  # names on their paths, about
_GATHERED = 1 << 18  # path vectors gathered at once

SCHEMA = "page_id long, url string, text string, n_chars long"

Leaf = tuple[tuple[str, ...], str]  # names on the path from the root, and the text

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe noembed noframes title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter q s samp small "
    "span strike strong sub sup time tt u var wbr math semantics annotation maction menclose merror mfenced mfrac mi "
    "mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr "
    "munder munderover".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SAME_STOPS = frozenset("ul ol dl table tbody thead tfoot menu select".split())
_NOT_MAIN = frozenset("nav footer aside form header button select textarea menu dialog".split())
_NOT_MAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent notice alert popup modal newsletter subscribe signup "
    "share social related recommended comments comment respond reply disqus form search login widget pager pagination "
    "toolbar copyright legal".split()
)

# A quote opens a value only after "=", so that a stray one does not swallow the page.
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|!--|[!?/])")
_TAG_BEGINS = re.compile(r"<(?=/?[a-zA-Z]|[!?])")
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]")


# ------------------------------------------------------------------ leaves


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What a path says of an element: its tag, and the words of its class, id and role."""
    if "=" not in attributes:
        return (tag,)
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return (tag, *("." + w for w in dict.fromkeys(words)))


def leaves(markup: str) -> list[Leaf]:
    """Texts of a page in order, with their paths; white space is one space, character references are decoded.

    Marks without a letter or digit outside of every element are what is left of broken markup, and no text.
    """
    found: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []  # tag, names, and each name so far once
    open_tags: dict[str, int] = {}
    text: list[str] = []
    path: list[tuple[str, ...]] = []

    def flush() -> None:
        nonlocal path
        joined = _SPACE.sub(" ", references.unescape("".join(text))).strip()
        if joined and (path or _WORD.search(joined)):
            found.append((tuple(n for names in path for n in names), joined))
        text.clear()
        path = []

    def add(part: str) -> None:
        nonlocal path
        if part:
            if not path and not part.isspace():
                path = [stack[-PATH - 1][2]] if len(stack) > PATH else []
                path += [names for _, names, _ in stack[-PATH:]]
            text.append(part)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop()[0]] -= 1

    def close(wanted: str, stops: frozenset[str]) -> None:
        """Close the nearest open element named in ``wanted`` unless an element of ``stops`` holds it in."""
        if any(open_tags.get(t) for t in wanted.split()):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in wanted.split():
                    return pop_to(depth)
                if stack[depth][0] in stops:
                    return None
        return None

    at, last = 0, markup.rfind(">")
    while at <= last and (m := _TAG.search(markup, at)):
        add(markup[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = markup.find("-->", m.start() + 2)
            at = end + 3 if end >= 0 else len(markup)
            continue
        if m[2] is None:
            end = markup.find(">", m.end())
            at = end + 1 if end >= 0 else len(markup)
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in _INLINE:
                flush()
            if open_tags.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                pop_to(depth)
            continue
        if tag in _RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])").search(markup, at)
            close_at = markup.find(">", end.end()) if end else -1
            at = close_at + 1 if close_at >= 0 else len(markup)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _CLOSES_P:
            close("p", frozenset())
        if tag in _SAME:
            close(_SAME[tag], _SAME_STOPS)
        if tag not in _VOID and not m[3].rstrip().endswith("/"):
            names, above = _names(tag, m[3]), stack[-1][2] if stack else ()
            new = tuple(n for n in names if n not in above)
            stack.append((tag, names, above + new if new else above))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    # What looks like a tag and has no end is cut off; any other "<" is text.
    cut = _TAG_BEGINS.search(markup, at)
    add(markup[at : cut.start() if cut else len(markup)])
    flush()
    return found


def teacher(leaf: Leaf) -> bool | None:
    """The rules' label of a leaf; None where the markup does not say."""
    names = leaf[0]
    tags = [n for n in names if n[0] != "."]
    if any(t in _NOT_MAIN for t in tags) or any(n[1:] in _NOT_MAIN_NAMES for n in names if n[0] == "."):
        return False
    return True if "article" in tags or "main" in tags else None


# ------------------------------------------------------------------ features


def _row(name: str) -> int:
    return zlib.crc32(name.encode()) % _NAMES


def _word_vectors() -> np.ndarray:
    return np.random.default_rng(11).normal(size=(4096, _WORD_SIZE)).astype(np.float32)


class Features:
    """Path rows and word vectors of leaves, remembered by name and by word."""

    def __init__(self) -> None:
        self.table, self.words, self.rows = _word_vectors(), {}, {}

    def path(self, names: tuple[str, ...]) -> list[int]:
        rows = []
        for i, name in enumerate(names):
            row = self.rows.get(name)
            if row is None:
                row = self.rows[name] = _row(name)
                if len(self.rows) > 50_000:
                    self.rows.clear()
            rows.append(row)
        if names:  # the leaf's own element once more, apart from its ancestors
            tags = [n for n in names if n[0] != "."]
            rows.append(_row("leaf:" + (tags[-1] if tags else "")))
        return rows

    def text(self, text: str) -> list[float]:
        """The sum of the vectors of all words, and the length, word count and share of sentence ends of all of them."""
        words = text.split(" ")
        rows = []
        for word in words:
            row = self.words.get(word)
            if row is None:
                if len(self.words) > 50_000:
                    self.words.clear()
                row = self.words[word] = zlib.crc32(word.lower().encode()) % 4096
            rows.append(row)
        size, n = len(text), len(words)
        stops = sum(w[-1:] in ".!?" for w in words) / n
        if n > len(self.table):  # a long block: no row per word
            total = np.bincount(rows, minlength=len(self.table)) @ self.table
        else:
            total = self.table[rows].sum(0)
        return [*(total / n**0.5).tolist(), np.log1p(size) / 4, np.log1p(n) / 2, stops]


_TEXT_SIZE = _WORD_SIZE + 3


def prepare(features: Features, sequences: list[list[Leaf]]) -> tuple[np.ndarray, ...]:
    """Padded inputs of sequences: path rows flat with their leaf, text vectors ``[leaf, sequence, :]``, lengths."""
    lengths = np.array([len(s) for s in sequences])
    most = int(lengths.max())
    texts = np.zeros((most, len(sequences), _TEXT_SIZE), np.float32)
    rows, owner, weight = [], [], []
    for j, sequence in enumerate(sequences):
        for i, (names, text) in enumerate(sequence):
            texts[i, j] = features.text(text)
            own = features.path(names)
            rows += own
            owner += [i * len(sequences) + j] * len(own)
            weight += [max(1, len(own)) ** -0.5] * len(own)
    return np.array(rows, np.int64), np.array(owner, np.int64), np.array(weight, np.float32), texts, lengths


# ------------------------------------------------------------------ the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over leaves with a logistic output."""

    def __init__(self, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        size = _NAME_SIZE + _TEXT_SIZE

        def matrix(rows: int, columns: int) -> np.ndarray:
            return (random.normal(size=(rows, columns)) / rows**0.5).astype(np.float32)

        self.p = {"names": matrix(_NAMES, _NAME_SIZE) * _NAMES**0.5 * 0.3, "out": matrix(2 * HIDDEN, 1), "end": np.zeros(1, np.float32)}
        for way in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p |= {f"x{way}": matrix(size, 4 * HIDDEN), f"h{way}": matrix(HIDDEN, 4 * HIDDEN), f"c{way}": bias}

    def _inputs(self, batch: tuple[np.ndarray, ...]) -> np.ndarray:
        rows, owner, weight, texts, _ = batch
        names = np.zeros((texts.shape[0] * texts.shape[1], _NAME_SIZE), np.float32)
        for i in range(0, len(rows), _GATHERED):
            part = slice(i, i + _GATHERED)
            np.add.at(names, owner[part], self.p["names"][rows[part]] * weight[part, None])
        return np.concatenate([names.reshape(*texts.shape[:2], _NAME_SIZE), texts], axis=2)

    def _scan(self, x: np.ndarray, way: str, live: np.ndarray, keep: bool):
        """Hidden states ``[leaf, sequence, :]`` in one direction; padding leaves the state alone."""
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        given = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        out, trace = np.zeros((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in steps:
            z = given[t] + h @ self.p[f"h{way}"]
            gates, candidate = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            on = live[t][:, None]
            new = f * c + i * candidate
            squashed = np.tanh(new)
            if keep:
                trace.append((t, h, c, i, f, o, candidate, squashed, on))
            h, c = np.where(on, o * squashed, h), np.where(on, new, c)
            out[t] = h
        return out, trace

    def scores(self, batch: tuple[np.ndarray, ...], keep: bool = False):
        lengths = batch[4]
        x = self._inputs(batch)
        live = np.arange(len(x))[:, None] < lengths[None, :]
        (forward, trace_f), (backward, trace_b) = (self._scan(x, way, live, keep) for way in "fb")
        both = np.concatenate([forward, backward], axis=2)
        logits = (both @ self.p["out"])[:, :, 0] + self.p["end"]
        return (logits, x, both, live, (trace_f, trace_b)) if keep else logits

    def gradients(self, batch: tuple[np.ndarray, ...], labels: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        """Of the logistic loss over leaves whose label is known, by back-propagation through time."""
        logits, x, both, live, traces = self.scores(batch, keep=True)
        error = np.where(known & live, _sigmoid(logits) - labels, 0).astype(np.float32) / max(1, (known & live).sum())
        out = {"out": np.einsum("tbh,tb->h", both, error)[:, None], "end": error.sum()[None]}
        into = error[:, :, None] * self.p["out"][:, 0]
        dx = np.zeros_like(x)
        for k, (way, trace) in enumerate(zip("fb", traces, strict=True)):
            recurrent, dh = self.p[f"h{way}"], np.zeros((x.shape[1], HIDDEN), np.float32)
            dc, d_h, dz_all = np.zeros_like(dh), np.zeros_like(recurrent), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, h, c, i, f, o, candidate, squashed, on in reversed(trace):
                dh = dh + into[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate(
                    [d_new * candidate * i * (1 - i), d_new * c * f * (1 - f), dh * squashed * o * (1 - o), d_new * i * (1 - candidate**2)],
                    axis=1,
                )
                dz = np.where(on, dz, 0)
                dz_all[t] = dz
                d_h += h.T @ dz
                dh, dc = np.where(on, dz @ recurrent.T, dh), np.where(on, d_new * f, dc)
            out[f"x{way}"] = np.einsum("tbi,tbj->ij", x, dz_all)
            out[f"c{way}"], out[f"h{way}"] = dz_all.sum((0, 1)), d_h
            dx += dz_all @ self.p[f"x{way}"].T
        rows, owner, weight, *_ = batch
        out["names"], d_names = np.zeros_like(self.p["names"]), dx.reshape(-1, dx.shape[2])[:, :_NAME_SIZE]
        for i in range(0, len(rows), _GATHERED):
            part = slice(i, i + _GATHERED)
            np.add.at(out["names"], rows[part], d_names[owner[part]] * weight[part, None])
        return out

    def fit(self, sequences: list[tuple[list[Leaf], list[bool | None]]], epochs: int = EPOCHS) -> Labeller:
        """Adam over batches of sequences of like length."""
        features, random = Features(), np.random.default_rng(3)
        ordered = sorted((s for s in sequences if s[0]), key=lambda s: len(s[0]))
        batches = []
        for i in range(0, len(ordered), 24):
            part = ordered[i : i + 24]
            batch = prepare(features, [s for s, _ in part])
            labels = np.zeros(batch[3].shape[:2], np.float32)
            known = np.zeros(labels.shape, bool)
            for j, (_, marks) in enumerate(part):
                labels[: len(marks), j] = [bool(m) for m in marks]
                known[: len(marks), j] = [m is not None for m in marks]
            batches.append((batch, labels, known))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for at in random.permutation(len(batches)):
                step += 1
                for k, g in self.gradients(*batches[at]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    rate = 0.02 * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                    self.p[k] = (self.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
        return self

    def label(self, features: Features, pages: list[list[Leaf]]) -> list[list[bool]]:
        """Whether each leaf of each page belongs to the article."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        names = [sum(len(path) for path, _ in p) for p in pages]
        while order:
            n, size = 1, names[order[0]]
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= _CELLS and size + names[order[n]] <= _PATH_NAMES:
                size += names[order[n]]
                n += 1
            part, order = order[:n], order[n:]
            logits = self.scores(prepare(features, [pages[i] for i in part]))
            for j, i in enumerate(part):
                out[i] = (logits[: len(pages[i]), j] > 0).tolist()
        return out


# ------------------------------------------------------------------ training sequences

_BODIES = "article;main;main article;main .content;div .post .content;div .entry .content;div .article .body;section .story;div;div .text"
_REST = (
    "nav;header;footer;aside;form;div .ad;div .sidebar;aside .sidebar;div .cookie .notice;div .notice;section .comments;"
    "div .comments;ol .comment .list;div .comment;div .related;div .newsletter form;div .share;ul .menu;div .banner;div .menu;"
    "div .footer;div .header;div .advert;section .ad;div .breadcrumb;div .widget;div .promo;nav .pagination;div .login form"
)


def made_sequences(texts: list[str], labels: list[str], number: int, seed: int = 17) -> Iterator[tuple[list[Leaf], list[bool]]]:
    """Pages made of the sample's texts: an article among other parts, under containers of many names.

    ``texts`` are paragraphs, ``labels`` short texts of other parts. A tenth of the names are left out.
    """
    random = np.random.default_rng(seed)

    def pick(options: list) -> object:
        return options[int(random.integers(len(options)))]

    def names(container: str) -> tuple[str, ...]:
        return tuple(n for n in ("html body " + container).split() if n[0] != "." or random.random() > 0.1)

    def rest(inside: tuple[str, ...] = ("html", "body")) -> Iterator[Leaf]:
        path = (*inside, *names(pick(_REST.split(";")))[2:])
        leaf = pick(["p", "ul li a", "div", "span", "ul li", "h3", "label"]).split()
        for _ in range(int(random.integers(1, 7))):
            yield (*path, *leaf), pick(labels) if random.random() < 0.7 else pick(texts)

    for _ in range(number):
        leaves_, marks = [], []
        for _ in range(int(random.integers(0, 4))):
            leaves_ += rest()
        marks += [False] * (len(leaves_) - len(marks))
        body = names(pick(_BODIES.split(";")))
        for i in range(int(random.integers(1, 16))):
            tail = ["h1"] if i == 0 and random.random() < 0.7 else pick(["p", "p", "p", "p b", "ul li", "blockquote p", "h2", "pre", "table tr td"]).split()
            leaves_.append(((*body, *tail), pick(texts) if tail[0] in ("p", "blockquote") else pick(texts)[:60]))
            marks.append(True)
            if random.random() < 0.06:
                leaves_ += rest(body)
                marks += [False] * (len(leaves_) - len(marks))
        for _ in range(int(random.integers(0, 4))):
            leaves_ += rest()
        marks += [False] * (len(leaves_) - len(marks))
        yield leaves_, marks


# Texts of made sequences where the pages give none.
_PROSE = (
    "The council met on Tuesday to discuss the new bridge. Work is to begin in spring, and the old road stays open.",
    "She had written the first chapters in a small room above the bakery, long before anyone had heard of her.",
    "Researchers followed the birds for three years and found that they return to the same valley every autumn.",
    "Heat the oil in a wide pan, add the onions and stir until they are soft. Then pour in the stock.",
    "A library keeps an index so that a reader need not look at every shelf. The same idea serves a database.",
)
_LABELS = ("Home", "About us", "Contact", "Read more", "Share this", "Log in", "Privacy policy", "All rights reserved", "Next page", "Subscribe")


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller trained on about ``sample`` pages of any length, chosen by a hash, and on made sequences. Runs jobs.

    Where no page of the sample has text, the made sequences are of fixed texts.
    """
    usable = pages.select("page_id", "html").filter(F.length("html") > 0)
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sequences = []
    for row in chosen.select("html").limit(4 * sample).toLocalIterator():
        page = leaves(row["html"])
        sequences += [page[i : i + WINDOW] for i in range(0, len(page), WINDOW)]
    sequences.sort()
    marked = [(s, [teacher(leaf) for leaf in s]) for s in sequences]
    texts = [t for s, marks in marked for (_, t), m in zip(s, marks, strict=True) if m] or [t for s in sequences for _, t in s]
    others = [t for s, marks in marked for (_, t), m in zip(s, marks, strict=True) if m is False] or texts
    made = made_sequences(texts or list(_PROSE), others or list(_LABELS), max(200, len(sequences)))
    return Labeller().fit([*marked, *made])


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """The main text of every page: the article's blocks in order, joined by an empty line.

    Needs ``page_id``, ``url`` and ``html``; other columns are ignored. Null, empty or textless html gives an empty
    text; a null ``page_id`` and repeated rows are kept, a row each; no rows give no rows. Without ``model`` one is
    trained on a sample of the pages (runs jobs).
    """
    labeller = model or train(pages)

    def make():
        features = Features()

        def run(part: pa.RecordBatch) -> dict:
            found = [leaves(t) for t in texts_of(part, "html")]
            marks = labeller.label(features, found)
            texts = [
                "\n\n".join(text for (_, text), mark in zip(page, kept, strict=True) if mark)
                for page, kept in zip(found, marks, strict=True)
            ]
            return {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": list(map(len, texts))}

        return run

    return map_texts(pages.select(pages["page_id"].cast("long"), pages["url"], pages["html"]), "html", make, SCHEMA)
