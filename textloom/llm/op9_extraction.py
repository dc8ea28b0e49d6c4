"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of open elements above
them. A block's vector holds the hashed tags, classes and ids of its path, the hashed words of its whole text, and a few
shares (links, marks, capitals, place on the page). A bidirectional LSTM, in numpy, reads the blocks of a page in both
directions, so each block is classified by all the others, and those above one half are the article.

The model is trained here, on generated pages of many layouts (``page_generator``), with other layouts, names and words
for each page; the generator's seed and ``TRAIN_PAGES`` bound it. It sees no label of any table.

Character references are decoded, white space inside a block is one space, blocks are joined by two line feeds.
Comments, scripts, styles, templates and titles are never text. Everything else is left to the labeller: formulas (math),
drawings (svg), object, iframe and noscript stand in their line like other words. Reading a page is linear in its size,
whatever it holds.

Defined cases: null and empty pages have the empty text; text outside any element is a block of its own; elements that are
never closed end with the page or where HTML ends them; repeated rows each give a row; extra columns are ignored. The whole path
of a block is looked at, however deep it is.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.operators.htmltokens import END, OTHER, TEXT, tokens

from .common import frugal, table
from .page_generator import page

TRAIN_PAGES, EPOCHS, SEED = 1500, 9, 11
PATHS, WORDS, HIDDEN = 1024, 512, 20
PATH_SIZE, WORD_SIZE, SHARES = 24, 12, 9

#: HTML's void elements, those whose content is not text, and those that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template title".split())
INLINE = frozenset("math svg object noscript iframe a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose own elements all stand inside the line.
FOREIGN = frozenset(("math", "svg"))
#: What an opening tag ends: paragraphs, and items of its own kind within its list or table.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # hashed tokens of the elements above
    link: int  # characters within links


def _hash(token: str) -> int:
    return zlib.crc32(token.encode()) % PATHS


class _Path:
    """The open elements: places of each tag, and how often each hashed token stands above a block."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.counts: Counter = Counter()
        self.above: list[str] = []  # tags that stand outside lines
        self.foreign = 0  # open formulas and drawings
        self.known: tuple[int, ...] | None = None

    def tokens(self) -> tuple[int, ...]:
        if self.known is None:
            self.known = tuple(sorted({*self.counts, *(_hash(f"{k}:{t}") for k, t in enumerate(self.above[:-4:-1]))}))
        return self.known

    def open(self, tag: str, names: tuple[str, ...], inline: bool) -> None:
        hashed = () if inline else tuple({_hash(x) for x in (tag, *names)})
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, hashed))
        self.foreign += tag in FOREIGN
        if hashed:
            self.counts.update(hashed)
            self.above.append(tag)
            self.known = None

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            tag, hashed = self.stack.pop()
            self.places[tag].pop()
            self.foreign -= tag in FOREIGN
            if hashed:
                for x in hashed:
                    self.counts[x] -= 1
                    if not self.counts[x]:
                        del self.counts[x]
                self.above.pop()
                self.known = None

    def find(self, tag: str, stop: tuple[str, ...] = ()) -> int:
        """The place of the nearest open element with this tag, or -1 if there is none or a stop is nearer."""
        found = self.places.get(tag)
        if not found or any((p := self.places.get(s)) and p[-1] > found[-1] for s in stop):
            return -1
        return found[-1]


def blocks(source: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    path, parts = _Path(), []
    link = 0

    def flush():
        nonlocal link
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path.tokens(), link))
            parts.clear()
        link = 0

    for kind, tag, attributes in tokens(source, SILENT):
        if kind == TEXT:
            parts.append(tag)
            if path.places.get("a"):
                link += len(tag)
            continue
        if kind == OTHER or tag in SILENT:
            continue
        inline = tag in INLINE or path.foreign > 0
        if not inline:
            flush()
        if kind == END:
            if (k := path.find(tag)) >= 0:
                path.close(k)
            continue
        if tag == "br":
            parts.append(" ")
        if not inline:
            if tag in ENDS_P and (k := path.find("p", ("article", "section", "div", "td", "li", "body"))) >= 0:
                path.close(k)
            if tag in ITEMS and (k := path.find(tag, ITEMS[tag])) >= 0:
                path.close(k)
        if tag not in VOID and not (path.foreign and attributes.endswith("/")):
            names = tuple(x for g in _NAMES.findall(attributes) for x in _WORD.findall("".join(g).lower())) if attributes and "=" in attributes else ()
            path.open(tag, names, inline)
    flush()
    return out


def features(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path bags, word bags and shares of all blocks of some pages, in a row."""
    n = sum(map(len, pages))
    p, w, s = np.zeros((n, PATHS), np.float32), np.zeros((n, WORDS), np.float32), np.zeros((n, SHARES), np.float32)
    row = 0
    for some in pages:
        for i, b in enumerate(some):
            if b.path:
                p[row, b.path] = 1 / len(b.path) ** 0.5
            words = b.text.lower().encode().split()
            counts = np.bincount([zlib.crc32(x) % WORDS for x in words], minlength=WORDS)
            w[row] = counts / np.sqrt((counts * counts).sum() or 1)
            size = len(b.text)
            s[row] = (np.log1p(size) / 8, np.log1p(len(words)) / 6, min(1.0, b.link / size), sum(map(b.text.count, ".,;!?")) / size * 10, b.text[-1] in ".!?…\"'", b.text[0].isupper(), i / len(some), (len(some) - i) / len(some), "©" in b.text)
            row += 1
    return p, w, s


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Lstm:
    """One direction over sequences sorted by falling length; step t holds the first ``active[t]`` of them."""

    def forward(self, x, wx, wh, b, steps, keep: bool = False):
        h_size, total = wh.shape[0], x @ wx + b
        h = c = np.zeros((len(steps[0]), h_size), np.float32)
        out = np.zeros((len(x), h_size), np.float32)
        trace = []
        for rows in steps:
            k = len(rows)
            h, c = h[:k], c[:k]
            z = total[rows] + h @ wh
            i, f, o = (_sigmoid(z[:, j * h_size : (j + 1) * h_size]) for j in range(3))
            g = np.tanh(z[:, 3 * h_size :])
            before = c
            c = f * c + i * g
            t = np.tanh(c)
            if keep:
                trace.append((h, before, i, f, o, g, t))
            h = o * t
            out[rows] = h
        self.trace = trace
        return out

    def backward(self, d_out, x, wx, wh, steps):
        h_size = wh.shape[0]
        dz_all, dwh = np.zeros((len(x), 4 * h_size), np.float32), np.zeros_like(wh)
        dh, dc = np.zeros((0, h_size), np.float32), np.zeros((0, h_size), np.float32)
        for rows, (h, before, i, f, o, g, t) in zip(reversed(steps), reversed(self.trace), strict=True):
            grow = len(rows) - len(dh)
            dh = np.vstack([dh, np.zeros((grow, h_size), np.float32)]) + d_out[rows]
            dc = np.vstack([dc, np.zeros((grow, h_size), np.float32)]) + dh * o * (1 - t * t)
            dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)])
            dz_all[rows] = dz
            dwh += h.T @ dz
            dh, dc = dz @ wh.T, dc * f
        return dz_all @ wx.T, x.T @ dz_all, dwh, dz_all.sum(0)


def _steps(lengths: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of each step of both directions, for sequences in a row, longest first."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    starts = np.cumsum([0, *lengths])[:-1]
    first, size = starts[order], np.array([lengths[i] for i in order])
    forth, back = [], []
    for t in range(int(size[0])):
        k = int((size > t).sum())
        forth.append(first[:k] + t)
        back.append(first[:k] + size[:k] - 1 - t)
    return forth, back


@dataclass
class Labeller:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        d = PATH_SIZE + WORD_SIZE + SHARES
        shapes = {"ep": (PATHS, PATH_SIZE), "ew": (WORDS, WORD_SIZE), "fx": (d, 4 * HIDDEN), "fh": (HIDDEN, 4 * HIDDEN), "bx": (d, 4 * HIDDEN), "bh": (HIDDEN, 4 * HIDDEN), "o": (2 * HIDDEN + d, 1)}
        self.weights = {k: rng.normal(0, 1 / s[0] ** 0.5 if k[0] in "fbo" else 0.5, s).astype(np.float32) for k, s in shapes.items()}
        self.weights |= {k: np.zeros(4 * HIDDEN, np.float32) for k in ("fb", "bb")} | {"ob": np.zeros(1, np.float32)}
        return self

    def run(self, bags, lengths: list[int], keep: bool = False):
        w, (p, words, shares) = self.weights, bags
        x = np.hstack([p @ w["ep"], words @ w["ew"], shares])
        forth, back = _steps(lengths)
        a, b = _Lstm(), _Lstm()
        hidden = np.hstack([a.forward(x, w["fx"], w["fh"], w["fb"], forth, keep), b.forward(x, w["bx"], w["bh"], w["bb"], back, keep), x])
        return _sigmoid(hidden @ w["o"] + w["ob"])[:, 0], (x, hidden, a, b, forth, back)

    def gradients(self, bags, lengths: list[int], target: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        found, (x, hidden, a, b, forth, back) = self.run(bags, lengths, keep=True)
        d = ((found - target) / len(target)).astype(np.float32)[:, None]
        dh = d @ w["o"].T
        fx = a.backward(dh[:, :HIDDEN], x, w["fx"], w["fh"], forth)
        bx = b.backward(dh[:, HIDDEN : 2 * HIDDEN], x, w["bx"], w["bh"], back)
        dx = fx[0] + bx[0] + dh[:, 2 * HIDDEN :]
        return {"o": hidden.T @ d, "ob": d.sum(0), "fx": fx[1], "fh": fx[2], "fb": fx[3], "bx": bx[1], "bh": bx[2], "bb": bx[3], "ep": bags[0].T @ dx[:, :PATH_SIZE], "ew": bags[1].T @ dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE]}

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The probability of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        full = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
        at = 0
        while at < len(full):
            to = at + 1
            while to < len(full) and to - at < 128 and sum(len(pages[i]) for i in full[at : to + 1]) <= 4096:
                to += 1
            some = [pages[i] for i in full[at:to]]
            lengths = [len(b) for b in some]
            found, _ = self.run(features(some), lengths)
            for i, part in zip(full[at:to], np.split(found, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = part
            at = to
        return out


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.006) -> Labeller:
    """A labeller from generated pages, by Adam over small groups of pages."""
    rng, model = random.Random(seed), Labeller().start(seed)
    examples = []
    for _ in range(pages):
        source, marks = page(rng)
        found = blocks(source)
        examples.append((found, np.array([marks.get(b.text, 0) for b in found], np.float32)))
    examples = [e for e in examples if e[0]]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    cached = {i: features([e[0]]) for i, e in enumerate(examples)}
    for epoch in range(epochs):
        # pages of like length together, in another order each time
        order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]) * rng.uniform(0.8, 1.25))
        groups = [order[at : at + 16] for at in range(0, len(order), 16)]
        rng.shuffle(groups)
        for group in groups:
            bags = tuple(np.vstack([cached[i][j] for i in group]) for j in range(3))
            grads = model.gradients(bags, [len(examples[i][0]) for i in group], np.concatenate([examples[i][1] for i in group]))
            step += 1
            now = rate * (0.3 if epoch >= epochs - 2 else 1)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.weights[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


_trained: dict[tuple, Labeller] = {}


def trained() -> Labeller:
    """The labeller of the default parameters, trained once in a driver."""
    key = (TRAIN_PAGES, EPOCHS, SEED)
    if key not in _trained:
        _trained[key] = train()
    return _trained[key]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks: one row for each row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches):
        model_ = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                cut = [blocks(h) if h else [] for h in some.column(2).to_pylist()]
                texts = ["\n\n".join(x.text for x, y in zip(bs, found, strict=True) if y >= 0.5) for bs, found in zip(cut, model_.label(cut), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in cut], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(frugal(run), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint, n_blocks bigint")


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())


QUERIES = {"op9_extraction": op9_extraction}
ORACLES: dict[str, str] = {}
