"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between tags of block elements. Each block is described by its tag path (names,
classes and ids of all open elements, hashed), by its hashed words and by a few numbers (size, share of link text, place). A bidirectional LSTM,
written in numpy, reads the whole sequence of a page's blocks, so that each is labelled in sight of all others. It is trained
on the driver, once a process and with a fixed seed, on pages that are made up here from layouts with known labels.

Defined cases: null or empty html has an empty text; what isn't shown (scripts, styles, templates, comments, the head, elements with `hidden` or
`display: none`) is no block; a line break inside a block is white space; tags, comments and scripts that don't end reach to the page's end; very long and
deeply nested pages are read whole, in time in proportion to their length; repeated rows and null identifiers are extracted each; an empty table gives
an empty result; other columns are ignored. Nothing is cut off or capped.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import HashCache, small_batches, table

#: Elements whose tags don't end a block, elements without an end, and elements whose content isn't shown.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title head iframe object svg math audio video canvas".split())
RAW = frozenset("script style title textarea iframe noscript template".split())
#: Elements that end an open paragraph or an open element of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<(/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

PATHS, WORDS, NUMBERS = 192, 64, 8
WIDTH = PATHS + WORDS + NUMBERS


def _slots(n: int) -> HashCache:
    return HashCache(200_000, lambda word: zlib.crc32(word.encode("utf-8", "surrogatepass")) % n)


PATH_SLOT, WORD_SLOT = _slots(PATHS), _slots(WORDS)


class Element:
    """An open element: its names, those above it as a set of slots, and where the next element that isn't inline lies at or below it on the stack."""

    __slots__ = ("above", "name", "names", "slots", "last", "base", "link", "hidden")

    def __init__(self, above: Element | None, name: str, names: list[str], at: int, hidden: bool):
        self.above, self.name, self.names = above, name, names
        self.slots, self.last = (above.slots, above.last) if above else (0, None)
        for n in names:
            if n not in INLINE:
                self.slots |= 1 << PATH_SLOT[n]
                self.last = n
        self.base = at if name not in INLINE else above.base if above else -1
        self.link = name == "a" or (above is not None and above.link)
        self.hidden = hidden or (above is not None and above.hidden)


class Block:
    __slots__ = ("element", "text", "link")

    def __init__(self, element: Element | None, text: str, link: int):
        self.element, self.text, self.link = element, text, link

    @property
    def path(self) -> list[str]:
        """Names of all open elements, the outermost first."""
        out, e = [], self.element
        while e:
            out.append(e.names)
            e = e.above
        return [n for names in reversed(out) for n in names]


def unseen(attributes: str) -> bool:
    """Whether an element's attributes say that it isn't shown."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    values = {m[1]: (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(low)}
    return "hidden" in values and values["hidden"] != "until-found" or bool(re.search(r"(?:^|;)\s*display\s*:\s*none", values.get("style", "")))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page, in page order. The work is in proportion to the page: nothing is copied or looked through once per open element."""
    out: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # where the open elements of a name lie on the stack
    run: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            out.append(Block(stack[-1] if stack else None, text, linked))
        run.clear()
        linked = 0

    def pop(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().name].pop()

    def put(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1].hidden):
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if stack and stack[-1].link:
                linked += len(text)

    at = 0
    while m := TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            end()
        elif name == "br":
            run.append(" ")
        if m[1]:
            if places.get(name):
                pop(places[name][-1])
            continue
        if name in VOID:
            continue
        if name not in INLINE and stack:
            closed, k, ends = CLOSES.get(name, ()), stack[-1].base, False
            while k >= 0 and (stack[k].name == "p" or stack[k].name in closed):
                k, ends = stack[k - 1].base if k else -1, True
            if ends:
                pop(k + 1)
        names = [name]
        for value in NAMED.findall(m[3] or ""):
            names += ["." + p for p in PART.findall(html.unescape("".join(value)).lower())]
        places.setdefault(name, []).append(len(stack))
        stack.append(Element(stack[-1] if stack else None, name, names, len(stack), name in HIDDEN or unseen(m[3] or "")))
        if name in RAW:  # what is inside isn't markup
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            if name == "textarea":
                put(page[at : stop.start() if stop else len(page)])
            at = stop.start() if stop else len(page)
    put(page[at:])
    end()
    return out


DIGIT = re.compile(r"\d")


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    sets = b"".join((b.element.slots if b.element else 0).to_bytes(PATHS // 8, "little") for b in blocks)
    x[:, :PATHS] = np.unpackbits(np.frombuffer(sets, np.uint8).reshape(len(blocks), PATHS // 8), axis=1, bitorder="little")
    for i, b in enumerate(blocks):
        x[i, PATH_SLOT["last " + b.element.last if b.element and b.element.last else "none"]] = 1
        words = b.text.lower().split()
        counts = np.bincount(list(map(WORD_SLOT.__getitem__, words)), minlength=WORDS)
        x[i, PATHS : PATHS + WORDS] = counts / np.sqrt(len(words))
        size = len(b.text)
        x[i, PATHS + WORDS :] = (
            np.log1p(size) / 8, np.log1p(len(words)) / 6, min(1.0, b.link / size), b.text[-1] in ".!?:;…\"”»", b.text[:1].isupper(),
            len(DIGIT.findall(b.text)) / size, i / len(blocks), len(blocks) < 4,
        )
    return x


class Labeller:
    """A bidirectional LSTM over vectors, with a logistic unit on top."""

    def __init__(self, hidden: int = 24, seed: int = 11):
        rng, h = np.random.default_rng(seed), hidden
        self.hidden = h
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"out": init(2 * h, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {d + "x": init(WIDTH, 4 * h), d + "h": init(h, 4 * h), d + "c": np.repeat(np.array([0, 1, 0, 0], np.float32), h)}

    @staticmethod
    def _s(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states over gates [time, page, 4 * hidden]; where the mask is 0 the state stays as it is."""
        n, h = gates.shape[1], self.hidden
        state, cell, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((*gates.shape[:2], h), np.float32)
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            z = gates[t] + state @ self.p[d + "h"]
            i, f, o, g = self._s(z[:, :h]), self._s(z[:, h : 2 * h]), self._s(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = f * cell + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, state, cell, i, f, o, g, tc, m))
            cell, state = m * new + (1 - m) * cell, m * o * tc + (1 - m) * state
            out[t] = state
        return out

    def logits(self, pages: list[np.ndarray], keep: dict | None = None) -> np.ndarray:
        """[time, page]; pages of like lengths are best given together."""
        longest, n = max(map(len, pages)), len(pages)
        mask = np.zeros((longest, n), np.float32)
        gates = {d: np.zeros((longest, n, 4 * self.hidden), np.float32) for d in "fb"}
        for k, x in enumerate(pages):
            mask[: len(x), k] = 1
            for d in "fb":
                gates[d][: len(x), k] = x @ self.p[d + "x"] + self.p[d + "c"]
        logs = {d: [] if keep is not None else None for d in "fb"}
        both = np.concatenate([self._run(d, gates[d], mask, logs[d]) for d in "fb"], 2)
        if keep is not None:
            keep |= {"logs": logs, "both": both, "mask": mask}
        return (both @ self.p["out"])[..., 0] + self.p["bias"]

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, by backpropagation through time."""
        keep: dict = {}
        z, h = self.logits(pages, keep), self.hidden
        mask, both = keep["mask"], keep["both"]
        y, x = np.zeros_like(z), np.zeros((*z.shape, WIDTH), np.float32)
        for k, (a, b) in enumerate(zip(pages, labels)):
            x[: len(a), k], y[: len(a), k] = a, b
        dz = ((self._s(z) - y) * mask / mask.sum()).astype(np.float32)
        g = {"out": np.einsum("tnh,tn->h", both, dz)[:, None], "bias": np.array([dz.sum()], np.float32)}
        dh_all = dz[..., None] * self.p["out"][:, 0]
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            w, dw = self.p[d + "h"], np.zeros_like(self.p[d + "h"])
            da = np.zeros((*z.shape, 4 * h), np.float32)
            ds = dc = np.zeros((z.shape[1], h), np.float32)
            for t, state, cell, i, f, o, c, tc, m in reversed(keep["logs"][d]):
                ds = ds + dh_all[t][:, part]
                new_dc = m * (dc + ds * o * (1 - tc * tc)) + 0 * dc
                a = m * np.concatenate([new_dc * c * i * (1 - i), new_dc * cell * f * (1 - f), ds * tc * o * (1 - o), new_dc * i * (1 - c * c)], 1)
                da[t] = a
                dw += state.T @ a
                ds, dc = (1 - m) * ds + a @ w.T, (1 - m) * dc + new_dc * f
            flat = da.reshape(-1, 4 * h)
            g |= {d + "x": x.reshape(-1, WIDTH).T @ flat, d + "h": dw, d + "c": flat.sum(0)}
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 5, rate: float = 0.01, batch: int = 48, seed: int = 5) -> Labeller:
        """Adam over batches of pages of like lengths."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for epoch in range(epochs):
            for k in rng.permutation(len(groups)):
                step += 1
                for name, g in self.gradients([pages[i] for i in groups[k]], [labels[i] for i in groups[k]]).items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= rate * 0.6**epoch * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)
        return self


def main_texts(pages: list[str], model: Labeller, cells: int = 8192) -> list[str]:
    """The main text of each page; pages of like lengths are read together, at most `cells` blocks at a time unless one page has more."""
    blocks = [blocks_of(p) for p in pages]
    out, order = [""] * len(pages), sorted((k for k, b in enumerate(blocks) if b), key=lambda k: len(blocks[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and len(blocks[order[j]]) * (j - i + 1) <= cells:
            j += 1
        z = model.logits([vectors(blocks[k]) for k in order[i:j]])
        for n, k in enumerate(order[i:j]):
            out[k] = "\n".join(b.text for b, keep in zip(blocks[k], z[:, n] > 0) if keep)
        i = j
    return out


@functools.cache
def trained_labeller(pages: int = 900, seed: int = 3) -> Labeller:
    """A labeller fitted on made-up pages."""
    from .html_layouts import layouts

    xs, ys = [], []
    for page, labels in layouts(pages, seed):
        blocks = blocks_of(page)
        if blocks and len(blocks) == len(labels):
            xs.append(vectors(blocks))
            ys.append(np.array(labels, np.float32))
    return Labeller().fit(xs, ys)


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark)
    kept = spark.sparkContext.broadcast((model or trained_labeller()).p)  # matrices of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Labeller()
        m.p = kept.value
        for part in parts:
            texts = main_texts([h or "" for h in part.column(2).to_pylist()], m)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`."""
    return extract(table(spark, sf_dir, "pages"))
