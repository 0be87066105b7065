"""Main text of HTML pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks (text between block-level tags). Each block has a vector: hashed tag-path parts (tags,
classes, ids, roles and their pairs), hashed words, and a few figures of length, links, place and container. A bidirectional LSTM
(numpy) reads the whole sequence; the label of a block is read off the LSTM's states alone, so it always has the context of the page.

There are no gold labels, so the LSTM is trained on a bounded sample of distinct pages (``SAMPLE`` of smallest hash, one span of ``SPAN`` blocks
of each version) with labels from a teacher that reads tag names and class words. The teacher's verdict is no input. Each page
comes in several versions: with its content in other leaves (lists, tables, quotes, subheads, definitions, code, captions, plain divisions, an
article's own header), with inserted blocks (menus, sidebars, notices, adverts, forms, comments), and with container names taken
away or replaced by words the teacher doesn't know while the labels stay, so that lengths, links, neighbours and shape have
to be learnt too. Vectors are made in the executors; the driver gets ``SAMPLE`` * ``VERSIONS`` spans of half floats (100 MB at most).

Defined cases: null or empty html, or no content block: empty text. Character references are decoded in text; white
space inside a block is one space; script, style, template, comments and the head give no blocks. Markup left
open is closed by what follows it, a tag or quoted attribute left open ends with the page, and scanning takes time linear in
the page. Repeated rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import lean

PATH, WORDS, EXTRA, HIDDEN, SAMPLE, SPAN, VERSIONS, EPOCHS = 320, 32, 9, 20, 500, 64, 4, 8
#: Fixed value lists of HTML: elements that start a new block, elements without content, elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object math canvas".split())
#: Fixed word lists of the teacher: what tag, class, id and role words say about a container.
AWAY = frozenset("nav navbar navigation menu header masthead footer aside sidebar ad ads advert advertisement sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal overlay related recommended share sharing social comment comments reply replies respond breadcrumb breadcrumbs newsletter subscribe subscription signup login form search widget button select option toolbar pagination pager copyright title head contentinfo complementary textarea dialog disclaimer".split())
TOWARDS = frozenset("article main content post entry story articlebody text".split())
#: A comment, a tag with its attributes, or other markup; what is left open ends with the page, so no place is read twice.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in sorted(SILENT)}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Containers of a block that are told apart, outermost first; texts of deeper ones are kept.
DEPTH = 48
_PART = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]  # outermost first: tag, then words of class, id and role
    text: str
    linked: int  # code points inside links


def _named(tag: str, attributes: str) -> tuple[str, ...]:
    words = [w for m in _ATTR.finditer(attributes) for w in _PART.findall((m[2] or m[3] or m[4] or "").lower())] if attributes else []
    return (tag, *words)


def scan(page: str):
    """(text, None) and (None, (closing, tag, attributes)) in page order, without comments and what is inside silent elements."""
    at, end, never = 0, len(page), set()
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield page[at:], None
            return
        if m.start() > at:
            yield page[at : m.start()], None
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in SILENT and not m[1] and tag not in never:
            close = _CLOSE[tag].search(page, at)
            if close:
                at = close.start()
            elif tag in ("script", "style"):  # as in browsers, the rest of the page is inside
                return
            else:
                never.add(tag)
        yield None, (bool(m[1]), tag, m[3])


def plain_text(page: str) -> str:
    """All text of a page, a space for each tag."""
    return html.unescape(" ".join(text for text, _ in scan(page) if text))


def blocks_of(page: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, ...]] = []
    texts: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text and not any(p[0] == "head" for p in stack):
                found.append(Block(tuple(stack), text, min(linked, len(text))))
            texts.clear()
        linked = 0

    for text, markup in scan(page):
        if text is not None:
            texts.append(text)
            if links:
                linked += len(text.strip())
            continue
        closing, tag, attributes = markup
        if tag == "br":
            texts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCKS:
            close()
            if closing:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        links = 0
                        break
            elif tag not in VOID:
                if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th", "body") or tag[0] == "h" and tag[1:].isdigit():
                    closes = {"body": ("head",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                    closes = (*closes, "p") if tag != "p" else ("p",)
                    while stack and stack[-1][0] in closes:
                        stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                if len(stack) < DEPTH:  # deeper containers are taken for the one of this depth
                    stack.append(_named(tag, attributes))
    close()
    return found


def teacher(blocks: list[Block]) -> list[int]:
    """1 for content: the innermost container whose words say anything decides; an article's own header says nothing."""
    told, out = any(not TOWARDS.isdisjoint(p) for b in blocks for p in b.path), []
    for b in blocks:
        label = None
        for k in range(len(b.path) - 1, -1, -1):
            p = b.path[k]
            if p[0] in ("article", "main"):  # whatever its classes say of its surroundings
                label = int("comment" not in p and "related" not in p)
            elif p[0] == "header" and AWAY.isdisjoint(p[1:]) and any(q[0] == "article" for q in b.path[:k]):
                continue
            elif not AWAY.isdisjoint(p):
                label = 0
            elif not TOWARDS.isdisjoint(p):
                label = 1
            if label is not None:
                break
        out.append(int(not told and len(b.text) > 60 and b.linked < 0.3 * len(b.text)) if label is None else label)
    return out


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


class Vectors:
    """Vectors of blocks, with memos of path and word slots."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            v = np.zeros(PATH, np.float32)
            for depth, p in enumerate(reversed(path)):
                for w in p:
                    v[_slot(f"{'leaf' if depth == 0 else 'in'} {w}", PATH)] += 1
                if depth:
                    v[_slot(f"{p[0]}>{path[len(path) - depth][0]}", PATH)] += 0.5
            self.paths[path] = v / max(1.0, float(np.linalg.norm(v)))
        return self.paths[path]

    def of(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), PATH + WORDS + EXTRA), np.float32)
        total, run = sum(len(b.text) for b in blocks), 0
        if len(self.words) > 300_000:
            self.words.clear()
        inside: dict[tuple, int] = {}  # code points in each container
        for b in blocks:
            inside[b.path[:-1]] = inside.get(b.path[:-1], 0) + len(b.text)
        for k, b in enumerate(blocks):
            out[k, :PATH] = self.path(b.path)
            words = b.text.lower().split()
            slots = []
            for w in words:
                s = self.words.get(w)
                if s is None:
                    s = self.words[w] = _slot(w, WORDS)
                slots.append(s)
            bag = np.sqrt(np.bincount(slots, minlength=WORDS))
            out[k, PATH : PATH + WORDS] = bag / max(1.0, float(np.linalg.norm(bag)))
            out[k, PATH + WORDS :] = (
                np.log1p(len(b.text)) / 8, b.linked / len(b.text), len(words) < 6, run / total, len(b.text) / total, b.text[-1] in ".!?",
                inside[b.path[:-1]] / total, k > 0 and blocks[k - 1].path[:-1] == b.path[:-1], min(1.0, len(b.path) / 10),
            )
            run += len(b.text)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output, in numpy. Sequences are (time, batch, features) with a mask."""

    def __init__(self, inputs: int = PATH + WORDS + EXTRA, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.w = hidden, {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)).astype(np.float32)
            self.w["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.w["c" + d] = np.zeros(4 * hidden, np.float32)
            self.w["c" + d][hidden : 2 * hidden] = 1  # forget gates start open
        self.w["o"] = rng.normal(0, 0.2, (2 * hidden, 1)).astype(np.float32)
        self.w["z"] = np.zeros(1, np.float32)

    def _pass(self, x, mask, d):
        n, size, h = len(x), x.shape[1], self.hidden
        states, hs, cs = [], np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
        out = np.zeros((n, size, h), np.float32)
        inputs = x @ self.w["x" + d] + self.w["c" + d]
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g = inputs[t] + hs @ self.w["h" + d]
            i, f, o, u = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
            m = mask[t][:, None]
            c = f * cs + i * u
            tc = np.tanh(c)
            states.append((t, hs, cs, i, f, o, u, tc, m))
            hs, cs = m * (o * tc) + (1 - m) * hs, m * c + (1 - m) * cs
            out[t] = hs
        return out, states

    def forward(self, x, mask):
        hf, sf = self._pass(x, mask, "f")
        hb, sb = self._pass(x, mask, "b")
        joined = np.concatenate([hf, hb], axis=2)
        return _sigmoid(joined @ self.w["o"] + self.w["z"])[:, :, 0], joined, sf, sb

    def gradients(self, x, mask, y):
        p, joined, sf, sb = self.forward(x, mask)
        dz = ((p - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        g = {"o": np.tensordot(joined, dz, ([0, 1], [0, 1])), "z": dz.sum(axis=(0, 1))}
        dj = dz @ self.w["o"].T
        h = self.hidden
        for d, states, dh_all in (("f", sf, dj[:, :, :h]), ("b", sb, dj[:, :, h : 2 * h])):
            dwh, dgs = np.zeros_like(self.w["h" + d]), np.zeros((len(x), x.shape[1], 4 * h), np.float32)
            dh, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, h0, c0, i, f, o, u, tc, m in reversed(states):
                dh = dh + dh_all[t]
                a, b = dh * m, dc * m
                b = b + a * o * (1 - tc * tc)
                dg = np.concatenate([b * u * i * (1 - i), b * c0 * f * (1 - f), a * tc * o * (1 - o), b * i * (1 - u * u)], axis=1)
                dwh += h0.T @ dg
                dgs[t] = dg
                dh, dc = dh * (1 - m) + dg @ self.w["h" + d].T, dc * (1 - m) + b * f
            g["h" + d], g["x" + d], g["c" + d] = dwh, np.tensordot(x, dgs, ([0, 1], [0, 1])), dgs.sum(axis=(0, 1))
        return g

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, size: int = 48, rate: float = 0.01, seed: int = 3) -> None:
        rng = random.Random(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        for _ in range(epochs):
            order = sorted(range(len(sequences)), key=lambda k: (len(sequences[k][0]) // 8, rng.random()))
            groups = [order[k : k + size] for k in range(0, len(order), size)]
            rng.shuffle(groups)
            for group in groups:
                x, mask = padded([sequences[k][0] for k in group])
                y, _ = padded([sequences[k][1][:, None] for k in group])
                step += 1
                for k, g in self.gradients(x, mask, y[:, :, 0]).items():
                    g = g.reshape(self.w[k].shape)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, vectors: list[np.ndarray]) -> list[np.ndarray]:
        """Content probabilities of each page's blocks; pages of like length go through together."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(vectors)
        order = sorted((k for k in range(len(vectors)) if len(vectors[k])), key=lambda k: len(vectors[k]))
        at = 0
        while at < len(order):
            longest, until = len(vectors[order[at]]), at
            while until < len(order) and until - at < 256 and len(vectors[order[until]]) <= longest + 8 + longest // 8:
                until += 1
            x, mask = padded([vectors[k] for k in order[at:until]])
            p = self.forward(x, mask)[0]
            for c, k in enumerate(order[at:until]):
                out[k] = p[: len(vectors[k]), c]
            at = until
        return out


def padded(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(a) for a in arrays)
    x, mask = np.zeros((n, len(arrays), arrays[0].shape[1]), np.float32), np.zeros((n, len(arrays)), np.float32)
    for k, a in enumerate(arrays):
        x[: len(a), k], mask[: len(a), k] = a, 1
    return x, mask


#: Leaves of blocks that are put in: as menus, notices and adverts have them.
_LEAVES = (*[()] * 3, *[("p",)] * 3, *[("li",)] * 4, ("ul", "li"), ("ol", "li"), ("span",), ("h2",), ("h3",), ("h4",), ("h5",), ("h6",), ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("table", "tr", "th"), ("dl", "dt"), ("dl", "dd"), ("blockquote",), ("pre",), ("figure", "figcaption"), ("div",), ("header", "h1"))
_SOUNDS = ("ba", "ko", "mi", "ru", "ta", "ze", "lo", "fen", "dar", "sil")


def _nonsense(rng: random.Random) -> str:
    return "".join(rng.choices(_SOUNDS, k=3))


def leaved(blocks: list[Block], labels: list[int], rng: random.Random) -> list[Block]:
    """Content in other leaves: its words as lists, tables, quotes, subheads, definitions, code, captions and divisions inside the same container."""
    share, out, first = rng.choice([0.25, 0.5, 0.9]), [], True
    for b, y in zip(blocks, labels):
        if not y or rng.random() > share:
            out.append(b)
            first = first and not y
            continue
        inside = b.path[:-1] if b.path and (b.path[-1][0] == "p" or b.path[-1][0] in ("h1", "h2", "h3")) else b.path
        words = b.text.split()
        kind = rng.choice(["list", "table", "quote", "head", "terms", "pre", "figure", "div", "section", "header" if first else "list"])
        first = False
        at = 0

        def put(most: int, *leaf: str) -> None:
            nonlocal at
            part = " ".join(words[at : at + rng.randrange(1, most + 1)])
            at += len(part.split())
            if part:
                out.append(Block((*inside, *((tag,) for tag in leaf)), part, len(part) if rng.random() < 0.05 else 0))

        if kind == "list":
            outer, wrapped, most = rng.choice(["ul", "ol"]), rng.random() < 0.2, rng.choice([4, 12, 40])
            for _ in range(rng.randrange(2, 9)):
                put(most, outer, "li", *(["p"] if wrapped else []))
        elif kind == "table":
            body, most = ["table", "tbody"] if rng.random() < 0.5 else ["table"], rng.choice([2, 6, 25])
            if rng.random() < 0.4:
                put(8, "table", "caption")
            for k in range(rng.randrange(2, 13)):
                put(most, *body, "tr", "th" if k < 2 and rng.random() < 0.5 else "td")
        elif kind == "terms":
            for _ in range(rng.randrange(1, 5)):
                put(4, "dl", "dt")
                put(30, "dl", "dd")
        elif kind == "head":
            put(9, f"h{rng.randrange(2, 7)}")
        elif kind == "header":
            put(12, "header", rng.choice(["h1", "h2"]))
            if rng.random() < 0.5:
                put(20, "header", "p")
        elif kind == "figure":
            put(20, "figure", "figcaption")
        elif kind == "quote":
            put(60, "blockquote", *(["p"] if rng.random() < 0.5 else []))
        elif kind == "pre":
            put(40, "pre")
        else:
            put(60, kind, *(["p"] if kind == "section" else []))
        if at < len(words):
            out.append(Block((*inside, ("p",)), " ".join(words[at:]), 0))
    return out


def varied(blocks: list[Block], rng: random.Random) -> list[Block]:
    """Content containers renamed at times, and blocks of other kinds put in, with words of the page."""
    words = [w for b in blocks for w in b.text.split()[:12]][:400] or ["a"]
    if rng.random() < 0.6:
        new = rng.choice([("main",), ("div", "content"), ("div", "post"), ("section", "story"), ("div", "entry", "content"), ("div", "article", "text"), ("div", "main")])
        blocks = [Block(tuple(new if p[0] in ("article", "main") else p for p in b.path), b.text, b.linked) for b in blocks]
    out = list(blocks)
    outer = (("html",), ("body",))
    for _ in range(rng.randrange(1, 7)):
        named = rng.choice(("nav", "footer", "header", "aside")) if rng.random() < 0.5 else rng.choice(sorted(AWAY - {"head", "title"}))
        tag = named if named in BLOCKS and rng.random() < 0.7 else rng.choice(["div", "section", "ul", "aside", "p"])
        at = rng.choice((0, len(out), rng.randrange(0, len(out) + 1), rng.randrange(0, len(out) + 1)))
        near = out[at - 1].path if at and rng.random() < 0.5 else outer
        inside = tuple(p for p in near if p[0] not in ("p", "h1", "h2", "li"))
        for _ in range(rng.randrange(1, 5)):
            text = " ".join(rng.choices(words, k=rng.randrange(1, 40)))
            leaf = tuple((tag,) for tag in rng.choice(_LEAVES))
            linked = len(text) if rng.random() < 0.4 else 0
            out.insert(at, Block((*inside, (tag, named) if tag != named else (tag,), *leaf), text, linked))
    return out


def unnamed(blocks: list[Block], labels: list[int], rng: random.Random) -> list[Block]:
    """Telling names taken away: of content containers, or of short or linked blocks that are none, by words nobody knows."""
    content, other = rng.random() < 0.7, rng.random() < 0.5
    new: dict[tuple, tuple] = {}

    def hidden(p: tuple[str, ...]) -> tuple[str, ...]:
        if AWAY.isdisjoint(p) and TOWARDS.isdisjoint(p):
            return p
        if p not in new:
            new[p] = (rng.choice(["div", "section"]), *([_nonsense(rng)] if rng.random() < 0.8 else []))
        return new[p]

    return [Block(tuple(map(hidden, b.path)), b.text, b.linked) if (content if y else other and (len(b.text) < 60 or 2 * b.linked > len(b.text))) else b for b, y in zip(blocks, labels)]


def sequences_of(page: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of a span of each version of a page; the same for the same page."""
    rng, vectors, out = random.Random(zlib.crc32(page.encode(errors="replace"))), Vectors(), []
    blocks = blocks_of(page)
    for k in range(VERSIONS if blocks else 0):
        version = leaved(blocks, teacher(blocks), rng) if k else blocks
        version = varied(version, rng) if k > 1 else version
        labels = teacher(version)
        if k == 3:
            version = unnamed(version, labels, rng)
        at = rng.randrange(0, max(1, len(version) - SPAN + 1))
        out.append((vectors.of(version)[at : at + SPAN], np.array(labels, np.float32)[at : at + SPAN]))
    return out


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    whole = pages.select(F.col("html").cast("string").alias("html")).filter("html <> ''").withColumn("h", F.xxhash64("html"))
    chosen = whole.select("h").distinct().orderBy("h").limit(sample)

    def spans(batches):
        for batch in batches:
            for key, page in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist()):
                got = sequences_of(page)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array([x.astype(np.float16).tobytes() for x, _ in got], pa.binary()), pa.array([y.astype(np.uint8).tobytes() for _, y in got], pa.binary())],
                    names=["h", "version", "x", "y"],
                )

    rows = whole.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html")).mapInArrow(lean(spans), "h long, version int, x binary, y binary").orderBy("h", "version").collect()
    size = PATH + WORDS + EXTRA
    sequences = [(np.frombuffer(r["x"], np.float16).reshape(-1, size).astype(np.float32), np.frombuffer(r["y"], np.uint8).astype(np.float32)) for r in rows]
    labeller = Labeller()
    if sequences:
        labeller.fit(sequences)
    return labeller


def main_text(blocks: list[Block], chances: np.ndarray) -> str:
    return "\n".join(b.text for b, p in zip(blocks, chances) if p >= 0.5)


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""

    def texts(batches):
        vectors = Vectors()
        for batch in batches:
            column = batch.column("html").to_pylist()
            for i in range(0, len(column), 500):
                found = [blocks_of(h or "") for h in column[i : i + 500]]
                chances = labeller.label([vectors.of(b) for b in found])
                out = [main_text(b, p) for b, p in zip(found, chances)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(i, 500), batch.column("url").slice(i, 500), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(texts), "page_id long, url string, text string, n_chars long")
