"""Main-text extraction by a recurrent block labeller.

A page is cut into blocks: runs of text between tags of block-level elements, with character references decoded and
white space turned into single spaces. For each block the labeller gets the tags, classes and ids above it as hashed
tokens, its words as hashed buckets and a few numbers; a bidirectional LSTM reads the blocks of a page in order, and each
block is kept or dropped by what both directions have seen. The kept blocks are joined by two line breaks.

The labeller is trained when it is needed, on pages that `generated` makes from templates and on at most `FIT_PAGES`
pages of the table (those with the smallest hash of page_id) whose markup says where the article is. The seed is fixed.

A page is read in time and memory in proportion to its length: some 2 KB for each block, be elements nested as deep as
they may. One page must fit into a task like that. Nothing is cut: every block of every page is labelled. null and empty pages, and pages without a kept block, give an
empty text. Repeated rows and a null page_id are handled like others.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.llm.shingles import words
from perfloom.llm.tables import sampled, slices, small_batches

PATH_BUCKETS, WORD_BUCKETS, NUMBERS, HIDDEN, FIT_PAGES, GENERATED, EPOCHS, BATCH, RATE = 2048, 128, 7, 16, 128, 600, 12, 32, 0.012

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>", re.S)
#: A comment or declaration that nothing ends goes on to the page's end.
_OPEN_END = re.compile(r"<[!?].*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no text of the page.
_RAW = frozenset("script style template textarea title".split())
#: Elements that hold text only if they are not shut at once by a slash.
_EMBEDDED = frozenset("noscript iframe svg object canvas audio video math".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open one of the same set, in the same list, table or flow.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Inside a paragraph these end it.
_ENDS_P = _BLOCK - {"button", "label", "option", "select", "legend", "caption", "summary"}


def _bucket(token: str, buckets: int = PATH_BUCKETS) -> int:
    return zlib.crc32(token.encode()) % buckets


#: Elements at which the search for one to end stops.
_BARRIERS = frozenset("article section div main aside nav table form blockquote".split())
#: Parts of a page that are beside the article, wherever they stand.
_BESIDE = frozenset(("nav", "aside", "footer", "form", "header"))


class Path:
    """An open element with those around it: its own tokens, the path above it, its depth, and what `told` asks for."""

    __slots__ = ("above", "beside", "depth", "inside", "tokens")

    def __init__(self, above: Path | None, name: str, tokens: tuple[int, ...]):
        self.above, self.tokens = above, tokens
        self.depth = above.depth + 1 if above else 1
        self.inside = name == "article" or (above is not None and above.inside)
        self.beside = name in _BESIDE or (above is not None and above.beside)


class Block:
    """A block's text, its path (None at the top), and how many of its characters stand in links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: Path | None, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; those without text are left out. Time and memory grow with the page's length only."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    # Where in the stack each name stands.
    where: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = links = 0
    path: Path | None = None
    filled = False

    def flush() -> None:
        nonlocal parts, linked, filled
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path, linked))
            parts, linked, filled = [], 0, False

    def add(text: str) -> None:
        nonlocal path, linked, filled
        if not filled:
            path = stack[-1][1] if stack else None
            filled = not text.isspace()
        parts.append(text)
        if links:
            linked += len(text)

    def pop(to: int) -> None:
        nonlocal links
        for name, _ in stack[to:]:
            links -= name == "a"
            where[name].pop()
        del stack[to:]

    def last(names: frozenset[str] | set[str]) -> int:
        return max((at[-1] for name in names if (at := where.get(name))), default=-1)

    # Behind the last > there is no tag.
    at, n, tags = 0, len(page), page.rfind(">") + 1
    while at < n:
        m = _TAG.search(page, at, tags) if at < tags else _OPEN_END.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m.re is _OPEN_END or page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), at):
            break
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in _BLOCK:
                flush()
            if open_at := where.get(name):
                pop(open_at[-1])
            continue
        if name in _RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at, tags)
                at = end.end() if end else n
            continue
        if name in _EMBEDDED and m[3].rstrip().endswith("/"):
            continue
        if name in _BLOCK:
            flush()
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name in _VOID:
            continue
        if name in _ENDS_P or name in _CLOSES:
            shut = _CLOSES.get(name, {"p"}) | ({"p"} if name in _ENDS_P else set())
            k = last(shut)
            if k >= 0 and k > last(_BARRIERS | _HOLDERS.get(name, set())):
                pop(k)
        tokens = [_bucket(name)]
        if m[3]:
            for a in _ATTRIBUTE.findall(m[3]):
                for t in _TOKEN.findall(a[0] or a[1] or a[2]):
                    tokens.append(_bucket("." + t.lower()))
            if _HIDDEN.search(m[3]):
                tokens.append(_bucket("!hidden"))
        links += name == "a"
        where.setdefault(name, []).append(len(stack))
        stack.append((name, Path(stack[-1][1] if stack else None, name, tuple(tokens))))
    flush()
    return out


class Features:
    """The blocks of some pages as arrays: a tree of their paths with each one's own tokens, shares of word buckets, numbers, and the length of each page."""

    def __init__(self, pages: list[list[Block]]):
        every = [b for p in pages for b in p]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        # Pages repeat their paths, so each different one is there once, behind the one above it. 0 is the top.
        ids: dict[tuple, int] = {}
        above, depth, tokens = [0], [0], [()]
        known: dict[int, int] = {}

        def number(path: Path | None) -> int:
            new = []
            while path is not None and id(path) not in known:
                new.append(path)
                path = path.above
            at = known[id(path)] if path is not None else 0
            for p in reversed(new):
                key = (at, p.tokens)
                if key not in ids:
                    ids[key] = len(above)
                    above.append(at)
                    depth.append(p.depth)
                    tokens.append(p.tokens)
                at = known[id(p)] = ids[key]
            return at

        self.path = np.array([number(b.path) for b in every], np.int64)
        self.above, self.tokens = np.array(above), np.array([t for ts in tokens for t in ts], np.int64)
        self.owner = np.repeat(np.arange(len(above)), [len(ts) for ts in tokens])
        by_depth = np.argsort(depth, kind="stable")
        self.levels = np.split(by_depth, np.flatnonzero(np.diff(np.array(depth)[by_depth])) + 1)[1:]
        hashes, counts = words([b.text.encode() for b in every]) if every else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.buckets, self.counts = (hashes % np.uint64(WORD_BUCKETS)).astype(np.uint8), counts
        size = np.array([len(b.text) for b in every], float)
        marks = np.array([sum(b.text.count(c) for c in ".,;!?") for b in every], float)
        place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages]) if pages else np.zeros(0)
        ones = np.ones(len(every))
        linked = np.array([min(1.0, b.linked / len(b.text)) for b in every])
        depths = np.array([b.path.depth if b.path else 0 for b in every], float)
        self.numbers = np.column_stack([ones, np.log1p(size) / 5, marks / (size + 1) * 10, linked, place, size > 80, depths / 8]).astype(np.float32) if every else np.zeros((0, NUMBERS), np.float32)

    def path_sums(self, table: np.ndarray) -> np.ndarray:
        """For each path the sum of the rows of `table` for all tokens on it."""
        out = np.zeros((len(self.above), table.shape[1]), np.float32)
        np.add.at(out, self.owner, table[self.tokens])
        for level in self.levels:
            out[level] += out[self.above[level]]
        return out

    def path_gradient(self, by_path: np.ndarray) -> np.ndarray:
        """What changes of the paths' sums mean for the rows of the table; `by_path` is used up."""
        for level in reversed(self.levels):
            np.add.at(by_path, self.above[level], by_path[level])
        out = np.zeros((PATH_BUCKETS, by_path.shape[1]), np.float32)
        np.add.at(out, self.tokens, by_path[self.owner])
        return out

    def words(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Some blocks at a time, and the shares of the buckets in their words."""
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        for a in range(0, len(self.counts), 8192):
            b = min(a + 8192, len(self.counts))
            cell = np.repeat(np.arange(b - a), self.counts[a:b]) * WORD_BUCKETS + self.buckets[starts[a] : starts[b]]
            share = np.bincount(cell, minlength=(b - a) * WORD_BUCKETS).reshape(b - a, WORD_BUCKETS).astype(np.float32)
            yield slice(a, b), share / np.maximum(self.counts[a:b], 1)[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over the blocks of a page. Training and labelling run the pages of a batch side by side."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = 8 * HIDDEN  # four gates in each direction
        self.p = {
            "path": rng.normal(0, 0.1, (PATH_BUCKETS, g)), "word": rng.normal(0, 0.02, (WORD_BUCKETS, g)), "number": rng.normal(0, 0.1, (NUMBERS, g)),
            "up": rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)), "out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["number"][0, HIDDEN : 2 * HIDDEN] = self.p["number"][0, 5 * HIDDEN : 6 * HIDDEN] = 1.0  # gates that remember at first

    def _inputs(self, f: Features) -> np.ndarray:
        x = f.path_sums(self.p["path"])[f.path] + f.numbers @ self.p["number"]
        for part, share in f.words():
            x[part] += share @ self.p["word"]
        return x

    @staticmethod
    def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each block in a (step, page) grid for both directions; -1 where a page has ended."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        t = np.arange(int(lengths.max()))[:, None]
        inside = t < lengths[None]
        return np.where(inside, starts + t, -1), np.where(inside, starts + lengths - 1 - t, -1)

    def _run(self, x: np.ndarray, grid: np.ndarray, d: int, keep: bool) -> tuple[np.ndarray, list]:
        h = np.zeros((grid.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out, tape, up = np.zeros((len(x), HIDDEN), np.float32), [], self.p["up"][d]
        for row in grid:
            on = row >= 0
            who = np.flatnonzero(on)
            z = x[row[who], 4 * HIDDEN * d : 4 * HIDDEN * (d + 1)] + h[who] @ up
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, old = h[who], c[who]
            new = f * old + i * u
            t = np.tanh(new)
            c[who], h[who] = new, o * t
            out[row[who]] = h[who]
            if keep:
                tape.append((who, row[who], i, f, o, u, before, old, t))
        return out, tape

    def scores(self, f: Features) -> np.ndarray:
        """For each block the chance that it belongs to the main text."""
        if not f.lengths.sum():
            return np.zeros(0)
        x, grids = self._inputs(f), self._grid(f.lengths)
        h = np.concatenate([self._run(x, grids[d], d, False)[0] for d in (0, 1)], axis=1)
        return _sigmoid(h @ self.p["out"] + self.p["bias"])[:, 0]

    def gradients(self, f: Features, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x, grids = self._inputs(f), self._grid(f.lengths)
        runs = [self._run(x, grids[d], d, True) for d in (0, 1)]
        h = np.concatenate([r[0] for r in runs], axis=1)
        q = _sigmoid(h @ self.p["out"] + self.p["bias"])[:, 0]
        loss = -float(np.mean(np.log(np.where(y > 0.5, q, 1 - q) + 1e-12)))
        e = ((q - y) / len(y))[:, None].astype(np.float32)
        g = {"out": h.T @ e, "bias": e.sum(0), "up": np.zeros_like(self.p["up"])}
        dh_all, dx = e @ self.p["out"].T, np.zeros_like(x)
        for d in (0, 1):
            up, pages = self.p["up"][d], grids[d].shape[1]
            dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
            for who, row, i, f_, o, u, before, old, t in reversed(runs[d][1]):
                a = dh[who] + dh_all[row, HIDDEN * d : HIDDEN * (d + 1)]
                b = dc[who] + a * o * (1 - t * t)
                dz = np.concatenate([b * u * i * (1 - i), b * old * f_ * (1 - f_), a * t * o * (1 - o), b * i * (1 - u * u)], axis=1)
                dx[row, 4 * HIDDEN * d : 4 * HIDDEN * (d + 1)] = dz
                g["up"][d] += before.T @ dz
                dh[who], dc[who] = dz @ up.T, b * f_
        g["number"] = f.numbers.T @ dx
        by_path = np.zeros((len(f.above), dx.shape[1]), np.float32)
        np.add.at(by_path, f.path, dx)
        g["path"] = f.path_gradient(by_path)
        g["word"] = sum(share.T @ dx[part] for part, share in f.words())
        return loss, g


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """Learns from pages of blocks with labels (1: main text), by Adam steps over batches of pages of like length."""
    net, rng, step = Labeller(seed), np.random.default_rng(seed), 0
    pages = [p for p in pages if p[0]]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    batches = []
    for k in range(0, len(order), BATCH):
        part = [pages[i] for i in order[k : k + BATCH]]
        batches.append((Features([p for p, _ in part]), np.array([t for _, y in part for t in y], float)))
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            _, g = net.gradients(*batches[b])
            step += 1
            rate = np.float32(RATE * (1 - epoch / epochs) + 1e-4)
            for k, w in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


_SYLLABLES = "an en er in on re ti es or te is th ha ou de la le mi no ra se ver um zu ch que ion ment".split()
#: Names that builders of pages give to parts beside the main text, by kind, and to the main text.
_NAMES = {
    "menu": "menu nav navbar navigation main-menu breadcrumb breadcrumbs topbar site-nav pagination toc tabs links",
    "header": "header site-header masthead page-header top banner branding logo",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot adbox banner-ad",
    "side": "sidebar side widget related recommended popular trending more-stories see-also rail teaser",
    "notice": "cookie cookie-notice consent notice gdpr alert popup modal newsletter subscribe paywall overlay message disclaimer",
    "form": "search login signup contact-form subscribe-form survey poll",
    "comments": "comments comment comment-list discussion responses replies reader-comments disqus thread user-comments feedback reviews",
    "footer": "footer site-footer bottom copyright legal colophon credits",
    "share": "share social social-share tags buttons toolbar print follow",
}
_MAIN = "content article post entry post-content article-body story main-content text body-text entry-content page-content markdown prose"


def generated(count: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of many kinds, with a label for each block: 1 for the main text."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))

    def text(a: int, b: int) -> str:
        out = [word() + ("." if chance(0.1) else "," if chance(0.06) else "") for _ in range(int(rng.integers(a, b + 1)))]
        return (" ".join(out).capitalize() + pick(["", ".", "."])) or "X"

    def named(names: str) -> str:
        if chance(0.12):
            return f' class="{word()}{int(rng.integers(99))}"' if chance(0.7) else ""
        return f' {pick(["class", "class", "id"])}="{pick(names.split())}{pick(["", "", " " + word(), "-" + word(), str(int(rng.integers(9)))])}"'

    made = []
    for _ in range(count):
        out: list[str] = []
        labels: list[int] = []

        def block(tag: str, body: str, label: int, out=out, labels=labels) -> None:
            out.append(f"<{tag}>{body}" + (f"</{tag.split()[0]}>" if chance(0.9) or tag not in ("p", "li") else ""))
            labels.append(label)

        def items(label: int, link: bool, n: int) -> None:
            out.append("<ul>")
            for _ in range(n):
                t = text(1, 3) if link else text(2, 25)
                block("li", f'<a href="/{word()}">{t}</a>' if link else t, label)
            out.append("</ul>")

        def beside(kind: str) -> None:
            tag = {"menu": "nav", "header": "header", "side": "aside", "footer": "footer", "form": "form", "comments": "section"}.get(kind, "div")
            own = chance(0.6) and tag not in ("div", "section")
            tag = tag if own or kind in ("comments", "form") else "div"
            out.append(f"<{tag}{named(_NAMES[kind]) if not own or chance(0.4) else ''}>")
            if kind == "menu" or (kind in ("side", "footer") and chance(0.4)):
                items(0, True, int(rng.integers(1, 9)))
            elif kind == "comments":
                if chance(0.7):
                    block("h3", text(1, 3), 0)
                for _ in range(int(rng.integers(1, 6))):
                    out.append(f"<div{named(_NAMES['comments'])}>")
                    if chance(0.4):
                        block("span", text(1, 2), 0)
                        out.append("<div>")
                        block("p", text(3, 60), 0)
                        out.append("</div>")
                    else:
                        block("p", text(3, 60), 0)
                    out.append("</div>")
            elif kind == "form":
                block("label", text(1, 4), 0)
                out.append("<input>")
                block("button", text(1, 2), 0)
            else:
                if chance(0.4):
                    block(pick(["h2", "h3", "h4", "div"]), text(1, 6), 0)
                for _ in range(int(rng.integers(1, 3))):
                    if chance(0.5):
                        block("p", pick(["", "&copy; "]) + text(2, 40), 0)
                    else:
                        out.append("<div>")
                        block("span", text(2, 30), 0)
                        out.append("</div>")
            out.append(f"</{tag}>")

        def main() -> None:
            tag = pick(["article", "article", "article", "main", "div", "section"])
            outer = chance(0.4)
            if outer:
                out.append(f"<{pick(['main', 'div', 'section'])}{named(_MAIN)}>")
            out.append(f"<{tag}{named(_MAIN) if tag in ('div', 'section') or chance(0.4) else ''}>")
            inner = chance(0.2)
            if inner:
                out.append(f"<div{named(_MAIN)}>")
            if chance(0.9):
                block("h1", text(2, 14), 1)
            for _ in range(int(rng.integers(1, 16))):
                r = rng.random()
                if r < 0.68:
                    body = text(1, 5) if chance(0.15) else text(8, 120)
                    block("p", f"<b>{body}<br>" if chance(0.1) else f"{body} <a href='/x'>{text(1, 3)}</a> {text(1, 9)}" if chance(0.2) else body, 1)
                elif r < 0.78:
                    block(pick(["h2", "h3", "h4"]), text(1, 8), 1)
                elif r < 0.84:
                    items(1, False, int(rng.integers(2, 6)))
                elif r < 0.88:
                    block(pick(["blockquote", "pre", "figcaption"]), text(4, 40), 1)
                elif r < 0.91:
                    out.append("<table><tr>")
                    for _ in range(int(rng.integers(2, 5))):
                        block("td", text(1, 4), 1)
                    out.append("</tr></table>")
                else:
                    beside(pick(["advert", "share", "side", "notice", "form", "menu"]))
            if inner:
                out.append("</div>")
            if chance(0.25):
                beside(pick(["comments", "share", "comments"]))
            out.append(f"</{tag}>")
            if outer and chance(0.5):
                beside(pick(["comments", "side", "share"]))
            if outer:
                out.append("</div></section></main>")

        for k in ("notice", "header", "menu", "advert", "side", "form", "share"):
            if chance(0.45):
                beside(k)
        main()
        for k in ("share", "comments", "side", "advert", "form", "notice", "menu"):
            if chance(0.35):
                beside(k)
        if chance(0.85):
            beside("footer")
        made.append((f"<html><head><title>x</title></head><body>{''.join(out)}</body></html>", labels))
    return made


def told(found: list[Block]) -> list[int] | None:
    """Labels of a page's blocks by its markup, where that has one plain article; otherwise None."""
    inside = [b.path is not None and b.path.inside and not b.path.beside for b in found]
    return [int(x) for x in inside] if any(inside) and not all(inside) else None


def fitted(pages: DataFrame, fit_pages: int = FIT_PAGES, count: int = GENERATED) -> Labeller:
    # Ids are chosen first, so that only the pages to learn from reach the driver.
    held = pages.where("html is not null and page_id is not null").select("page_id", "html")
    ids = F.broadcast(sampled(held.select("page_id"), fit_pages, "page_id").distinct())
    rows = held.join(ids, "page_id", "left_semi").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(fit_pages).collect()
    real = [r["html"] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        learn = [(blocks(page), labels) for page, labels in generated(count)]
        learn += [(found, labels) for found in map(blocks, real) if (labels := told(found)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(learn))], pa.binary())], ["net"])

    # In a task, where numpy keeps to the cores that the task has.
    return pickle.loads(pages.sparkSession.range(1, numPartitions=1).mapInArrow(run, "net binary").first()["net"])


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    keep, at, out = net.scores(Features(found)) >= 0.5, 0, []
    for bs in found:
        out.append("\n\n".join(b.text for b, k in zip(bs, keep[at : at + len(bs)], strict=True) if k))
        at += len(bs)
    return out


def extract(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html). Rows are not shuffled."""
    small_batches(pages.sparkSession)
    raw = pickle.dumps(fitted(pages, fit_pages))
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(raw)
        for batch, texts in slices(batches, 2):
            got = main_texts([t.decode() for t in texts], net)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("page_id", "url", "cast(html as binary) html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
