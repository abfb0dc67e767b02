"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of blocks: the text between two tags that are not
inline; scripts, styles, form fields and what browsers never show (head, template, iframe)
are left out, fallbacks, formulas and drawings stay.  Reading a page takes time and memory
in proportion to its length, however its tags are nested or broken: a block points to
its innermost element, elements to their parents, with the sum of their path's signs.  Each block has a
vector: hashed signs of its tag path (tags, class and id words), hashed signs of
its words, and a few rates.  A bidirectional LSTM in numpy reads the whole
sequence, so that every block is judged in the context of the document, and
labels it main text or not.

The network is trained, once a process, on ``PAGES`` generated pages of many
layouts whose blocks are known; no page of the input takes part.

Rules: null and empty pages give an empty text; white space (as Unicode has it)
inside a block becomes one space; <br> is white space; blocks without text are
dropped; repeated rows are extracted each; broken markup is read as browsers
do: unknown end tags are ignored, open elements end with their parent.
"""

from __future__ import annotations

import functools
import html as htmllib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, Words

PATH, WORD, RATES, HIDDEN, PAGES = 64, 24, 8, 24, 1200
INPUT = PATH + WORD + RATES
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del noscript object "
    "svg g text tspan path rect circle line use math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
UNSEEN = frozenset("head script style template iframe select datalist textarea title annotation".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "option": ("option", ("select",))}
_MARKUP = r"<!--.*?(?:-->|$)|{cdata}<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>"
_TAG = re.compile(_MARKUP.format(cdata=r"<!\[CDATA\[(?P<cdata>.*?)\]\]>|"), re.S)
#: Where no section ends any more, so that none is looked for.
_PLAIN_TAG = re.compile(_MARKUP.format(cdata=""), re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Element:
    """An open element: the last two marks of its path, how many there are, and the sum of their signs."""

    __slots__ = ("marks", "size", "tail", "_sum", "parent")

    def __init__(self, parent: Element | None, marks: list[str]):
        self.parent, self.marks, self._sum = parent, marks, None
        self.size = len(marks) + (parent.size if parent else 0)
        self.tail = (*(parent.tail if parent else ()), *marks)[-2:]

    def sum(self) -> np.ndarray:
        """Signs of all marks from the root on; each element's own are added to its parent's once."""
        above: list[Element] = []
        node: Element | None = self
        while node is not None and node._sum is None:
            above.append(node)
            node = node.parent
        for e in reversed(above):
            e._sum = e.parent._sum.copy() if e.parent else np.zeros(PATH)
            for mark in e.marks:
                j, sign = _place(mark, 0)
                e._sum[j] += sign
        return self._sum


class Stack:
    """Open elements, and for each name the places where it is open: the nearest one is found without a search."""

    def __init__(self):
        self.names: list[str] = []
        self.elements: list[Element] = []
        self.open: dict[str, list[int]] = {}
        #: places of elements that are not inline
        self.outer: list[int] = []
        self.unseen = self.links = 0

    def push(self, name: str, marks: list[str]) -> None:
        self.open.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.outer.append(len(self.names))
        self.names.append(name)
        self.elements.append(Element(self.elements[-1] if self.elements else None, marks))
        self.unseen += name in UNSEEN
        self.links += name == "a"

    def nearest(self, names: tuple[str, ...]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def pop(self, to: int) -> None:
        while len(self.names) > to:
            name = self.names.pop()
            self.elements.pop()
            self.open[name].pop()
            if name not in INLINE:
                self.outer.pop()
            self.unseen -= name in UNSEEN
            self.links -= name == "a"

    def end(self, name: str) -> None:
        """An end tag: an inline one closes nothing beyond the element around it, any other what is open of its name."""
        at = self.nearest((name,))
        if at >= 0 and (name not in INLINE or not self.outer or at > self.outer[-1]):
            self.pop(at)

    def imply(self, name: str) -> None:
        """What a start tag ends by itself: an open paragraph, or its sibling in the same list, row or table."""
        if name in _CLOSES:
            target, stop = _CLOSES[name]
            targets = (target, name)
        elif name in ENDS_P:
            targets, stop = ("p",), ("button", "td", "th", "table")
        else:
            return
        at = self.nearest(targets)
        if at > self.nearest(stop) or at >= 0 and self.names[at] in stop:
            self.pop(at)


def blocks(page: str) -> list[tuple[str, Element | None, float]]:
    """(text, innermost element, share of text in links) of each block in page order."""
    out: list[tuple[str, Element | None, float]] = []
    stack, parts, linked = Stack(), [], 0
    last, last_section = page.rfind(">"), page.rfind("]]>")

    def add(raw: str) -> int:
        if not raw or stack.unseen:
            return 0
        parts.append(htmllib.unescape(raw))
        return len(parts[-1]) if stack.links else 0

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, stack.elements[-1] if stack.elements else None, min(1.0, linked / len(text))))
        parts.clear()

    at, end = 0, len(page)
    while at < end:
        # behind the last bracket no tag ends; a comment may run to the end of the page
        m = (_TAG if at <= last_section else _PLAIN_TAG).search(page, at) if at <= last else None
        if not m:
            comment = page.find("<!--", at)
            linked += add(page[at : comment if comment >= 0 else end])
            break
        linked += add(page[at : m.start()])
        at = m.end()
        found = m.groupdict()
        linked += add(found.get("cdata") or "")
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            close()
            linked = 0
        if m["end"] or m["end2"]:
            stack.end(name)
            continue
        stack.imply(name)
        if name in VOID or (m["rest"] or "").endswith("/") and inline:
            continue
        if name in RAW:
            closing = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        marks = [name]
        if m["rest"]:
            for kind, *value in _NAMES.findall(m["rest"]):
                marks += [f"{kind[0].lower()}:{x}" for x in _PART.findall("".join(value).lower())]
        stack.push(name, marks)
    close()
    return out


@functools.lru_cache(maxsize=20_000)
def _place(mark: str, deep: int) -> tuple[int, float]:
    h = zlib.crc32(f"{mark}/{deep}".encode())
    return h % PATH, 1.0 if h >> 16 & 1 else -1.0


def vectors(page: list[tuple[str, Element | None, float]]) -> np.ndarray:
    """One input vector per block of a page."""
    n = len(page)
    out = np.zeros((n, INPUT))
    if not n:
        return out
    words = Words(pa.array([t for t, _, _ in page], pa.string()), lower=True)
    row = words.row
    sign = np.where(words.hash >> U64(32) & U64(1), 1.0, -1.0)
    np.add.at(out, (row, PATH + (words.hash % U64(WORD)).astype(np.int64)), sign)
    out[:, PATH : PATH + WORD] /= np.sqrt(np.maximum(words.count, 1))[:, None]
    # one word repeated is no more than a few
    out[:, PATH : PATH + WORD] = np.clip(out[:, PATH : PATH + WORD], -2, 2) / 2
    for i, (text, element, linked) in enumerate(page):
        if element:
            out[i, :PATH] += element.sum()
            for k, mark in enumerate(reversed(element.tail), 1):
                j, s = _place(mark, k)
                out[i, j] += s
        size = len(text)
        out[i, PATH + WORD :] = (np.log1p(size) / 6, linked, text[-1] in ".!?:", np.log1p(words.count[i]) / 4, i / n, sum(map(text.count, ".,;")) / size * 10, "©" in text or "·" in text, 1.0)
    return out


class Labeller:
    """Bidirectional LSTM with one logistic output per step."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"{d}x"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
            self.p[f"{d}h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.p[f"{d}c"] = np.zeros(4 * HIDDEN)
            self.p[f"{d}c"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.p["o"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN)
        self.p["oc"] = np.zeros(1)

    def run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = True):
        """Hidden states [T, B, H] of one direction, with what the gradient needs if that is to be kept."""
        steps, size, _ = x.shape
        pre = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        h, c = np.zeros((size, HIDDEN)), np.zeros((size, HIDDEN))
        out, kept = np.zeros((steps, size, HIDDEN)), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"{d}h"]
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -40, 40)))
            i, f, o, g = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            top = np.tanh(new)
            on = mask[t][:, None]
            if keep:
                kept[t] = (h, c, i, f, o, g, top, on)
            h, c = np.where(on, o * top, h), np.where(on, new, c)
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(d, x, mask, keep=False)[0] for d in "fb"], axis=2) @ self.p["o"] + self.p["oc"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        steps = len(x)
        runs = {d: self.run(d, x, mask) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        d_out = (1 / (1 + np.exp(-(both @ self.p["o"] + self.p["oc"]))) - y) * mask / mask.sum()
        grad = {"o": np.einsum("tb,tbh->h", d_out, both), "oc": d_out.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            d_h = d_out[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            d_z = np.zeros((steps, x.shape[1], 4 * HIDDEN))
            back_h, back_c = np.zeros_like(d_h[0]), np.zeros_like(d_h[0])
            grad[f"{d}h"] = np.zeros_like(self.p[f"{d}h"])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, c, i, f, o, g, top, on = runs[d][1][t]
                gh = d_h[t] + back_h
                gc = back_c + np.where(on, gh * o * (1 - top**2), 0)
                z = np.concatenate([gc * g * i * (1 - i), gc * c * f * (1 - f), gh * top * o * (1 - o), gc * i * (1 - g**2)], axis=1) * on
                d_z[t] = z
                grad[f"{d}h"] += h.T @ z
                back_h = np.where(on, z @ self.p[f"{d}h"].T, gh)
                back_c = np.where(on, gc * f, back_c)
            grad[f"{d}x"] = np.einsum("tbi,tbz->iz", x, d_z)
            grad[f"{d}c"] = d_z.sum(axis=(0, 1))
        return grad

    def label(self, pages: list[np.ndarray], most: int = 64, steps: int = 1 << 15) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of alike length go together, ``most`` or so many that they have ``steps`` in all."""
        order = [k for k in sorted(range(len(pages)), key=lambda k: -len(pages[k])) if len(pages[k])]
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        while order:
            n = max(1, min(most, steps // len(pages[order[0]])))
            own, order = order[:n], order[n:]
            got = self.logits(*padded([pages[k] for k in own])[:2]) > 0
            for b, k in enumerate(own):
                out[k] = got[: len(pages[k]), b]
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), INPUT))
    mask, y = np.zeros((longest, len(pages)), dtype=bool), np.zeros((longest, len(pages)))
    for b, page in enumerate(pages):
        x[: len(page), b], mask[: len(page), b] = page, True
        if labels is not None:
            y[: len(page), b] = labels[b]
    return x, mask, y


MAIN, OTHER = "\ue000", "\ue001"  # private marks: the first character of every generated text
_SYLLABLES = "an the er in on ou re ti es or nt ea ed ing st he at th ble ly ion aux que ment lle ch ge un der en pf ie os ci ar do ga mi ra ta lo be va su ko".split()
_BOXES = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry"', 'section class="story"', 'div class="article-text"', 'div role="main"', 'article class="post"']
_SIDES = {"aside": [""], "div": ["sidebar", "widget", "related", "ad", "ads", "advert", "banner", "promo", "sponsored", "cookie notice", "notice", "gdpr consent", "newsletter", "share social", "breadcrumbs", "pagination", "menu", "navigation", "popup modal", "alert"], "section": ["comments", "related", "sidebar"], "nav": [""], "form": ["", "search", "subscribe"]}


def generated(rng: random.Random) -> str:
    """A page whose texts begin with MAIN or OTHER."""

    def words(low: int, high: int) -> str:
        made = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        for k in range(len(made)):
            made[k] += rng.choice(["", "", "", "", "", ",", "."]) if k + 1 < len(made) else rng.choice([".", ".", ".", ""])
        made[0] = made[0].capitalize()
        if rng.random() < 0.04:
            made = made[:1] * len(made)
        if rng.random() < 0.08:
            made = [w + rng.choice(["###", "!!", "***", "%%%", "$$$", "&amp;"]) for w in made]
        return rng.choice([" | ", ", "]).join(made) if rng.random() < 0.04 else " ".join(made)

    def prose(mark: str) -> str:
        text = mark + words(*rng.choice([(1, 3), (5, 20), (20, 60), (60, 200)]))
        if rng.random() < 0.15:
            text = f"<{rng.choice(['b', 'em', 'i', 'span'])}>{text}"
        return text + "<br>" * (rng.random() < 0.1)

    def links(tag: str, n: int) -> str:
        return "".join(f'<{tag}><a href="/x">{OTHER}{words(1, 3)}</a></{tag}>' for _ in range(n))

    def noise() -> str:
        tag = rng.choice(list(_SIDES))
        name = rng.choice(_SIDES[tag])
        attrs = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        if tag == "nav" or rng.random() < 0.25:
            inner = f"<ul>{links('li', rng.randint(2, 9))}</ul>"
        elif tag == "form":
            inner = f"<label>{OTHER}{words(1, 3)}</label><input><button>{OTHER}{words(1, 2)}</button>"
        elif name == "comments":
            inner = f"<h3>{OTHER}{words(1, 3)}</h3>" + "".join(f'<div class="comment"><p>{OTHER}{words(3, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
        else:
            body = [OTHER + words(1, 25) for _ in range(rng.randint(1, 3))]
            inner = body[0] if rng.random() < 0.5 else "".join(f"<p>{b}</p>" for b in body)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def article() -> str:
        out = [f"<h1>{MAIN}{words(2, 12)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 40])):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{prose(MAIN)}" + "</p>" * (rng.random() < 0.85))
            elif kind < 0.8:
                out.append(f"<h{rng.choice('234')}>{MAIN}{words(1, 8)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{MAIN}{words(1, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{prose(MAIN)}</blockquote>")
            elif kind < 0.93:
                out.append("<table><tr>" + "".join(f"<td>{MAIN}{words(1, 4)}</td>" for _ in range(rng.randint(2, 6))) + "</tr></table>")
            elif kind < 0.95:
                out.append(f"<noscript>{rng.choice(['', '<p>'])}{prose(MAIN)}</noscript>")
            else:
                out.append(noise())
        box = rng.choice(boxes)
        return f"<{box}>{''.join(out)}</{box.split()[0]}>" if box else "".join(out)

    def bare() -> str:
        """A page that has its text and nothing else."""
        tag = rng.choice(["p", "p", "p", "div", "section", ""])
        out = [f"<h1>{MAIN}{words(2, 12)}</h1>"] if rng.random() < 0.3 else []
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3, 6])):
            text = MAIN + words(*rng.choice([(1, 3), (5, 30), (20, 60)]))
            out.append(f"<{tag}>{text}" + f"</{tag}>" * (rng.random() < 0.7) if tag else f"{text}<hr>")
        if len(out) > 1 and rng.random() < 0.2:
            out.append(out[-1])
        text = "".join(out)
        if rng.random() < 0.3:
            text = f"<div>{text}</div>"
        return rng.choice(["<html><body>{}</body></html>", "<!DOCTYPE html><html><head><title>t</title></head><body>{}</body></html>", "{}"]).format(text)

    def cells() -> str:
        """A page laid out as a table: a menu, the text, perhaps a column of other things."""
        n = rng.randint(2, 8)
        if rng.random() < 0.5:
            menu = links("li", n).join(("<ul>", "</ul>"))
        else:
            menu = rng.choice(["<br>", "<p>", " | ", "<div>"]).join(f'<a href="/x">{OTHER}{words(1, 3)}</a>' for _ in range(n))
        row = [f"<td>{menu}</td>", f"<td>{article()}</td>"] + [f"<td>{OTHER}{words(1, 12)}</td>"] * (rng.random() < 0.3)
        rows = [f"<tr>{''.join(row)}</tr>"]
        if rng.random() < 0.5:
            rows = [f'<tr><td colspan="2">{menu}</td></tr>', f"<tr><td>{article()}</td></tr>"]
        if rng.random() < 0.6:
            rows.append(f"<tr><td>{OTHER}&copy; {words(1, 8)}</td></tr>")
        return f"<html><body><table>{''.join(rows)}</table></body></html>"

    boxes, layout = _BOXES, rng.random()
    if layout < 0.1:
        return bare()
    if layout < 0.16:
        boxes = ["", "", "div"]
        return cells()
    if layout < 0.22:  # nothing but divisions
        boxes = ["", "div"]
        top = " ".join(f'<a href="/x">{OTHER}{words(1, 3)}</a>' for _ in range(rng.randint(2, 8)))
        tail = f"<div>{OTHER}&copy; {words(1, 8)}</div>" * (rng.random() < 0.7)
        return f"<html><body><div>{top}</div>{article()}{tail}</body></html>"
    head = [f"<header>{OTHER}{words(1, 4)}</header>"] if rng.random() < 0.4 else []
    if rng.random() < 0.85:
        head.append(f"<nav><ul>{links('li', rng.randint(2, 8))}</ul></nav>")
    head += [noise() for _ in range(rng.choice([0, 1, 1, 2]))]
    tail = [noise() for _ in range(rng.choice([0, 0, 1, 2]))]
    if rng.random() < 0.85:
        foot = rng.choice(["<footer>", '<div class="footer">', '<div id="footer">'])
        tail.append(f"{foot}{OTHER}&copy; {words(1, 2)} &middot; {words(1, 12)}</{foot[1:].split()[0].strip('>')}>")
    body = "".join([*head, article(), *tail])
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["wrapper", "page", "container"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = 14, size: int = 25, seed: int = 7) -> Labeller:
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        made = blocks(generated(rng))
        clean = [(t.replace(MAIN, "").replace(OTHER, "").strip() or "-", p, a) for t, p, a in made]
        given = vectors(clean)
        if rng.random() < 0.4:  # some pages by their tags alone
            given[:, PATH : PATH + WORD] = 0
        data.append((given, np.array([MAIN in t for t, _, _ in made], dtype=float)))
    model = Labeller(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    data.sort(key=lambda d: len(d[0]))
    batches = [padded([x for x, _ in data[a : a + size]], [y for _, y in data[a : a + size]]) for a in range(0, len(data), size)]
    for epoch in range(epochs):
        rng.shuffle(batches)
        for x, mask, y in batches:
            step += 1
            for k, g in model.gradient(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                rate = 0.02 * 0.5 ** (epoch / 4)
                model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def extract(model: Labeller, pages: list[str | None]) -> list[str]:
    given = [blocks(p or "") for p in pages]
    keep = model.label([vectors(g) for g in given])
    return ["\n".join(t for (t, _, _), k in zip(g, ks, strict=True) if k) for g, ks in zip(given, keep, strict=True)]


def main_text(pages: DataFrame, column: str = "html", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    model = model or trained()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = extract(model, batch.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), column).mapInArrow(of, "page_id long, url string, text string, n_chars long")
