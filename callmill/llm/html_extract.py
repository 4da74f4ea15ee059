"""The main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read as a tree of elements; a leaf block is the text between two
borders of block elements.  Each block gets features of its ancestors' tags,
roles and class words, of the nearest ancestor that says something, and of its
text (length, share of links, marks; no words, so no language).  Neighbouring
blocks tend to belong together, which the field's transitions learn.  It is
trained in numpy on labelled pages and decoded page by page by Viterbi's
algorithm.

``made_pages`` builds labelled pages of many layouts from word lists; callers
can bring their own.  Training is bounded by ``PAGES`` pages; every page of a
table is read whole.

Tags, comments, declarations and the contents of ``RAW`` elements are no text;
a tag or comment that is never closed takes the rest of the page with it, as in
browsers.  Reading takes time in proportion to the page, however deep its
elements lie.  White space of any kind inside a block becomes one space, and
so does a line break element.  Null, empty and textless pages give an empty
text.  Repeated rows give equal results, an empty table an empty one, and other
columns pass through whatever their names, but for those that the result adds.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_python_columns

# ---- Fixed values: names of HTML elements, and words that their class names are made of.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript noembed noframes xmp".split())
HIDDEN = set("template svg object head".split())
HEAD_TAGS = set("base link meta".split()) | RAW | HIDDEN
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
SAYING = set("address article aside button details dialog fieldset figcaption figure footer form header main menu nav search section select h1".split())
ROLES = set("alert banner complementary contentinfo dialog form main navigation search article menu toolbar".split())
CONTENT_WORDS = "article content post entry story body text main page blog news single hentry".split()
LAYOUT_WORDS = "container wrapper row col column inner outer section block box grid site layout left right top first last clearfix".split()
OTHER_WORDS = {
    "menu": "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager pages toc tabs links skip".split(),
    "header": "header masthead topbar logo brand branding tagline slogan title".split(),
    "footer": "footer copyright colophon legal bottom imprint credits foot".split(),
    "sidebar": "sidebar widget widgets related recommended popular trending teaser teasers more secondary recent archive categories tags rail".split(),
    "notice": "notice cookie cookies consent alert gdpr privacy message popup modal overlay paywall disclaimer warning announcement banner toast".split(),
    "advert": "ad ads adv advert advertisement adverts adsense adslot sponsor sponsored promo promotion banner commercial partner".split(),
    "form": "form newsletter subscribe subscription signup search login contact register feedback poll survey".split(),
    "comments": "comment comments commentlist reply replies discussion responses respond disqus guestbook thread reader feedback".split(),
    "share": "share social sharing buttons follow tools toolbar print like".split(),
}
# ---- end of the fixed values

WORDS = set(CONTENT_WORDS) | set(LAYOUT_WORDS) | {w for ws in OTHER_WORDS.values() for w in ws}
#: An element ends where one of these begins, unless an element of the third kind lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}
CELLS = {"td", "th", "caption"}
TABLE = {"table", "tbody", "thead", "tfoot", "tr"}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|(?=[^\s"'])))*+)>""")
_OPENS = re.compile(r"<(?:/?[A-Za-z]|[!?/])")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass(slots=True)
class Block:
    text: str
    around: frozenset[str]  # of all ancestors
    nearest: frozenset[str]  # of the nearest one that has any
    leaf: str
    linked: int  # characters inside links


@functools.lru_cache(8192)
def says(tag: str, attributes: str) -> frozenset[str]:
    """What an element tells by its name, role, class, id and being hidden."""
    out = {f"t={tag}"} if tag in SAYING else set()
    if attributes and tag not in ("html", "body"):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        named = f"{found.get('class', '')} {found.get('id', '')}"
        out |= {f"k={w}" for w in map(str.lower, _CLASS_WORD.findall(html.unescape(named))) if w in WORDS}
        if (role := found.get("role", "").lower()) in ROLES:
            out.add(f"r={role}")
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            out.add("hidden")
    return frozenset(out)


class _Reader:
    def __init__(self):
        self.blocks: list[Block] = []
        # open block elements: tag, features around, nearest features
        self.stack: list[tuple[str, frozenset, frozenset]] = [("", frozenset(), frozenset())]
        self.open: list[dict[str, int]] = [{}]  # counts of open elements, anew inside each cell
        self.hidden = 0
        self.link = 0  # the stack's size where the open link began
        self.parts: list[str] = []
        self.linked = 0

    def text(self, data: str) -> None:
        if self.hidden or not data:
            return
        if "&" in data:
            data = html.unescape(data)
        self.parts.append(data)
        if self.link:
            self.linked += len(data)

    def border(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, around, nearest = self.stack[-1]
                self.blocks.append(Block(text, around, nearest, tag, self.linked))
            self.parts, self.linked = [], 0

    def push(self, tag: str, attributes: str) -> None:
        _, around, nearest = self.stack[-1]
        own = says(tag, attributes)
        if own:
            around, nearest = around if own <= around else around | own, own
        if tag in CELLS:
            self.open.append({})
        self.open[-1][tag] = self.open[-1].get(tag, 0) + 1
        self.stack.append((tag, around, nearest))
        self.hidden += tag in HIDDEN

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[-1][tag] -= 1
        if tag in CELLS:
            self.open.pop()
        self.hidden -= tag in HIDDEN
        if self.link > len(self.stack):
            self.link = 0
        return tag

    def close_to(self, tags: set[str]) -> None:
        while self.pop() not in tags:
            pass

    def is_open(self, tag: str) -> bool:
        return any(o.get(tag) for o in (self.open[-1:] if tag not in TABLE else self.open[-2:]))

    def start(self, tag: str, attributes: str) -> None:
        if self.hidden and self.stack[-1][0] == "head" and tag not in HEAD_TAGS:
            self.pop()
        if tag == "a":
            self.link = len(self.stack)
        elif tag == "br":
            self.text(" ")
        elif tag in BLOCK:
            self.border()
            if self.stack[-1][0] == "p":
                self.pop()
            ends, within = IMPLIED.get(tag, ((), ()))
            if any(self.is_open(t) for t in ends) or (tag in CELLS and self.stack[-1][0] not in TABLE and len(self.open) > 1):
                at = len(self.stack) - 1
                while at and self.stack[at][0] not in within and self.stack[at][0] not in ends:
                    at -= 1
                if self.stack[at][0] in ends:
                    while len(self.stack) > at:
                        self.pop()
            if tag not in VOID:
                self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag in BLOCK:
            self.border()
            if self.is_open(tag):
                self.close_to({tag})


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of text of a page, in order."""
    page, out, at = page or "", _Reader(), 0
    while at < len(page):
        m = _OPENS.search(page, at)
        if m is None:
            out.text(page[at:])
            break
        out.text(page[at : m.start()])
        at = m.start()
        if m.group()[-1] in "!?/":
            mark = "-->" if page.startswith("<!--", at) else ">"
            # the shortest comments are <!--> and <!--->
            end = page.find(mark, at + 2) if mark == "-->" else page.find(mark, at)
            at = len(page) if end < 0 else end + len(mark)
            continue
        tag = _TAG.match(page, at)
        if tag is None:
            break
        closing, name, attributes = tag.groups()
        name, at = name.lower(), tag.end()
        if closing:
            out.end(name)
        else:
            out.start(name, attributes)
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                at = len(page) if end is None else end.start()
    out.border()
    return out.blocks


# ---- features

def features(blocks: list[Block]) -> list[tuple[frozenset, frozenset, tuple[str, ...]]]:
    """Of each block: what its ancestors say, what the nearest says, and the rest."""
    out = []
    for i, b in enumerate(blocks):
        n, share = len(b.text), b.linked / len(b.text)
        size = "1" if n < 12 else "2" if n < 40 else "3" if n < 120 else "4"
        link = "0" if share == 0 else "1" if share < 0.34 else "2" if share < 0.8 else "3"
        own = [f"leaf={b.leaf}", f"size={size}", f"link={link}", f"size+link={size}{link}"]
        if b.text[-1] in ".!?:…。！？\"'»”)":
            own.append("ends")
        if "©" in b.text:
            own.append("copyright")
        if re.search(r"[|·»›•]", b.text):
            own.append("marks")
        if "," in b.text or "、" in b.text:
            own.append("comma")
        if i == 0 or i == len(blocks) - 1:
            own.append("first" if i == 0 else "last")
        out.append((b.around, b.nearest, tuple(own)))
    return out


def _names(found: tuple[frozenset, frozenset, tuple[str, ...]]) -> Iterable[str]:
    around, nearest, own = found
    yield from around
    yield from (f"nearest:{x}" for x in nearest)
    yield from own
    if not nearest:
        yield "nothing near"


# ---- the field

@dataclass
class Field:
    """Weights of the two labels (other, main): of features for main, of neighbouring labels, and of the first label."""

    weights: dict[str, float]
    step: np.ndarray
    first: np.ndarray

    def main(self, blocks: list[Block]) -> list[bool]:
        """Viterbi's labels: whether each block belongs to the main text."""
        if not blocks:
            return []
        known: dict[frozenset, float] = {}
        w = self.weights.get
        near: dict[frozenset, float] = {}
        (oo, om), (mo, mm) = self.step.tolist()
        back: list[tuple[bool, bool]] = []
        other = main = 0.0
        for i, (around, nearest, own) in enumerate(features(blocks)):
            if around not in known:
                known[around] = sum(w(x, 0.0) for x in sorted(around))
            if nearest not in near:
                near[nearest] = sum(w(f"nearest:{x}", 0.0) for x in sorted(nearest)) if nearest else w("nothing near", 0.0)
            s = known[around] + near[nearest] + sum(w(x, 0.0) for x in own) + w("bias", 0.0)
            if i == 0:
                other, main = float(self.first[0]), float(self.first[1]) + s
                continue
            from_main, stays = main + mo > other + oo, main + mm >= other + om
            other, main = max(other + oo, main + mo), max(other + om, main + mm) + s
            back.append((from_main, stays))
        label = main >= other
        out = [label]
        for from_main, stays in reversed(back):
            label = stays if label else from_main
            out.append(label)
        return out[::-1]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, kept in zip(blocks, self.main(blocks), strict=True) if kept)


PAGES, SEED, STEPS, RIDGE = 900, 13, 160, 0.1


def likelihood(score: np.ndarray, step: np.ndarray, first: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of padded sequences (page, place): marginals of main, sums of expected neighbours, and the sum of log partition functions."""
    n, m = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    ahead, behind = np.zeros((n, m, 2)), np.zeros((n, m, 2))
    ahead[:, 0] = first + emit[:, 0]
    for t in range(1, m):
        moved = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + emit[:, t]
        ahead[:, t] = np.where(real[:, t, None], moved, ahead[:, t - 1])
    for t in range(m - 2, -1, -1):
        nxt = emit[:, t + 1] + behind[:, t + 1]
        moved = np.logaddexp(step[:, 0] + nxt[:, 0, None], step[:, 1] + nxt[:, 1, None])
        behind[:, t] = np.where(real[:, t + 1, None], moved, behind[:, t + 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    marginal = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]) * real
    both = np.exp(ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
    return marginal, both.sum(axis=(0, 1)), float(total.sum())


def train(pages: list[tuple[str, list[str]]]) -> Field:
    """A field from labelled pages: HTML, and the texts of the blocks that belong to the main text."""
    found = [(b, set(t)) for page, t in pages if (b := leaf_blocks(page))]
    if not found:
        raise ValueError("labelled pages with text are needed")
    named = [[{"bias", *_names(f)} for f in features(b)] for b, _ in found]
    vocabulary = {x: i for i, x in enumerate(sorted({x for page in named for b in page for x in b}))}
    n, m = len(found), max(map(len, named))
    real, y = np.zeros((n, m), bool), np.zeros((n, m))
    col: list[list[int]] = []
    for i, ((blocks, main), names) in enumerate(zip(found, named, strict=True)):
        for t, (b, f) in enumerate(zip(blocks, names, strict=True)):
            real[i, t], y[i, t] = True, b.text in main
            col.append(sorted(vocabulary[k] for k in f))
    row, col = np.repeat(np.arange(len(col)), list(map(len, col))), np.concatenate(col)
    sums = lambda label: np.bincount(col, label[row], len(vocabulary))  # noqa: E731  of each feature's blocks
    wanted = sums(y[real])
    pairs = np.array([[((1 - y[:, :-1] if a == 0 else y[:, :-1]) * (1 - y[:, 1:] if b == 0 else y[:, 1:]) * real[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])
    starts = np.array([n - y[:, 0].sum(), y[:, 0].sum()])
    v = np.zeros(len(vocabulary) + 6)
    mean, square = np.zeros_like(v), np.zeros_like(v)
    for k in range(1, STEPS + 1):
        score = np.zeros((n, m))
        score[real] = np.bincount(row, v[:-6][col], real.sum())
        marginal, both, _ = likelihood(score, v[-6:-2].reshape(2, 2), v[-2:], real)
        first = np.array([n - marginal[:, 0].sum(), marginal[:, 0].sum()])
        slope = np.concatenate([wanted - sums(marginal[real]), (pairs - both).ravel(), starts - first]) - RIDGE * v
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        v = v + 0.15 * (1 - k / (STEPS + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    return Field({x: float(v[i]) for x, i in vocabulary.items()}, v[-6:-2].reshape(2, 2), v[-2:])


@functools.lru_cache(1)
def trained(n: int = PAGES, seed: int = SEED) -> Field:
    """A field from ``made_pages``."""
    return train(made_pages(n, seed))


# ---- labelled pages

class _Maker:
    """Builds a page; ``main`` collects the texts of its main blocks."""

    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, []
        self.letters = rng.choice(["abcdefghilmnoprstu", "aeiourstnléèçà", "aenrstdlüöäß", "абвгдеиклмнорст", "aeiosrñóíldc"])

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choices(self.letters, k=r.randint(1, 9))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        text = self.words(low, high)
        if self.rng.random() < 0.5 and " " in text:
            text = text.replace(" ", ", ", 1)
        return text[0].upper() + text[1:] + self.rng.choice("...?!")

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence(2, 18) for _ in range(self.rng.randint(1, most)))

    def named(self, words: list[str], chance: float) -> str:
        r = self.rng
        if r.random() > chance:
            return ""
        name = r.choice(words)
        if r.random() < 0.5:
            name = r.choice([f"{name}-{r.choice(LAYOUT_WORDS)}", f"{r.choice(LAYOUT_WORDS)}_{name}", f"{r.choice(LAYOUT_WORDS)} {name}", f"{name}{r.randint(1, 9)}", f"site{name.title()}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'

    def links(self) -> str:
        r = self.rng
        items = [self.link(self.words(1, 4)) for _ in range(r.randint(2, 8))]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "<p>" + " ".join(items) + "</p>"])()

    def other(self, kind: str) -> str:
        """A part that is no main text."""
        r = self.rng
        tag, chance = {
            "menu": ("nav", 0.6), "header": ("header", 0.6), "footer": ("footer", 0.6), "sidebar": ("aside", 0.7), "form": ("form", 0.7),
        }.get(kind, ("", 1.0)) if r.random() < 0.6 else ("", 1.0)
        tag = tag or r.choice(["div", "div", "section", "ul" if kind == "menu" else "div", "aside" if kind in ("advert", "notice") else "div"])
        attributes = self.named(OTHER_WORDS[kind], chance)
        if r.random() < 0.1:
            role = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": r.choice(["alert", "dialog"]), "form": "search"}.get(kind)
            attributes += f' role="{role}"' if role else ""
        if kind == "menu":
            inner = self.links() if tag != "ul" else "".join(f"<li>{self.link(self.words(1, 3))}</li>" for _ in range(r.randint(2, 9)))
        elif kind == "header":
            inner = r.choice(["", "<h1>" + self.link(self.words(1, 3)) + "</h1>", f"<div>{self.words(1, 3)}</div>"]) + r.choice(["", f"<p>{self.sentence(3, 9)}</p>", self.links()]) or self.words(1, 4)
        elif kind == "footer":
            inner = r.choice(["&copy; ", "Copyright © ", ""]) + self.words(1, 3) + r.choice(["", " &middot; " + self.sentence(3, 12), " | " + self.sentence(2, 9)]) + r.choice(["", self.links(), f"<p>{self.prose(3)}</p>"])
        elif kind == "sidebar":
            inner = r.choice(["", f"<h3>{self.words(1, 4)}</h3>", f"<h2>{self.words(1, 4)}</h2>"]) + r.choice([self.links(), f"<p>{self.prose(3)}</p>", f"<p>{self.prose(2)}</p>" + self.links()])
        elif kind == "notice":
            inner = r.choice([f"<p>{self.prose(2)}</p>", self.prose(2)]) + r.choice(["", f"<button>{self.words(1, 2)}</button>", self.link(self.words(1, 3))])
        elif kind == "advert":
            inner = r.choice([self.prose(2), f"<p>{self.prose(2)}</p>", self.link(self.sentence(2, 8)), f"<h4>{self.words(1, 5)}</h4><p>{self.sentence(4, 12)}</p>"])
        elif kind == "form":
            inner = r.choice(["", f"<h3>{self.words(2, 5)}</h3>", f"<p>{self.sentence(4, 12)}</p>"]) + f"<label>{self.words(1, 3)}</label><input name=q>" + r.choice(["", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>"]) + f"<button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            item = r.choice(["div", "li", "article", "section"])
            one = lambda: f"<{item}{self.named(OTHER_WORDS['comments'], 1 if item == 'article' else 0.7)}>" + r.choice(["", f"<h4>{self.words(1, 2)}</h4>", f"<div>{self.words(1, 2)}</div>"]) + "".join(f"<p>{self.prose(5)}</p>" for _ in range(r.randint(1, 3))) + f"</{item}>"
            inner = r.choice(["", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{r.randint(1, 99)} {self.words(1, 2)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 5)))
            inner = inner if item != "li" else f"<ol>{inner}</ol>"
        else:
            inner = " ".join(self.link(self.words(1, 2)) for _ in range(r.randint(1, 5)))
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def own(self, tag: str, text: str, inner: str | None = None) -> str:
        self.main.append(text)
        return f"<{tag}>{inner or text}</{tag}>"

    def paragraph(self) -> str:
        r, text = self.rng, self.prose(8)
        words = text.split(" ")
        if r.random() < 0.3:
            i = r.randrange(len(words))
            words[i] = r.choice([f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", self.link(words[i])])
        if r.random() < 0.1:
            return self.own("p", text, "<b>" + " ".join(words) + "<br>").removesuffix("</p>")
        return self.own("p", text, " ".join(words))

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.8:
            title = self.own("h1", self.sentence(2, 12)[: r.choice([60, 200])].strip())
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        kinds = ["p"] * 12 + ["short", "h2", "h3", "ul", "quote", "pre", "table", "figure", "dl", "links", "div"]
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            k = r.choice(kinds)
            if k == "p":
                out.append(self.paragraph())
            elif k in ("h2", "h3"):
                out.append(self.own(k, self.words(1, 6)))
            elif k == "short":
                out.append(self.own("p", self.sentence(1, 3)))
            elif k in ("ul", "links"):
                name = r.choice(["ul", "ol"])
                items = [self.words(1, 12) for _ in range(r.randint(2, 5))]
                out.append(f"<{name}>" + "".join(self.own("li", x, self.link(x) if k == "links" else None) for x in items) + f"</{name}>")
            elif k == "quote":
                out.append(f"<blockquote>{self.own('p', self.prose(2))}</blockquote>")
            elif k == "table":
                out.append("<table>" + "".join("<tr>" + "".join(self.own("td", self.words(1, 3)) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k == "figure":
                out.append(f'<figure><img src="/i.png">{self.own("figcaption", self.sentence(2, 9))}</figure>')
            elif k == "dl":
                out.append("<dl>" + "".join(self.own("dt", self.words(1, 2)) + self.own("dd", self.sentence(3, 9)) for _ in range(2)) + "</dl>")
            else:
                out.append(self.own("pre" if k == "pre" else "div", self.prose(3)))
            if r.random() < 0.15:
                out.append(self.other(r.choice(["advert", "advert", "share", "sidebar", "notice", "form"])))
        for kind in ("share", "form", "sidebar", "comments", "advert"):
            if r.random() < 0.1:
                out.append(self.other(kind))
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        inner = self.article()
        home = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        attributes = self.named(CONTENT_WORDS, 0.5 if home in ("article", "main") else 0.9)
        inner = f"<table><tr><td{attributes}>{inner}</table>" if home == "td" else f"<{home}{attributes}>{inner}</{home}>"
        if home != "main" and r.random() < 0.25:
            inner = f"<main>{inner}{self.other('comments') if r.random() < 0.3 else ''}</main>"
        before = [self.other(k) for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < 0.35]
        after = [self.other(k) for k in ("share", "advert", "comments", "sidebar", "form", "notice", "menu", "footer") if r.random() < 0.35]
        r.shuffle(before)
        around = "".join(before) + inner + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            # names of wrappers tell little: they may speak of what else is inside
            around = f"<div{self.named([*LAYOUT_WORDS, 'page', 'site', 'sidebar', 'content', 'header', 'body'], 0.8)}>{around}</div>"
        body = r.choice(["<body>", '<body class="single post has-sidebar">', ""])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head>{body}{around}" + r.choice(["</body></html>", ""])


def made_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Labelled pages of many layouts: HTML and the texts of the main blocks."""
    out = []
    for i in range(n):
        maker = _Maker(random.Random(f"{seed}:{i}"))
        out.append((maker.page(), maker.main))
    return out


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text and its code points (n_chars) in place of the HTML."""
    field = field or trained()
    found = with_python_columns(pages, [html_col], lambda rows: [[field.text(p) for p in rows]], [(text, T.StringType())], drop=(html_col,), rows=64)
    return found.withColumn("n_chars", F.length(text).cast("long"))
