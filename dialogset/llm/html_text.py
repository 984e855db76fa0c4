"""Operator 2: main text of web pages by block classification.

A page is cut into flat text blocks at block-level tags. Every block gets its
word count and link density, those of the blocks before and after it, and
what encloses it (an article, a container whose tag, role, class or id speaks
of boilerplate). A decision tree says which blocks are main text; it is
trained by the extractor itself on ``LABELLED``, a small table of page
fragments written for it whose blocks carry their label.

One pass over the pages, no shuffle; the tree (a few nodes) travels with the
task. Parsing takes time about linear in the page's length, whatever the markup: where a
tag ends, and where an element closes, is looked up in places found once.

Edge cases: null or empty html has empty text; unclosed tags, containers and
comments end at the page's end (a boilerplate container that is never closed
ends where an article or main element begins); stray ``<`` are text;
repeated rows are each extracted; an empty table gives an empty result; other
columns pass through ``extract`` untouched (one named like its output is
replaced).
"""

from __future__ import annotations

import html as html_entities
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dialogset.session import ship_package

# fixed values: elements whose content is never text of the page
_RAW = "script|style|textarea|title"  # if never closed, they run to the end of the page
_SKIPPED = "noscript|template|svg|math|iframe|object|select|button|canvas|audio|video"
_START = re.compile(
    rf"<(?:!--|!\[CDATA\[|[!?]|(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*))", re.I
)
_CLOSE = re.compile(rf"</({_RAW}|{_SKIPPED})\s*>", re.I)
_COMMENT_END = re.compile("--!?>")
_SPACED = re.compile(r"[\s/>]")
# fixed values: tags that do not end a block
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_CONTAINER = set("address article aside body center details dialog div dl fieldset figure footer form header html main menu nav ol section table td th tr ul li p blockquote".split())
_NEVER = set("nav aside footer form menu dialog header fieldset".split())
_VOID_BLOCK = set("p li td th tr".split())
# fixed values: words of a class, id or role that speak of boilerplate
_HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer sidebar widget related recommended share sharing social comment comments disqus reply replies "
    "respond search pagination pager toolbar copyright contentinfo complementary form dialog outbrain taboola teaser tags".split()
)
_COMMENT = set("comment comments disqus reply replies respond ad ads advert advertisement promo sponsored related".split())
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")



class _Ends:
    """Where tags and elements of one page end.

    A tag ends at the first ``>`` outside quotes. That is a matter of the next
    ``>`` or quote only, so the answer is kept for each of them: a quote leads
    to the one that closes it, and on from there."""

    def __init__(self, page: str):
        self.page = page
        self.marks = [m.start() for m in re.finditer("[>\"']", page)]
        self.after: list[int] = [-1] * len(self.marks)  # the mark that closes a quote
        last: dict[str, int] = {}
        for i in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[i]]
            self.after[i] = last.get(c, -1)
            last[c] = i
        self.known: dict[int, int] = {}
        self.closes: dict[str, list[tuple[int, int]]] = {}
        for m in _CLOSE.finditer(page):
            self.closes.setdefault(m[1].lower(), []).append(m.span())

    def of_tag(self, at: int) -> int:
        """The place of the ``>`` that ends a tag read up to ``at``; -1 if none does."""
        i, path, end = bisect_left(self.marks, at), [], -1
        while 0 <= i < len(self.marks):
            if i in self.known:
                end = self.known[i]
                break
            path.append(i)
            if self.page[self.marks[i]] == ">":
                end = self.marks[i]
                break
            i = self.after[i] + 1 if self.after[i] >= 0 else -1
        for j in path:
            self.known[j] = end
        return end

    def of_element(self, name: str, at: int) -> int:
        """The end of the next closing tag of ``name`` from ``at`` on; -1 if there is none."""
        spans = self.closes.get(name, [])
        i = bisect_left(spans, (at, at))
        return spans[i][1] if i < len(spans) else -1


_RAW_NAMES, _SKIPPED_NAMES = set(_RAW.split("|")), set(_SKIPPED.split("|"))


def tokens(page: str):
    """The markup of a page in order: (start, end, tag, closing, attributes);
    tag is None for what is never text (comments, declarations, scripts and
    the like, with their content)."""
    ends, at = _Ends(page), 0
    while m := _START.search(page, at):
        start, name = m.start(), m["tag"]
        at = start + 1  # a stray "<" is text
        if name is None:
            head = m[0]
            if head == "<!--":
                end = _COMMENT_END.search(page, m.end())
                at = end.end() if end else len(page)
            elif len(head) > 2:
                end = page.find("]]>", m.end())
                at = end + 3 if end >= 0 else len(page)
            else:
                end = page.find(">", m.end())
                at = end + 1 if end >= 0 else len(page)
            yield start, at, None, False, ""
            continue
        end = ends.of_tag(m.end())
        if end < 0:
            continue
        low = name.lower()
        at = end + 1
        if not m["close"] and _SPACED.match(page, m.end()):
            if low in _RAW_NAMES:
                stop = ends.of_element(low, at)
                at = stop if stop >= 0 else len(page)
                yield start, at, None, False, ""
                continue
            if low in _SKIPPED_NAMES and page[end - 1] != "/" and (stop := ends.of_element(low, at)) >= 0:
                at = stop
                yield start, at, None, False, ""
                continue
        yield start, at, low, bool(m["close"]), page[m.end() : end]


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_boilerplate", "in_article", "article_elsewhere")


def _boilerplate(tag: str, attrs: str) -> bool:
    if tag in _NEVER:
        return True
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            continue
        words = {w.lower() for w in _PART.findall(value)}
        if tag in ("html", "body", "main"):
            continue
        if words & (_COMMENT if tag == "article" else _HINTS):
            return True
    return False


class Block:
    __slots__ = ("text", "words", "links", "boilerplate", "article")

    def __init__(self, text, words, links, boilerplate, article):
        self.text, self.words, self.links, self.boilerplate, self.article = text, words, links, boilerplate, article


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []  # open containers
    parts: list[tuple[str, bool]] = []  # text of the open block, and whether it is linked
    depth = {"bad": 0, "article": 0}
    anchor = False

    def end_block():
        nonlocal parts
        if parts:
            text = " ".join(html_entities.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(html_entities.unescape(t).split()) for t, a in parts if a)
                n = len(text.split(" "))
                out.append(Block(text, n, min(1.0, linked / n), depth["bad"] > 0, depth["article"] > 0))
            parts = []

    def pop_to(i: int):
        for tag, bad in stack[i:]:
            depth["bad"] -= bad
            depth["article"] -= tag in ("article", "main")
            open_at[tag].pop()
            if bad:
                bad_at[tag].pop()
        del stack[i:]

    page = page or ""
    found = list(tokens(page))
    last_close = {tag: start for start, _, tag, closing, _ in found if closing}
    open_at: dict[str, list[int]] = {}  # of each tag, its places on the stack
    bad_at: dict[str, list[int]] = {}  # those of boilerplate
    at = 0
    for start, end, tag, closing, attrs in found:
        if start > at:
            parts.append((page[at:start], anchor))
        at = end
        if tag is None:
            continue
        if tag == "a":
            anchor = not closing
            continue
        if tag in _INLINE:
            continue
        end_block()
        if closing:
            anchor = False
            if tag in _CONTAINER and tag not in _VOID_BLOCK:
                if open_at.get(tag):
                    pop_to(open_at[tag][-1])
            elif tag in _VOID_BLOCK and stack and stack[-1][0] == tag:
                pop_to(len(stack) - 1)
            continue
        if tag not in _CONTAINER or attrs.endswith("/"):
            continue
        if tag in _VOID_BLOCK and stack and stack[-1][0] == tag:
            pop_to(len(stack) - 1)  # an open paragraph or item ends where the next begins
        if tag in ("article", "main"):
            # an article after boilerplate that was never closed is not part of
            # it, and the main element is not part of any
            loose = [places[0] for t, places in bad_at.items() if places and (tag == "main" or last_close.get(t, -1) < at)]
            if loose:
                pop_to(min(loose))
        bad = _boilerplate(tag, attrs)
        open_at.setdefault(tag, []).append(len(stack))
        if bad:
            bad_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, bad))
        depth["bad"] += bad
        depth["article"] += tag in ("article", "main")
    if at < len(page):
        parts.append((page[at:], anchor))
    end_block()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    words = np.array([0, *[b.words for b in found], 0], float)
    links = np.array([0, *[b.links for b in found], 0], float)
    bad = np.array([b.boilerplate for b in found], float)
    article = np.array([b.article for b in found], float)
    elsewhere = (1 - article) * float(bool(((article > 0) & (bad == 0)).any()))
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], bad, article, elsewhere])


# ---------------------------------------------------------------- the tree

def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """A CART tree by Gini impurity: a leaf is a share of main text, a node is
    (feature, threshold, left, right) with left for values up to it."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(y) - least)]
        if not len(cut):
            continue
        left, right = t[cut - 1], t[-1] - t[cut - 1]
        n = cut.astype(float)
        m = len(y) - n
        cost = left * (1 - left / n) + right * (1 - right / m)
        i = int(np.argmin(cost))
        if best is None or cost[i] < best[0] - 1e-12:
            best = (cost[i], f, (v[cut[i] - 1] + v[cut[i]]) / 2)
    if best is None:
        return share
    _, f, at = best
    low = x[:, f] <= at
    return f, at, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree > 0.5)
    f, at, low, high = tree
    left = x[:, f] <= at
    out = np.empty(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


_S = "the river had risen in the night and by morning the lower meadows were under water".split()


def _w(n: int) -> str:
    """``n`` words of filler for the labelled fragments."""
    return " ".join(_S[i % len(_S)] for i in range(n))


def _menu(n: int) -> str:
    return "".join(f'<li><a href="/{i}">-{_w(1 + i % 3)}</a></li>' for i in range(n))


def _plain_menu(n: int) -> str:
    return "".join(f'<div>-<a href="/{i}">{_w(1 + i % 4)}</a></div>' for i in range(n))


def _paragraphs(*sizes: int) -> str:
    return "".join(f"<p>+{_w(n)}</p>" for n in sizes)


# The small labelled table: fragments whose blocks begin with + (main text) or - (not).
LABELLED = [
    f"<nav><ul>{_menu(6)}</ul></nav><div class=ad>-{_w(7)}</div><article><h1>+{_w(8)}</h1>{_paragraphs(12, 60, 1, 140, 3)}</article><footer>-{_w(9)}</footer>",
    f"<header><h1>-{_w(3)}</h1><ul>{_menu(4)}</ul></header><main>{_paragraphs(30, 2, 5, 80)}<ul><li>+{_w(4)}</li><li>+{_w(2)}</li></ul></main><aside>-{_w(40)}</aside>",
    f"<div id=menu>{_menu(5)}</div><div class=post><h2>+{_w(6)}</h2>{_paragraphs(45, 80, 9, 30)}</div><div class='cookie-notice'>-{_w(22)}</div>",
    f"<article>{_paragraphs(70, 4)}<section class=comments><p>-{_w(25)}</p><p>-{_w(3)}</p></section></article><p>-{_w(12)}</p><footer>-{_w(30)}</footer>",
    f"<div><ul>{_menu(8)}</ul></div><div><h1>+{_w(5)}</h1>{_paragraphs(90, 40, 15, 60)}</div><div><ul>{_menu(6)}</ul><p>-{_w(4)}</p></div>",
    f"<form><p>-{_w(6)}</p><label>-{_w(2)}</label></form><article><p>+{_w(1)}</p><p>+{_w(2)} <a href=x>{_w(3)}</a></p><p>+{_w(18)}</p></article>",
    f"<article>{_paragraphs(3)}</article><div>-{_w(15)}</div><div>-{_w(2)}</div>",
    f"<div class=sidebar>{_menu(3)}<p>-{_w(55)}</p></div><div class=text>{_paragraphs(25, 130, 70)}<p>+{_w(20)} <a href=x>{_w(4)}</a> {_w(10)}</p></div>",
    f"<main><article>{_paragraphs(1, 1, 2)}<p>+<a href=x>{_w(3)}</a></p><blockquote>+{_w(12)}</blockquote></article></main><div class=newsletter>-{_w(14)}</div>",
    f"<p>-<a href=x>{_w(2)}</a></p><p>-<a href=x>{_w(4)}</a></p><p>+{_w(50)}</p><p>+{_w(35)}</p><p>-<a href=x>{_w(2)}</a></p>",
    f"<p>+{_w(6)}</p>",
    f"<article>{_paragraphs(40, 3)}</article>",
    f"<article>{_paragraphs(2)}</article>",
    f"<nav>{_menu(3)}</nav><article>{_paragraphs(5, 4, 3)}</article>",
    f"<article><h1>+{_w(3)}</h1><p>+<a href=x>{_w(2)}</a></p><p>+<a href=x>{_w(1)}</a></p></article>",
    f"<main><p>+<a href=x>{_w(6)}</a></p>{_paragraphs(1, 2)}</main><footer>-{_w(3)}</footer>",
    f"<article><p>+<a href=x>{_w(4)}</a></p><p>+{_w(33)}</p><p>+<a href=x>{_w(9)}</a></p></article><div>-{_w(60)}</div>",
    f"<p>+{_w(2)}</p><p>+{_w(3)}</p><p>+{_w(11)}</p>",
    # pages that name nothing: word counts, link density and neighbours alone tell
    f"<div>{_plain_menu(7)}</div><div>{_paragraphs(40, 6, 75, 30)}</div><div>-{_w(5)}</div><div>{_plain_menu(5)}</div><div>-{_w(3)}</div>",
    f"<div>-{_w(3)}</div><div>{_plain_menu(4)}</div><p>+{_w(9)}</p>{_paragraphs(55, 20, 4, 90)}<div>{_plain_menu(6)}</div><p>-{_w(7)}</p>",
    f"<div>-{_w(4)}</div><div>-{_w(6)}</div><div>{_paragraphs(120, 33, 8, 47)}</div><div>-<a href=x>{_w(7)}</a> {_w(2)}</div><div>-{_w(4)}</div><div>-{_w(6)}</div>",
    f"<div>{_plain_menu(9)}</div><div>-{_w(2)}</div>{_paragraphs(28, 64, 17, 35)}<p>+{_w(14)} <a href=x>{_w(3)}</a></p><div>-{_w(5)}</div><div>{_plain_menu(3)}</div>",
    f"<div>-{_w(1)}</div><div>-{_w(2)}</div><div>{_plain_menu(5)}</div>{_paragraphs(66, 5, 50)}<div>-<a href=x>{_w(12)}</a></div><div>-<a href=x>{_w(15)}</a></div><div>-{_w(2)}</div>",
    f"<article><h1>+{_w(4)}</h1><aside>-{_w(16)}</aside>{_paragraphs(22, 64)}<div class='related posts'>{_menu(4)}</div><div class=share>-{_w(3)}</div></article>",
]


def train(table: list[str] = LABELLED):
    xs, ys = [], []
    for page in table:
        found = blocks(page)
        ys += [b.text[0] == "+" for b in found]
        xs.append(features(found))
    return grow(np.concatenate(xs), np.array(ys, float))


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, decide(tree, features(found))) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``html``, plus the main text as column ``out``."""
    ship_package(pages.sparkSession)
    tree = train()
    others = [f for f in pages.schema.fields if f.name not in (html, out)]
    schema = T.StructType([*others, T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            text = pa.array([main_text(p.as_py(), tree) for p in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], schema.names)

    return pages.select(*[f.name for f in others], html).mapInArrow(run, schema)
