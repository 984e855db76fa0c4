"""Operator 2 against plain statements: tokens, articles, time and features."""

import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from dialogset.llm import html_text as H

IN_TAG = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{H._RAW})(?=[\s/>]){IN_TAG}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<skip>{H._SKIPPED})(?=[\s/>]){IN_TAG}(?<!/)>.*?</(?P=skip)\s*>"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{IN_TAG})>",
    re.S | re.I,
)


def test_tokens_equal_one_pattern():
    """On random markup, whole and broken, against a single pattern (which takes quadratic time)."""
    rng = random.Random(2)
    pieces = ["<", ">", "/", '"', "'", "<p>", "</p>", "<a href='x>y'>", '<b c="', "<svg>", "</svg>", "<svg/>", "<script>", "</SCRIPT >", "<title", "<!--", "-->", "--!>",
              "<!x", "<![CDATA[", "]]>", "word ", "<button a=1>", "</button>", "<p a='", " x", "<?php", "<img/>", "=", "<div"]
    for _ in range(4000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = [(m.start(), m.end(), m["tag"] and m["tag"].lower(), bool(m["close"]), m["attrs"] or "") for m in TOKEN.finditer(page)]
        assert list(H.tokens(page)) == want, page


class _Article(HTMLParser):
    """Text inside article elements, parted at tags that are not inline."""

    def __init__(self):
        super().__init__()
        self.depth, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in H._INLINE:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag not in H._INLINE:
            self.text.append(" ")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.text.append(data)


def test_registered_query_against_a_plain_parser(spark):
    """All given pages: the words inside the article, by the standard library's parser."""
    from dialogset.llm.queries import op2_html_text

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in op2_html_text(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        plain = _Article()
        plain.feed(p.html or "")
        plain.close()
        want = " ".join("".join(plain.text).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want), p.page_id


@pytest.mark.parametrize("unit", ["<svg>x", "<button>x", "<a ", '<a "x', "<a '\"x", '<a "x <b>', "<div>", "<div class=ad>", "<p><div class=ad>x", "</div>", "<!--", "<script", "<", "&amp;<x"])
def test_time_grows_with_the_page(unit):
    tree = H.train()

    def seconds(n):
        best = 9e9
        for _ in range(2):
            start = time.perf_counter()
            H.main_text(unit * n, tree)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(64_000) < 16 * seconds(16_000) + 0.02


def test_time_of_articles_in_closed_boilerplate():
    start = time.perf_counter()
    H.main_text("<div class=ad>" * 30_000 + "<article>" * 30_000 + "</div>", H.train())
    assert time.perf_counter() - start < 5


def _used(tree) -> set[str]:
    return set() if not isinstance(tree, tuple) else {H.FEATURES[tree[0]]} | _used(tree[2]) | _used(tree[3])


def test_word_counts_links_and_neighbours_decide():
    """The grown tree asks for them, and on pages that name nothing (other
    sizes than the labelled ones) they tell text from lists of links and short lines."""
    tree = H.train()
    assert {"words", "links"} <= _used(tree) and _used(tree) & {"words_before", "words_after", "links_before", "links_after"}
    rng = np.random.default_rng(6)
    right = total = 0
    for _ in range(200):
        menu = "".join(f'<div>-<a href="/{i}">{H._w(int(rng.integers(1, 5)))}</a></div>' for i in range(int(rng.integers(3, 9))))
        text = "".join(f"<p>+{H._w(int(n))}</p>" for n in rng.integers(12, 120, int(rng.integers(2, 7))))
        foot = "".join(f"<div>-{H._w(int(n))}</div>" for n in rng.integers(1, 6, int(rng.integers(1, 3))))
        found = H.blocks(f"<div>{menu}</div><div>{text}</div>{foot}<div>{menu}</div>")
        keep = H.decide(tree, H.features(found))
        right += sum((b.text[0] == "+") == k for b, k in zip(found, keep))
        total += len(found)
    assert right / total > 0.97
