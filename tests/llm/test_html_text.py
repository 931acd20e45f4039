import itertools
import random
import time

import pytest

from trafficlens.llm import html_text as H
from trafficlens.llm import queries

WORDS = "Some words of an article that is long enough to be told from a label. "


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html></html>", ""), ("<article><p>a &amp; b&nbsp;&eacute;\n c</p></article>", "a & b é c"),
    (f"<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{WORDS}<p>{WORDS}<p>Short.</article><footer>(c) x</footer>", f"T\n{WORDS.strip()}\n{WORDS.strip()}\nShort."),
    (f"<script>var t='</p>';</script><style>p{{}}</style><main><p>{WORDS}</p></main><!-- <p>no</p> -->", WORDS.strip()),
    (f"<article><p>{WORDS}</p><div class=ad>Buy</div><form><p>Mail me</p></form><p>x &lt;b&gt;</p></article>", f"{WORDS.strip()}\nx <b>"),
    (f"<div id=content><p>{WORDS}</p></div><div class='cookie-notice'><p>{WORDS}</p></div><div class=comments><article><p>{WORDS}</p></article></div>", WORDS.strip()),
    (f"<body class='has-sidebar'><div class=sidebar><p>{WORDS}</p></div><article><p>{WORDS}</p></article><aside>{WORDS}</aside>", WORDS.strip()),
    ("<article><p>cut <b>off</b> he<a hre", "cut off he"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><p title='a > b'>z</p></article>", "one\ntwo\nx\ny\nz"),
])
def test_pages(page, text):
    assert H.extract(page) == text


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 9)
        source, sink = [rng.random() * 4 for _ in range(n)], [rng.random() * 4 for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda kept: sum(sink[k] if kept[k] else source[k] for k in range(n)) + sum(c for a, b, c in edges if kept[a] != kept[b])  # noqa: E731, B023
        best = min(cost(kept) for kept in itertools.product([False, True], repeat=n))
        assert cost(H.minimum_cut(source, sink, edges)) == pytest.approx(best)


def test_long_page_and_frame(spark):
    page = "<article>" + f"<p>{WORDS}</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, None, None, 5), (2, "u", page, 6), (2, "u", page, 6)], "page_id bigint, url string, html string, text int")
    got = H.main_text(pages).orderBy("page_id").collect()
    assert [len(r["text"]) for r in got] == [0, 20_000 * len(WORDS) - 1, 20_000 * len(WORDS) - 1]
    assert H.main_text(pages.limit(0)).collect() == []


def test_query_against_templates(spark, small):
    """Every page of the table is an article between other things; its blocks in order are the result."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op2_html_text(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\0", body)).split("\0")
        expected = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (r["text"], r["n_chars"]) == (expected, len(expected))


LONG = WORDS.strip()
BODY = "".join(f"<p>{WORDS}{WORDS}</p>" for _ in range(6))
SIDE = "<div class=sidebar><ul><li><a href=/a>One link</a><li><a href=/b>Another link</a></ul></div>"


@pytest.mark.parametrize("name", ["content-with-sidebar", "layout has-sidebar", "toc-enabled", "no-sidebar", "page-sidebar-left", "pageSidebar widget"])
def test_wrappers_that_sound_like_boilerplate(name):
    """Without article or main the text stays, and the sidebar in the wrapper goes."""
    expected = "\n".join(["Title of it", *[f"{LONG} {LONG}"] * 6])
    assert H.extract(f"<body><div class='{name}'><div class='post-header'><h1>Title of it</h1></div>{BODY}{SIDE}</div><footer>(c) x</footer></body>") == expected
    assert H.extract(f"<body><div id='{name}'><h1>Title of it</h1>{BODY}{SIDE}</div></body>") == expected


def test_hints_hold_for_smaller_parts_and_beside_an_article():
    assert H.extract(f"<div>{BODY}</div><div class=sidebar><p>{WORDS}{WORDS}</p></div>") == "\n".join([f"{LONG} {LONG}"] * 6)
    assert H.extract(f"<article><p>{WORDS}</p></article><div class='related'>{BODY}</div>") == LONG
    assert H.extract(f"<nav><div class=menu>{BODY}</div></nav><div><p>{WORDS}</p></div>") == LONG


@pytest.mark.parametrize("part", [
    '<a "x', "<a 'x\"y", "<a", "<a x ", "<!x", "<!-", "<", "</b x", "<b>", "<head>", "<p>", "<div class=sidebar>x", '<a class="x\' y="z> '])
@pytest.mark.parametrize("end", ["", ">", '">', "</head></i></p>"])
def test_broken_markup_takes_linear_time(part, end):
    """A page of half a megabyte of parts that are never closed."""
    start = time.process_time()
    H.extract(f"<p>{WORDS}</p><i>" + part * (500_000 // len(part)) + end)
    assert time.process_time() - start < 8


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p title="a > b < c">x</p><p title=\'<b> "\'>y</p></article>', "x\ny"),
    ('<article><p>x <a href="y>z</p></article>', 'x <a href="y>z'),  # a tag without an end is text
    ("<article><p>1 < 2 and 3 > 2</p><!x><p>y<!-- <p>no --></article>", "1 < 2 and 3 > 2\ny"),
    ("<article><ul><li>a<ul><li>b</ul><li>c</ul><i><p>d</i>e</article>", "a\nb\nc\nde"),
    ("<article><p>x</p><!-- open <p>no</p></article>", "x"),
    ("<head><title>t</title><article><p>x</p><svg><p>y</p>", "x\ny"),
])
def test_scanner(page, text):
    assert H.extract(page) == text
