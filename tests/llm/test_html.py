import pytest

from ledgerloom.llm import htmltext
from ledgerloom.llm.htmltext import main_text

LONG = "Many plain words follow one another here, so that the line counts as text of an article."


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a&amp;b &#233;<p>c", "a&b é c"), ("<script>x</script><style>y</style>", ""), ("<b>bo</b>ld", "bold")])
def test_small(html, text):
    assert main_text(html) == text


def test_article_with_everything_around():
    page = f"""<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">buy</div>
    <header>Site</header><article><h1>Head</h1><p><b>{LONG}<br><p>Short.</p><aside>aside</aside><form>f</form><p>{LONG}</p><div class="comments">nice</div></article>
    <div id="cookie-notice">cookies</div><footer>foot</footer></body>"""
    assert main_text(page) == f"Head {LONG} Short. {LONG}"


def test_without_an_article_element():
    page = f"""<body class="has-sidebar"><div id="top-menu"><a href=1>One</a> <a href=2>Two</a></div><div class="wrap"><div class="sidebar"><p>{LONG}</p></div>
    <div class="post-body"><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div id="comments"><p>{LONG}</p></div></div><div class="site-footer">x</div>"""
    assert main_text(page) == f"Head {LONG} Short. {LONG}"


def test_unclosed_navigation_ends_at_the_article():
    assert main_text(f"<nav><ul><li>a<article><p>{LONG}</p></article>") == LONG


def test_smoothing_keeps_constants():
    import numpy as np

    assert np.allclose(htmltext.smooth(np.full(5, 3.0)), 3.0)


def plain_article(html):
    """The text of the article element by plain rules, its blocks joined by spaces."""
    import html as H
    import re

    inner = re.search(r"<article>(.*?)</article>", html, re.DOTALL)
    blocks = re.split(r"</?(?:h1|p|br)\b[^>]*>", inner[1] if inner else "")
    return " ".join(" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks if b.strip())


@pytest.fixture(scope="module")
def pages():
    pq = pytest.importorskip("pyarrow.parquet")
    return [h or "" for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()]


def bare(html):
    """A page without the names that tell its parts: no article element, no classes."""
    import re

    return re.sub(r' class="[^"]*"', "", html.replace("<article>", "<div>").replace("</article>", "</div>"))


def test_pages_like_plain_rules(pages):
    assert [main_text(h) for h in pages] == [plain_article(h) for h in pages]


def plainer(html):
    """The same with navigation and footer as plain containers."""
    import re

    return re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", bare(html))


def right(pages, shape):
    return sum(main_text(shape(h)) == plain_article(h) for h in pages)


def test_ratios_find_articles_without_names(pages):
    assert right(pages, bare) >= 0.98 * len(pages)
    assert right(pages, plainer) >= 0.98 * len(pages)


@pytest.mark.parametrize("shape", [str, bare, plainer])
def test_a_constant_in_place_of_the_ratio_fails(pages, monkeypatch, shape):
    import numpy as np

    before = right(pages, shape)
    monkeypatch.setattr(htmltext, "ratios", lambda plain, tags, named: np.ones(len(plain)))
    assert right(pages, shape) < 0.5 * before


def test_names_alone_fail_where_there_are_none(pages, monkeypatch):
    """With one ratio for all lines that no name rules out; where navigation and footer are so named, runs of lines are enough."""
    import numpy as np

    before = right(pages, plainer)
    monkeypatch.setattr(htmltext, "ratios", lambda plain, tags, named: np.where(named, 1 / htmltext.NAMED, 50.0))
    assert right(pages, plainer) < 0.5 * before


def test_smoothing_decides(pages, monkeypatch):
    before = right(pages, bare), right(pages, plainer)
    monkeypatch.setattr(htmltext, "smooth", lambda values, at=None: values)
    assert right(pages, bare) < 0.9 * before[0] and right(pages, plainer) < 0.9 * before[1]


def test_boilerplate_inside_an_article_lends_and_takes_nothing():
    assert main_text(f"<article><p>{LONG}</p><aside>{LONG}</aside><p>End.</p></article>") == f"{LONG} End."
    sections = "".join(f"<section><h2>Part {i}</h2><p>{LONG * (1 + 3 * (i == 1))}</p></section>" for i in range(3))
    assert main_text(f"<body><div><a href=1>One</a> <a href=2>Two</a></div><main>{sections}</main><div>x y</div>").startswith("Part 0 Many")
    assert main_text(f"<article><p>{LONG}</p><p><a href=1>All of it is linked</a></p></article>") == f"{LONG} All of it is linked"


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    def seconds(n):
        began = time.process_time()
        assert main_text("<div>x" * n + "</div>" * n)
        assert main_text("<b>x" * n + "</i><p>" * n + "<article>" * n + "y")
        return time.process_time() - began

    seconds(2000)
    assert seconds(32_000) < 16 * max(seconds(4000), 0.05)
    long = " ".join(["words"] * 400_000)
    assert main_text(f"<nav>{long}</nav><article><p>{long}</p></article>") == long


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "z"), (1, "u", f"<p>{LONG}</p>", "z"), (None, None, None, "z")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract(rows).collect())
    assert got == [(0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG))]
    assert htmltext.extract(rows.limit(0)).count() == 0
