from __future__ import annotations

import html as entities
import re
import time
from functools import reduce

import pytest

from leftdeep.llm import queries, wrappers
from leftdeep.llm.wrappers import SLOT, extract, merge, of_page, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li>About</li></ul></nav><!-- ad --><div class="ad">Buy %d</div>
<article><h1>Title %d</h1><p><b>First   %d &amp; more<br>of it<br><p>Second &lt;b&gt; %d</p><div class="share-box">Share</div>
<aside>Side</aside><form><input name=q>Find</form><p>Third&nbsp;one</article><section id="comments"><p>nice</p></section><footer>&copy; x</footer></body></html>"""


def one(page):
    p = parse(page)
    return extract(p, of_page(p))


def test_one_page():
    assert one(PAGE % (1, 2, 3, 4)) == "Title 2\nFirst 3 & more of it\nSecond <b> 4\nThird one"


def test_wrappers_merge():
    a, b = (of_page(parse(f"<ul>{x}</ul><p>{t}</p>{more}")) for x, t, more in (("<li>1<li>2", "a", ""), ("<li>3", "b", "<h2>new</h2>")))
    for w in (merge(a, b), merge(b, a)):
        assert [(n[0][0], o, r) for n, o, r in w[2]] == [("ul", False, False), ("p", False, False), ("h2", True, False)]
        ul, p, h2 = (n for n, _, _ in w[2])
        assert [(n[0][0], o, r) for n, o, r in ul[2]] == [("li", False, True)]
        assert p[1] == SLOT and h2[1] == "new"
        assert merge(w, a) == w and merge(w, b) == w


def test_markup_in_any_state():
    assert one("") == "" and one("just text") == "just text"
    assert one("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert one("<body><main><p>x</p></main><p>y</p></body>") == "x"
    assert one("<html class='no-js cookie'><body class='comments-open nav-top'><p>x</p></body></html>") == "x"
    assert one("<p>1 < 2 & 3</p><script>bad") == "1 < 2 & 3"
    assert one("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert one("<p hidden>no</p><p style='display:none'>no</p><p>yes &#x41;</p>") == "yes A"
    assert one("<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>") == "deep"
    assert one("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>more</p></article><p>after</p>") == "deep\nmore"
    mixed = "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(200))
    assert one(f"<article>{mixed}</article>") == "\n".join(f"h{i}\np{i}" for i in range(200))
    long = "word " * 50_000
    assert one(f"<article><p>{long}</p></article>") == long.strip()


def test_like_siblings_apart():
    assert one("<body><div>logo</div><nav>n</nav><div><article>text</article></div></body>") == "text"
    assert one("<article><section><p>a</p></section><h2>t</h2><section><ul><li>b</li></ul></section></article>") == "a\nt\nb"
    assert one("<article><div><p>a</p></div><h2>t</h2><div><blockquote>b</blockquote></div><h2>u</h2><div><table><tr><td>c</table></div></article>") == "a\nt\nb\nu\nc"
    pages = [parse(f"<article><div><p>a</p></div>{x}<div><ul><li>b</ul></div></article>") for x in ("<h2>t</h2>", "", "<h2>t</h2><div>c</div><h3>u</h3>")]
    host = merge(merge(of_page(pages[0]), of_page(pages[1])), of_page(pages[2]))
    assert [extract(p, host) for p in pages] == ["a\nt\nb", "a\nb", "a\nt\nc\nu\nb"]


def test_two_templates_on_one_host():
    pages = [parse(f"<body>{x}</body>") for x in ("<article><p>a</p></article><p>x</p>", "<main><p>b</p></main><p>y</p>", "<p>c</p>")]
    host = merge(merge(of_page(pages[0]), of_page(pages[1])), of_page(pages[2]))
    assert [extract(p, host) for p in pages] == ["a", "b", "c"]


LEGAL = """<body><article><h1>T{0}</h1><p>a{0}</p><p>Fixed words.</p></article></body>""", """<body><div class="legal">All rights.</div><div>
<p>b{0}</p><p>c{0}</p></div><div class="site-info"><b>Site</b> info</div></body>"""


def test_template_by_the_wrapper(spark):
    rows = [(i, f"http://{host}/{i}", LEGAL[k].format(i)) for host, k, n in (("a.com", 0, 4), ("b.com", 1, 4), ("two.com", 1, 2)) for i in range(n)]
    rows += [(i, "http://same.com", LEGAL[0].format(9)) for i in range(5)] + [(i, "http://alike.com", f"<i class={i}></i><p>same</p>") for i in range(4)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        i, host = r["page_id"], r["url"].split("/")[2]
        two = f"All rights.\nb{i}\nc{i}\nSite info"
        assert r["text"] == {"a.com": f"T{i}\na{i}", "b.com": f"b{i}\nc{i}", "two.com": two, "same.com": "T9\na9\nFixed words.", "alike.com": "same"}[host]


def test_lines_on_some_pages_only_are_no_template():
    pages = [parse(f"<article><p>a{i}</p>{'<p>often</p>' if i % 3 else ''}</article>") for i in range(9)]
    for order in (pages, pages[::-1], pages[1:] + pages[:1]):
        host = reduce(merge, [of_page(p, int(p.parts[0].parts[0].parts[0][1:])) for p in order])
        assert [extract(p, host) for p in pages] == [f"a{i}" + "\noften" * (i % 3 > 0) for i in range(9)]


def test_depth_changes_nothing():
    deep = "<div>" * 150
    assert one(f"{deep}<nav>n</nav><p>a</p><div class=advert>x</div><p hidden>h</p><form>f</form><p>b") == "a\nb"
    assert one(f"<body>{deep}<p>x</p><article><p>a<aside>s</aside></article><p>y") == "a"
    assert one("<body>" + "<div>" * 30_000 + "<main>" + "<div><li>" * 30_000 + "a" + "</p>" * 30_000 + "<nav>n") == "a"
    pages = [parse(f"<body>{deep}<p>fixed</p><p>a{i}</p>") for i in range(3)]
    host = reduce(merge, [of_page(p, i) for i, p in enumerate(pages)])
    assert [extract(p, host) for p in pages] == ["a0", "a1", "a2"]


@pytest.mark.parametrize("words", ["content has-sidebar", "no-sidebar", "layout-sidebar-right", "post with-comments"])
def test_layouts_are_not_closed(words):
    text = "<p>some text</p><p>more</p><div class=comments><p>nice, " + "and long " * 9 + "</p></div>"
    for page in (
        f"<body><div class='{words}'><article>{text}</article></div><p>tiny</p></body>",
        f"<body><article class='{words}'>{text}</article></body>",
        f"<body><main><div class='{words}'><article>{text}</article></div></main></body>",
        f"<body><div class='{words}'><main>{text}</main></div></body>",
        f"<body><article><div class='{words}'><p>some text</p><p>more</p></div></article></body>",
        f"<body><div class='{words}'><div class='{words}'><p>some text</p><p>more</p></div><div class='share-box'>s</div></div></body>",
    ):
        assert one(page) == "some text\nmore", page


def test_class_words_still_close():
    assert one("<body><p>real text</p><div class='related'><article>x</article></div></body>") == "real text"
    assert one("<body><article>real<div class='comments'><article class='comment'>a long comment</article></div></article></body>") == "real"
    assert one("<body><div class='cookie notice'>we use them</div></body>") == ""
    assert one("<body><p>a</p><div class='comments'><p>a long comment</p></div></body>") == "a"


def test_tags_as_browsers_read_them():
    assert one("<p>a</p><script src=x/>alert(1)</script><p>b</p>") == "a\nb"
    assert one("<svg/><p>a</p><svg><text>t</text></svg><div/><p>b") == "a\nb"
    assert one("<p>a<![CDATA[ x < y ]]>b</p><![CDATA[ open <p>c") == "a x < y b\nc"
    assert one("<p>a <!DOCTYPE") == "a"
    assert one('<p title="1 > 0">a</p><p title="never>b</p><p>c') == "a\nb\nc"


def test_headers_of_articles_and_results_of_searches():
    head = "<h1>Title</h1><p>by me</p>"
    for element in ("div class='entry-header'", "header", "header class='post-header'"):
        assert one(f"<body><header><h1>Site</h1></header><article><{element}>{head}</{element.split()[0]}><p>text</p></article>") == "Title\ntext"
    assert one("<article><div class='page-header ad'><h1>no</h1></div><p>text</p></article>") == "text"
    assert one("<article><h1>t</h1><div class='search-results'><p>a</p></div><div class='search-form'>Find</div><div id=search>x</div></article>") == "t\na"


@pytest.mark.parametrize("bit", ['<a "', "<a '\"", "<![CDATA[", "<![CDATA[>", "<!--", "<!", "</script ", "<script>", "<p class=\"x", "<div>", "</div>", "&#", "class ", "<li>", "<td a='>"])
def test_time_in_proportion_to_length(bit):
    def seconds(n):
        began = time.perf_counter()
        one(f"<article><p>a</p>{bit * n}")
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 8


def simple(page):
    """The test tables' pages, read plainly."""
    body = re.search(r"<article>(.*?)</article>", re.sub(r"<script>.*?</script>", "", page, flags=re.S), re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    lines = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts)
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("limit", [wrappers.BROADCAST, -1])
def test_rows(spark, limit):
    rows = [(1, "http://a.com/1", PAGE % (1, 2, 3, 4), "old"), (2, "http://a.com/2", PAGE % (5, 6, 7, 8), "old"), (2, "http://a.com/2", PAGE % (5, 6, 7, 8), "old")]
    rows += [(3, None, None, "old"), (4, "http://b.com", "", None), (5, "http://[bad", "<p>x</p>", ""), (6, "http://d.com", "<div>" * 900 + "d", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in wrappers.main_text(df, salts=3, broadcast=limit).collect())
    second = "Title 6\nFirst 7 & more of it\nSecond <b> 8\nThird one"
    assert got == [(1, "Title 2\nFirst 3 & more of it\nSecond <b> 4\nThird one"), (2, second), (2, second), (3, ""), (4, ""), (5, "x"), (6, "d")]
    assert wrappers.main_text(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS _host", "2 AS _w_wrapper", "3 AS _wrapper", "4 AS _Salt")
    assert {tuple(r)[-4:] for r in wrappers.main_text(clash, broadcast=limit).select("page_id", "_host", "_w_wrapper", "_wrapper", "_Salt").collect()} == {(1, 2, 3, 4)}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in queries.wrapper_main_text(spark, d).collect():
        assert r["text"] == simple(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])
