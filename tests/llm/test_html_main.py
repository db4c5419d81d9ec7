import html
import re
import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from bylines.llm.html_main import best_region, extract_main_text, learn_weights, main_text
from bylines.llm.queries import op9_main_text

D = "/root/testdata/sf0.001"
WEIGHTS = {"word": 1.0, "link word": -0.5, "p": -0.2, "/p": -0.2, "h1": -0.2, "/h1": -0.2, "div": -6.0, "/div": -6.0, "li": -6.0, "/li": -6.0, "nav": -8.0, "/nav": -8.0}


@given(st.lists(st.integers(-5, 5), max_size=30))
def test_best_region_is_best(xs):
    a, b = best_region(np.array(xs, float))
    most = max((sum(xs[i:j]) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1)), default=0)
    assert sum(xs[a:b]) == max(most, 0)


def wanted(page):
    m = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", re.sub(r"</?b>", "", m[1]))).split())


def test_whole_table_with_and_without_article_marks(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    got = op9_main_text(spark, D).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == wanted(pages[r.page_id]) and r.n_chars == len(r.text)
    plain = spark.createDataFrame([(i, re.sub("</?article>", "", h)) for i, h in pages.items()], "page_id long, html string")
    weights = learn_weights(spark.read.parquet(f"{D}/pages.parquet"))
    rows = extract_main_text(plain, weights=weights).collect()
    assert sum(r.text == wanted(pages[r.page_id]) for r in rows) >= 0.98 * len(rows)


def test_parts_beside_the_article():
    page = (
        "<body class='has-sidebar'><header><h2>Site</h2></header><ul class=menu><li>Home</ul><div id='cookie-notice'>We use cookies a lot</div>"
        "<div class=content><h1>A&nbsp;title &amp;  more</h1><p>First <b>bo</b>ld text &lt;here&gt;.<p>Second\n one<br>line <script>x('</p>')</script>ends."
        "<aside>aside words</aside><div class='ad-box'>buy now please</div><form><input>Your mail</form><p>Third and last one.</p></div>"
        "<section class='comments'><p>I read this and have a long comment on it</p></section><footer>fine print</footer>"
    )
    assert main_text(page, WEIGHTS) == "A title & more First bold text <here>. Second one line ends. Third and last one."


def test_odd_pages(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "<p>"), (4, "plain words only"), (None, "<p>" + "w " * 200_000), (5, "<article><p>a</article"), (6, "<" * 50), (7, "<div hidden>no</div><p>yes it is</p>")]
    df = spark.createDataFrame([(i, h, "t", 5) for i, h in rows], "page_id long, html string, text string, n_chars int")
    got = extract_main_text(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[3] == ""
    assert by[4] == "plain words only" and by[7] == "yes it is" and len(by[None]) == 399_999 and by[5] == "a"
    assert set(got[0].asDict()) == {"page_id", "text", "n_chars"}
    assert extract_main_text(df.limit(0)).count() == 0


def test_wrappers_are_not_dropped():
    body = "<h1>The title</h1><p>First words of a story that goes on.</p><p>Second part of it, as long.</p>"
    want = "The title First words of a story that goes on. Second part of it, as long."
    for name in ("wrap has-sidebar", "content no-comments", "page-with-header", "sidebar", "header", "social-science", "search-results", "comments"):
        page = f"<div class='{name}'>{body}<div class='sidebar'>more to see here</div></div><nav>Home News Sport</nav>"
        assert main_text(page, WEIGHTS) == want, name
    assert main_text(f"<article><div class='article-header'><h1>The title</h1></div><p class='social-science'>{body[18:]}</article>", WEIGHTS) == want
    long = "<p>I read this and have a very long comment on it, as always.</p>" * 9
    assert main_text(f"<div>{body}</div><div class='post-comments'>{long}</div>", WEIGHTS) == want
    assert main_text(f"<div>{body}</div><div class='commentList'>{long}</div>", WEIGHTS) == want


def test_hostile_pages_take_linear_time():
    began = time.time()
    for piece in ("<b>", "<p><b>", "<td>", "<li><i>", "<div>", "<svg>", "<span class='x'>", "</b>", "<tr><td>", "<a '\"", "<body>", "<article>"):
        main_text(piece * (100_000 // len(piece)) + "text", WEIGHTS)
    assert time.time() - began < 20
