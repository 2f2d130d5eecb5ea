import random
import re
import time
from collections import Counter
from html import unescape

import pytest

from placewise.llm.html_text import BOILERPLATE, common_subsequence, extract_main_text, main_text, nearest_pages, page_lines

from .conftest import CLASHES, SF


def text_of(html):
    return main_text(page_lines(html), set())


PAGES = {
    "<p>One</p><p>two  \n three<br>four</p>": "One two three four",
    "<nav>Menu</nav><article><h1>Title</h1><p>Bo<b>dy</b> &amp; &lt;more&gt;&nbsp;&#233;</p></article><footer>End</footer>": "Title Body & <more> é",
    "<header>Site</header><main><p>Text</p><aside>Side</aside><form><input><label>Name</label></form></main>": "Text",
    "<div class='ad'>Buy</div><div id=cookie-notice>Cookies</div><div class='post-content'><p>Read</p></div><div>other</div>": "Read",
    "<article><p>A<p>B<p>C</article><section class=comments><article><p>I disagree</p></article></section>": "A B C",
    "<article>x<script>var t='</p><p>no';</script><style>p{}</style>y<!-- <p>hidden</p> -->z</article>": "xyz",
    "<article><p>cut &am": "cut &am",
    "<article><p>a < b and c</p><p title='x > y'>d</p><p hidden>no</p><p style='display: none'>no</p></article>": "a < b and c d",
    "<ARTICLE><P>Upper</P></ARTICLE><SCRIPT>no": "Upper",
    "plain text only": "plain text only",
    "<article><header><h1>Head</h1></header><p>Rest <span class=ad>spam</span>here</p></article>": "Head Rest here",
    "<body><div role=navigation>x</div><div role=main>y</div></body>": "y",
    "": "",
    "<": "<",
    "<article></article>": "",
    "<form action=x><input><div>Whole page</div><p>in a form</p><label>Name</label><button>Go</button></form>": "Whole page in a form",
    "<form><nav>Menu</nav><article><p>Body</p></article></form>": "Body",
    "<p>Text</p><form><p>Search here</p></form>": "Text",
    "<article><p>Teaser</p></article><div class='content'><p>The body is much longer than that.</p></div>": "The body is much longer than that.",
    "<article><p>Long body of an article</p></article><div class='content'><p>Short</p></div>": "Long body of an article",
    "<article><p>Read</p><div class='cta'>Subscribe now</div><p>on</p></article>": "Read on",
    "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><h1><a href=z>Head</a></h1><p>Go <a href=q>there</a> now</p>": "Head Go there now",
}


@pytest.mark.parametrize("html", PAGES)
def test_markup(html):
    assert text_of(html) == PAGES[html]


def test_tags_without_partners_take_linear_time():
    start = time.time()
    html = "<b>" * 40_000 + "x</i>" * 40_000
    assert len(main_text(page_lines(html), set())) == 40_000
    assert time.time() - start < 5


def neutral(html):
    """The page without what its markup says: structural elements become div, classes, ids and roles go."""
    html = re.sub(r"(</?)(?:nav|header|footer|aside|article|main|section|form)\b", r"\1div", html)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)


def word_f1(found, wanted):
    a, b = Counter(found.split()), Counter(wanted.split())
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if a or b else 1.0


def test_neutral_pages_are_told_by_differencing(spark):
    """With all names and structure taken away, differencing may only help, and the text is nearly that of the marked page."""
    folder = SF.replace("0.001", "0.01")
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    schema = "page_id long, url string, html string"
    wanted = {i: text_of(h) for i, _, h in pages}
    bare = [(i, u, neutral(h)) for i, u, h in pages]
    alone = {i: text_of(h) for i, _, h in bare}
    found = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(bare, schema)).collect()}
    with_it = sum(word_f1(found[i]["text"], w) for i, w in wanted.items()) / len(wanted)
    without = sum(word_f1(alone[i], w) for i, w in wanted.items()) / len(wanted)
    assert sum(found[i]["text"] != alone[i] for i in wanted) > 10
    assert with_it > without and with_it >= 0.97, (with_it, without)


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(10)
    for _ in range(800):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        for bits in (1 << 29, 8):
            found = common_subsequence(a, b, bits)
            rest = iter(b)
            assert all(a[i] in rest for i in found) and len(set(found)) == len(found) == lcs_length(a, b)


def test_neighbours_agree_with_a_plain_sort(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        host = rng.choice(["hot.example"] * 6 + ["a.example", "b.example"])
        rows.append((i, -i, host, "/" + "/".join(str(rng.randint(0, 4)) for _ in range(rng.randint(0, 4)))))
    rows += [(9001, 0, "single.example", "/x"), (9002, 0, "", "/x"), (9003, 0, None, None)]
    found = nearest_pages(spark.createDataFrame(rows, "k1 long, k2 long, host string, path string"))
    got = {r["k1"]: r["p1"] for r in found.collect()}
    order = sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[3], r[0]))

    def shared(a, b):
        x, y = a[3].split("/"), b[3].split("/")
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    want = {}
    for i, r in enumerate(order):
        sides = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][2] == r[2]]
        if sides:
            want[r[0]] = max(sides, key=lambda s: (shared(r, s), -sides.index(s)))[0]
    assert got == want


def test_shared_lines_go_where_no_article_is_marked(spark):
    def page(body):
        return f"<body><div>Welcome to our site</div><div>{body}</div><div>All about us</div></body>"

    rows = [(1, "http://h.example/a/1", page("First text")), (2, "http://h.example/a/2", page("Second text")), (3, "http://lone.example/", page("Third"))]
    found = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "First text", 2: "Second text", 3: "Welcome to our site Third All about us"}


def test_articles_that_pages_share_stay(spark):
    html = "<nav>Menu</nav><article><p>The same article</p></article>"
    rows = [(1, "http://h.example/1", html), (2, "http://h.example/2", html)]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in found] == ["The same article"] * 2 and all(r["n_shared"] == 2 for r in found)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = extract_main_text(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", html[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert r["text"] == " ".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_odd_inputs(spark):
    from pyspark.sql import functions as F

    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, "http://h.example/1", None), (1, "http://h.example/1", None), (None, None, "<p>x</p>"), (2, "not a url", ""), (3, "http://h.example/3", long), (4, "http://h.example/4", long), (5, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in [*CLASHES, "host", "path", "hashes", "shared", "slice"]})
    found = extract_main_text(pages).collect()
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[1] == texts[2] == texts[5] == "" and texts[None] == "x" and texts[3].count("word") == 20_000
    assert extract_main_text(pages.limit(0)).count() == 0
    assert BOILERPLATE == 0


def texts(spark, rows):
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in found}


def test_copied_pages_without_article_keep_their_text(spark):
    def page(body, at=""):
        return f"<body><div>Welcome to our site</div><div class='post-content'><p>{body}</p></div><div>All about us {at}</div></body>"

    body = "The same passage in every copy, long enough to be most of the page. " * 3
    copies = [(i, f"http://h.example/a/1?utm_source={i}", page(body)) for i in range(40)]
    copies += [(40 + i, "http://h.example/a/1", page(body, i)) for i in range(5)]
    assert set(texts(spark, copies).values()) == {body.strip()}
    plain = [(i, u, h.replace(" class='post-content'", "")) for i, u, h in copies]
    assert all(body.strip() in t for t in texts(spark, plain).values())
    # A page of other content behind the run of copies: its template lines go from every copy, and the text stays.
    other = "Something else that only this page says, and not one copy of the first. " * 3
    found = texts(spark, [*plain[:40], (99, "http://h.example/a/2", page(other).replace(" class='post-content'", ""))])
    assert found.pop(99) == other.strip() and set(found.values()) == {body.strip()}


def test_runs_of_copies_are_left_over_slices(spark):
    rows = [(i, 0, "h.example", f"/a/{i:03}", [1000 if 5 <= i < 95 else i, 2000], [8, 2]) for i in range(100)]
    mine = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in mine}
    for k, x in mine.items():
        spark.conf.set(k, x)
    try:
        pages = spark.createDataFrame(rows, "k1 long, k2 long, host string, path string, hashes array<long>, sizes array<int>")
        got = {r["k1"]: r["p1"] for r in nearest_pages(pages).collect()}
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert len(got) == 100 and all(got[i] == 4 for i in range(5, 95)) and got[0] == 1 and got[99] == 98 and got[95] == 94


LAYOUTS = {
    "<body class='single has-sidebar'><p>Body</p></body>": "Body",
    "<body class='sidebar'><nav>x</nav><article>Body</article></body>": "Body",
    "<div class='content with-sidebar'><article><p>Body</p></article></div>": "Body",
    "<article class='post comment-open'><p>Body</p></article>": "Body",
    "<article><p>One</p><p class='share-price'>Two</p><p class='share-buttons'>Tweet</p></article>": "One Two",
    "<div class='widget'><h2>Widget</h2><article>Body</article></div><p>Other</p>": "Body",
    "<div id='widget'><div role='main'>Body</div></div>": "Body",
    "<div class='post-content'>Body</div><section class='comments'><article>I disagree</article></section>": "Body",
    "<p>Body</p><div class='related-posts'><article>Teaser</article></div>": "Body",
    "<div class='widget'><article>Teaser</article></div><article>Body</article>": "Body",
    "<main><p>Intro</p><article>Body</article><div class='widget-area'>Side</div></main>": "Intro Body",
    "<main><p>Body</p><article>Teaser</article></main><footer>End</footer>": "Body Teaser",
    "<div class='social-links'>x</div><div class='site-footer'>y</div><p>Body</p>": "Body",
}


@pytest.mark.parametrize("html", LAYOUTS)
def test_names_of_boilerplate_are_whole_names(html):
    assert text_of(html) == LAYOUTS[html]


def test_shared_lines_of_main_go_beside_an_article():
    lines = page_lines("<main><p>Intro</p><p>Site line</p><article>Body</article></main>")
    assert main_text(lines, {1, 2}) == "Intro Body"
