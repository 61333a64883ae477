from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderlens.llm.html_text import MIN_PAGES, MOSTLY, OFTEN, extract, site_templates
from orderlens.llm.page_parts import Page

PAGES = "page_id long, url string, html string"
CHROME = "<div><div>Town Herald</div><div>News Sport Weather</div></div>"


def site():
    """Pages of a host without telling names: chrome around text in plain divs; expected texts by id."""
    rows, want = [], {}
    for i in range(30):
        paragraphs = [f"Report {i} opens with line {j * i + j}." for j in range(1, 4)] + (["All rights of this line recur."] if i < 12 else [])
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, f"https://Herald.example.org/{i}", f"<html><body>{CHROME}<div><h1>Title {i}</h1>{body}</div><div>Call us today: five five five</div></body></html>"))
        want[i] = "\n".join([f"Title {i}", *paragraphs])
    for i in range(100, 130):  # a declared article keeps its prose though every page shares it
        rows.append((i, f"http://blog.example.net/p?{i}", f"<nav>Home</nav><article><h1>Post {i}</h1><p>Shared opening.</p><div>Read more of our posts</div></article>"))
        want[i] = f"Post {i}\nShared opening."
    for i in range(200, 204):  # too few pages for a template
        rows.append((i, f"http://small.example.net/{i}", f"<div>Small site</div><p>Page {i}</p>"))
        want[i] = f"Small site\nPage {i}"
    return rows, want


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(site()[0], PAGES).repartition(5)


def test_site_templates_go(pages):
    got = {r.page_id: r for r in extract(pages).collect()}
    assert {i: r.text for i, r in got.items()} == site()[1]
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[0].n_template >= 3 and not got[200].n_template


def test_templates_against_plain_counts(spark, pages):
    """The same digests, counted over unlike pages in a plain loop."""
    rows = site()[0] + [(900 + i, "https://herald.example.org/copy", site()[0][7][2]) for i in range(40)]  # copies count once
    seen, total = defaultdict(set), defaultdict(set)
    for _, url, html in rows:
        host, page = url.split("/")[2].lower(), Page(html)
        total[host].add("\n".join(page.blocks()))
        for d in page.subtrees():
            seen[host, d].add("\n".join(page.blocks()))
    want = {}
    for host, texts in total.items():
        counts = {d: len(t) for (h, d), t in seen.items() if h == host and len(t) >= max(MIN_PAGES, OFTEN * len(texts))}
        if len(texts) >= MIN_PAGES and counts:
            want[host] = (len(texts), set(counts), {d for d, n in counts.items() if n >= MOSTLY * len(texts)})
    got = {r.host: (r.n, set(r.often), set(r.mostly)) for r in site_templates(spark.createDataFrame(rows, PAGES).repartition(7)).collect()}
    assert got == want and len(got) == 2


def test_marks_of_one_page():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
      <body class="no-sidebar"><header>Site</header><div class="menu-open"><article class="post"><header><h1>Head &amp; tail</h1></header>
      <p>One<b> two</b>three <a href="x">four</a> <a href='y'>five</a>.<p>Next&nbsp; para<br>line<ul><li>a<li>b</ul>
      <table><tr><td>1<td>2<tr><th>x</table><div class="share">Share</div><form><p>Mail</form>
      <section id="comments"><article class="comment">Bad</article></section>tail 1 < 2 &lt; 3<aside>no</aside></article></div>
      <div class="cookieNotice">C</div><footer>F</body>"""
    assert Page(html).blocks() == ["Head & tail", "One twothree four five.", "Next para line", "a", "b", "1 2", "x", "tail 1 < 2 < 3"]
    soup = """<div id=top><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></div><div id="content"><h2>Title</h2>Text of the page,
      long enough<div class="sidebar-left">s</div><p hidden>h</p><p role=alert>r</p></div><div class=x>Other</div><!-- c"""
    assert Page(soup).blocks() == ["Title", "Text of the page, long enough"]
    assert Page("plain text").blocks() == ["plain text"] and not Page('<a href="x').blocks() and not Page("<article></article>menu").blocks()


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, None, "<p>a</p>"), (2, "no host", None), (3, "http://x.org", ""), (4, "http://x.org", long), (None, "http://x.org", "<p>n</p>"),
            (5, "http://x.org", "<p>same</p>"), (5, "http://x.org", "<p>same</p>"), (6, "http://x.org", "<div" * 2000 + "'" * 2000)]
    df = spark.createDataFrame(rows, PAGES)
    for name in ("host", "key", "text", "n_chars", "often", "mostly", "id"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, None, "a", 1), (2, "no host", "", 0), (3, "http://x.org", "", 0), (4, "http://x.org", "\n".join(["word"] * 50_000), 249_999),
                          (0, "http://x.org", "n", 1), (5, "http://x.org", "same", 4), (5, "http://x.org", "same", 4), (6, "http://x.org", "", 0)], key=str)
    assert extract(spark.createDataFrame([], PAGES)).count() == 0
