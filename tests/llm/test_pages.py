"""HTML extraction: hand-made pages, and site templates against plain counts."""

import html
import random
import re
from collections import defaultdict

import pytest

from ledgerloom.llm import pages

SCHEMA = "page_id long, url string, html string, host string, site string, text string, salt int, share double, title string, n_chars string"

CASES = {
    "plain": (
        '<title>T - Site</title><div id=wrapper><div class="site-header"><a href=/>Site</a> tag line</div><div id="content"><h1>T</h1><p>One &amp; two,\n three.<p>Four five six seven.</div>'
        '<div class="sidebar"><p>Sidebar text here, long enough to matter.</div><div id="comments"><p>Nice post I think that this is great, very long comment.</p></div><div id=footer>(c)</div></div>',
        "T One & two, three. Four five six seven.",
    ),
    "comments as articles": ('<main><article><h1>A</h1><p>Body text</p><footer>by x</footer></article><section class="comments"><article class="comment"><p>me too</p></article></section></main>', "A Body text"),
    "form around the page": ("<form id=f><nav>n</nav><article><p>x<b>y</b>z</p></article></form>", "xyz"),
    "inline elements": ('<article><p>a<!-- c -->b <span class="hidden">no</span>c<br>d<ul><li>e<li>f</ul></article>', "ab c d e f"),
    "table": ("<body><table><tr><td><ul><li><a href=1>Home</a><li><a href=2>About us</a></ul><td><p>Long prose text stands here, with words.<p>More of it follows here.</table>", "Long prose text stands here, with words. More of it follows here."),
    "notice": ('<div class="cookie-banner">We use cookies <button>OK</button></div><article>Text</article>', "Text"),
    "empty": ("", ""),
    "blank": (" \n ", ""),
    "script": ('<p>a<script>if(a<b)"</p>"</script>b', "ab"),
    "open comment": ("<p>a<!-- b", "a"),
    "stray signs": ("a < b &lt; c <3", "a < b < c <3"),
    "quoted sign": ('<p title="a>b" class=x>t</p>', "t"),
    "quote in a value": ("<p title=it's>t</p>u", "t u"),
    "heading before the article": ("<head><title>Big news | X</title></head><main><h1>Big news</h1><div class=meta>x</div><article><p>Body</p></article></main>", "Big news Body"),
    "inside the article": ('<article><p>a</p><aside>b</aside><p>c</p><form>d</form><div class="newsletter-signup">e</div><div class="ad">f</div></article>', "a c"),
    "header of the article": ("<article><header><h1>H</h1><p>by</p></header><p>t</p></article>", "H by t"),
    "header of the site": ("<header><h1>Site</h1></header><article><h2>H</h2><p>t</p></article>", "H t"),
    "references": ("<article>a&nbsp;&#8212;&#x41; &copy</article>", "a —A ©"),
    "only a menu": ("<nav><a href=1>x</a></nav>", ""),
    "name around all": ("<title>x</title><div class=widget-page-form><p>All of the prose stands in here, at length.</p><ul class=nav><li>y</ul></div>", "All of the prose stands in here, at length."),
}


def text_of(source, site=()):
    return pages.main_text(pages.prune(pages.parse(source)), set(site))


@pytest.mark.parametrize("name", CASES)
def test_hand_made(name):
    source, want = CASES[name]
    assert text_of(source) == want


def test_any_markup_is_read():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<article>", "</article>", "<", ">", "&", "&amp;", "<!--", "-->", "<script>", "</script>", "t", "é ", "<h1>", "</h2>", "<svg/>", "<br/>", "</br>"]
    for _ in range(3000):
        page = pages.parse("".join(rng.choice(parts) for _ in range(rng.randrange(60))))
        assert all(0 <= a < b <= len(page.texts) for _, a, b, _ in page.elements)
        pages.main_text(pages.prune(page), {h for h, *_ in page.elements})
    assert text_of("<div>" * 20000 + "a") == "a"
    assert text_of("<p>" + "word " * 200000).count("word") == 200000


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def site():
    """(page_id, url, html, wanted text): sites whose templates carry no names, one of them with a third of all pages."""
    rng, rows = random.Random(5), []
    for h, n in (("big.example.org", 60), ("small.example.org", 8), ("two.example.org", 2)):
        top, bottom, box = say(rng, 12), say(rng, 14), say(rng, 11)
        shared = say(rng, 9)
        for i in range(n):
            title, body = say(rng, 4), [say(rng, 20), say(rng, 15)]
            if i % 4 == 0:
                body.append(shared)  # a line that many articles of the site share
            article = "".join(f"<p>{html.escape(p)}</p>" for p in body)
            if i % 3 == 1:
                source = f"<title>{title}</title><div><div>{top}</div><div><h1>{title}</h1>{article}</div><div><p>{bottom}</p></div></div>"
            else:
                source = f"<title>{title}</title><div>{top}</div><article><h1>{title}</h1>{article}<div><p>{box}</p></div></article><div><p>{bottom}</p></div>"
            rows.append([f"https://u@{h.upper() if i == 3 else h}:80/{i}?x", source, (top, title, body, bottom, box)])
            if i % 10 == 5:
                rows.append([f"http://{h}/copy{i}", source, rows[-1][2]])  # a copy
    return [(k, *r) for k, r in enumerate(rows)]


def test_templates_of_sites(spark, site):
    table = spark.createDataFrame([(k, u, h, "h", "s", "t", 1, 0.1, "x", "n") for k, u, h, _ in site], SCHEMA).repartition(4)
    got = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    assert len(got) == len(site)
    for k, url, _, (top, title, body, bottom, box) in site:
        article = " ".join([title, *body])
        if "two." in url:  # two pages make no template
            assert article in got[k]
        else:
            assert got[k] == article and not any(t in got[k] for t in (top, bottom, box))


def test_counts_are_plain_counts(spark, site):
    table = spark.createDataFrame([(k, u, h) for k, u, h, _ in site], "page_id int, url string, html string").repartition(3)
    got = {(r["host"], r["hash"]): (r["pages"], round(r["share"], 9)) for r in pages.site_templates(pages.page_blocks(table)).collect()}
    held, of = defaultdict(set), defaultdict(set)
    for _, url, source, _ in site:
        host = pages._key(re.search(r"//(?:u@)?([^/:]*)", url)[1].lower())
        page = pages.parse(source)
        of[host].add(page.title)
        for h, *_ in page.elements:
            held[host, h].add(page.title)
    want = {k: (len(v), round(len(v) / len(of[k[0]]), 9)) for k, v in held.items() if len(v) >= 3 and len(v) >= 0.3 * len(of[k[0]])}
    assert got == want and len(got) > 5


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "no address", "<p>Some words stand here.</p>"), (3, None, "<article>x</article>")]
    out = pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, None, ""), (1, None, ""), (None, "", ""), (2, "no address", "Some words stand here."), (3, None, "x")], key=repr)
    assert pages.extract(spark.createDataFrame([], "page_id string, url string, html string")).collect() == []


def test_query_on_pages(spark):
    data = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r["page_id"]: r for r in pages.query(spark, data).collect()}
    assert len(got) == len(table)
    for r in table:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?:/?p|/?h1|br)>", " ", inner).replace("<b>", "")).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])
