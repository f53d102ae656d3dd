import pytest

from henhouse.llm import html_extract, html_pages

PAGES = [
    ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav>"
     "<div class=\"ad\">Buy now, it is cheap and good for you.</div><article><h1>Title &amp; more</h1><p><b>First line of the "
     "article, unclosed.<br><p>Second   paragraph\n of it &lt;here&gt;.</article><footer>&copy; x</footer></body></html>",
     "Title & more\nFirst line of the article, unclosed.\nSecond paragraph of it <here>."),
    ("<body><header>Site name</header><aside>Side note that is long enough to count</aside><main><h2>Head</h2><p>Text of the page "
     "that goes on.</p><form><label>Name</label><input></form><ul><li>one item</li><li>two items</li></ul>"
     "<div class='cookie-notice'>We use cookies on this site</div><div id=comments><p>Great post, thanks a lot for it!</p></div>"
     "</main></body>", "Head\nText of the page that goes on.\none item\ntwo items"),
    ("plain words, no markup at all", "plain words, no markup at all"),
    ("<div><p>a &lt; b<p>1 < 2 and x<y<!-- gone --> end", "a < b\n1 < 2 and x end"),
    ("", ""), ("<", "<"), ("<p", ""), ("<!-- only", ""), ("<script>x", ""), ("</p></div>", ""),
    ("<table><tr><td>Cell one of a long table row<td>Cell two of it, too</table>", "Cell one of a long table row\nCell two of it, too"),
    ("<p>caf&eacute; &#8211; &nbsp; x&unknown; <span hidden>no</span><i>ital</i>ic</p>", "café – x&unknown; italic"),
    ("<div class='post-12'><p title='a > b'>Quoted bracket in an attribute.</p></div>", "Quoted bracket in an attribute."),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_single_pages(source, text):
    found = html_pages.vote(source)
    got = html_pages.extract(source, [found[0]] if found else [])
    assert got == text


def test_generalised_paths_drop_digits():
    a = html_pages.vote("<body><div class='post-12 x'><p>Some text that is long enough to count.</p></div></body>")
    b = html_pages.vote("<body><div class='x post-7'><p>Another text, also long enough to count.</p></div></body>")
    assert a[0] == b[0]


def test_consensus_overrides_a_page(spark):
    """Where a page's own best container is a long reader box, the host's path decides."""
    good = "<body><div class=story><p>{}</p></div><div class=box><p>{}</p></div></body>"
    text, box = "The story of this page, told in full, and then some more. " * 3, "Readers of this page also say a lot of things. "
    rows = [(i, "http://h.example/%d" % i, good.format(text, box * 2)) for i in range(20)]
    rows.append((20, "http://h.example/odd", good.format(text, box * 8)))
    rows += [(21, None, None), (22, "no host", "<p>words here, enough of them to count</p>"), (22, "no host", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as paths")
    got = {(r.page_id, r.n_chars): r.text for r in html_extract.extract(pages).collect()}
    assert len(got) == 24 and all(len(t) == n for (_, n), t in got.items())
    by_id = {k[0]: t for k, t in got.items()}
    assert {by_id[i] for i in range(21)} == {text.strip()}
    assert got[(21, 0)] == "" and got[(22, 0)] == ""


LEAD = "The lead of this article says in short what it is about. "
REST = "The rest of the article tells it at length, with all there is to say. "


@pytest.mark.parametrize("source, text", [
    (f"<body><div><p>{LEAD}</p><blockquote>{REST * 3}</blockquote></div></body>", f"{LEAD.strip()}\n{(REST * 3).strip()}"),
    (f"<body><article><h1>Title</h1><div class=lead>{LEAD}</div><div class=body>{REST * 4}</div></article></body>",
     f"Title\n{LEAD.strip()}\n{(REST * 4).strip()}"),
    (f"<body><div class=entry-content><div class=lead>{LEAD}</div><div class=rest>{REST * 4}</div></div></body>",
     f"{LEAD.strip()}\n{(REST * 4).strip()}"),
    (f"<body><div class=x><p>{LEAD}</p><div class=rest>{REST * 4}</div></div></body>", f"{LEAD.strip()}\n{(REST * 4).strip()}"),
])
def test_siblings_of_the_best_part(source, text):
    assert html_pages.extract(source, []) == text
    assert html_pages.extract(source, [html_pages.vote(source)[0]]) == text


BODY = f"<p>{LEAD}</p><p>{REST * 3}</p>"
BODY_TEXT = f"{LEAD.strip()}\n{(REST * 3).strip()}"


@pytest.mark.parametrize("source", [
    f"<body><div class='content has-sidebar'>{BODY}<div class=sidebar>{LEAD}</div></div></body>",
    f"<body><div id=no-sidebar>{BODY}</div><div class=footer>{LEAD}</div></body>",
    f"<body><div class=elementor-widget-wrap><div class='elementor-widget el-a'><p>{LEAD}</p></div>"
    f"<div class='elementor-widget el-b'><p>{REST * 3}</p></div></div></body>",
    f"<body><div class=has-cookie-banner><div class=cookie-banner>{LEAD * 2}</div><article>{BODY}</article></div></body>",
    f"<body><div class=story>{BODY}<div class=comments><p>{LEAD}</p></div><p class=x><span class=share>Share</span></p></div></body>",
])
def test_words_of_a_class_do_not_hide_the_article(source):
    found = html_pages.vote(source)
    assert html_pages.extract(source, [found[0]]) == BODY_TEXT


@pytest.mark.parametrize("n", [10, 20_001, 300_000])
def test_long_attribute_values(n):
    data = "{a: 1 > 0, class=ad hidden} " * (n // 28 + 1)
    source = (f"<body><div data-props='{data}' class=story data-x=\"{data}\">{BODY}</div><div data-props='{data}' class=ad>{LEAD}</div>"
              f"<p data-props=\"{data}\" hidden>{LEAD}</p><img src='{data}'></body>")
    found = html_pages.vote(source)
    assert found[0] == "body/div.story" and html_pages.extract(source, [found[0]]) == BODY_TEXT


def test_quotes_without_an_end():
    assert html_pages.extract(f"<body><p title='never closed>{LEAD}</p><p>{REST}</p></body>", []) == f"{LEAD.strip()}\n{REST.strip()}"
    many = "<a x='>" + "<a y=\">" * 100_001
    assert html_pages.extract(many, []) == ""


def test_two_templates_on_a_host(spark):
    """Short pages in one container, long ones with a second one beside it, others elsewhere."""
    short, long, other = "<body><div class=lead>{}</div></body>", "<body><div class=lead>{}</div><div class=rest>{}</div></body>", "<body><div class=b><section>{}</section></div></body>"
    rows = [(i, "http://h.example/%d" % i, short.format(LEAD * 3)) for i in range(20)]
    rows += [(i, "http://h.example/%d" % i, long.format(LEAD, REST * 3)) for i in range(20, 28)]
    rows += [(i, "http://h.example/%d" % i, other.format(REST)) for i in range(28, 31)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert {got[i] for i in range(20)} == {(LEAD * 3).strip()}
    assert {got[i] for i in range(20, 28)} == {f"{LEAD.strip()}\n{(REST * 3).strip()}"}
    assert {got[i] for i in range(28, 31)} == {REST.strip()}


def test_a_rare_template_of_a_host_with_many(spark):
    """Thirty templates on one host, the last with few pages, one of them with a long box."""
    page = "<body><div class=t{}><p>{}</p></div><div class=box><p>{}</p></div></body>"
    name = lambda k: "abcdefghijklmnopqrstuvwxyzABCD"[k] * 2
    rows = [(k * 10 + i, "http://h.example/", page.format(name(k), REST * 3, LEAD)) for k in range(29) for i in range(8)]
    rows += [(1000 + i, "http://h.example/", page.format("rare", REST * 3, LEAD * (9 if i == 4 else 1))) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(pages).collect()} == {(REST * 3).strip()}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == 0


def test_generated_pages_give_back_their_paragraphs(spark):
    """The pages of the test tables: the article's heading and paragraphs, nothing else."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in rows.collect()}
    for r in html_extract.extract(rows).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)
        parts = re.split(r"<h1>|</h1>|<p>|</p>|<br>", article[1])
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r.text == "\n".join(w for w in want if w)
