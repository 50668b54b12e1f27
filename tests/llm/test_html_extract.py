import html
import re
import time

import pytest

from lumenshelf.llm.html_extract import Page, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="masthead"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div><main><article class="post"><header><h1>The &amp; title</h1></header><p>First  para&shy;graph &#233;&#x4e2d;
with a <a href="x">link</a> in it.</p><form><input value="x">Search</form><p>Second<br>line</p><ul><li>one</li><li>two</li></ul><aside>See also</aside>
<section id="comments"><p>A reader says</p></section></article></main><div id="sidebar">Popular</div><footer>&copy; x</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "The & title\nFirst para\xadgraph é中 with a link in it.\nSecond line\none\ntwo"


@pytest.mark.parametrize("bad", [None, "", "<", "<html>", "<p", "</p></div>", "<script>only", "<!-- x", "<nav>menu</nav>", "&nbsp; &nbsp;"])
def test_pages_without_text(bad):
    assert main_text(bad) in ("", "<")


def test_broken_markup():
    assert main_text("<article><p><b>One<br><p>Two &am") == "One\nTwo &am"
    assert main_text("<article><p>a</b></i>b<p>c</article><footer>f") == "ab\nc"
    assert main_text("plain text & more < 5") == "plain text & more < 5"
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_time_grows_with_length_alone():
    for page in ("<b>" * 100_000 + "</i>" * 100_000 + "x", "<p><select>" + "<b>" * 50_000 + "<hr>" * 50_000, "<div>" * 50_000 + "<body>" * 50_000, "<li><b>" * 50_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 5


def test_an_attribute_without_its_second_quote():
    assert main_text("<article><p>One <a href='y'>two</a></p><p>three <a href=\"x>four</a> five") == "One two\nthree four five"


def test_formulas_stay_in_their_sentence():
    page = "<article><p>The area is <math><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup><annotation encoding='tex'>\\pi r^2</annotation></math> and more.</p></article>"
    assert main_text(page) == "The area is πr2 and more."


def test_the_only_text_of_a_page_stays_whatever_its_name():
    assert main_text(f'<body><nav><a href="/">Home</a></nav><div class="notice"><p>{BODY * 3}</p></div></body>') == (BODY * 3).strip()
    assert main_text(f'<body><nav>Home</nav><form>Send</form><div id="comments"><p>{BODY}</p></div></body>') == BODY.strip()
    assert main_text(f'<body><p>{BODY * 3}</p><div class="notice"><p>{BODY}</p></div></body>') == (BODY * 3).strip()


def test_density_leads_without_semantic_tags():
    words = "some long sentence of the article that goes on and on without any link at all "
    menu = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(40))
    page = f"<body><div><ul>{menu}</ul></div><div><p>{words * 5}</p><p>{words * 4}</p><p>short</p></div><div><a href=x>Imprint</a></div></body>"
    assert main_text(page) == f"{(words * 5).strip()}\n{(words * 4).strip()}\nshort"


BODY = "Some plain sentence of the story that goes on for a while without any link in it. "


@pytest.mark.parametrize("name", ["related-work", "share-price", "notice-period", "alert system", "comment_ary", "social-history", "ad-hoc"])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_text_blocks_stay_whatever_their_names_hint_at(name, outer):
    kept = name != "alert system"  # the word alone is a name of noise
    page = f'<body><nav><a href="/">Home</a></nav><{outer}><p>{BODY * 4}</p><div class="{name}"><p>{BODY * 4}</p></div><p>{BODY * 3}</p></{outer}><footer>x</footer></body>'
    blocks = [BODY * 4, BODY * 4, BODY * 3] if kept else [BODY * 4, BODY * 3]
    assert main_text(page) == "\n".join(b.strip() for b in blocks)


def test_blocks_of_links_with_such_names_go():
    links = "".join(f'<li><a href="/{k}">A story {k}</a></li>' for k in range(12))
    page = f'<body><div class="text"><p>{BODY * 6}</p><div class="related-work-links"><ul>{links}</ul></div><p>{BODY * 6}</p></div></body>'
    assert main_text(page) == f"{(BODY * 6).strip()}\n{(BODY * 6).strip()}"


def test_density_decides_between_two_articles_and_no_article():
    """The tag gives no claim of its own: a teaser in an article loses against a longer text in a div."""
    teasers = "".join(f'<article><h3><a href="/{k}">Teaser number {k}</a></h3></article>' for k in range(8))
    page = f"<body><div>{teasers}</div><div><p>{BODY * 6}</p><p>{BODY * 7}</p></div></body>"
    assert main_text(page) == f"{(BODY * 6).strip()}\n{(BODY * 7).strip()}"


def test_sums_add_up():
    page = Page("<body><div><p>abc def</p><p>ghi <a>jk</a></p></div></body>")
    body = page.tag.index("body")
    assert page.chars[body] == 11 and page.link_chars[body] == 2
    div = page.tag.index("div")
    assert page.sums[div] == pytest.approx(sum(page.density[i] for i, t in enumerate(page.tag) if t == "p"))


def slow(page):
    """The generated pages read with patterns: blocks of the article element."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    text = re.sub(r"</?(p|h\d)>", "\n", re.sub(r"<[^>]*$", "", m[1])) if m else ""
    lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", text)).split("\n"))
    return "\n".join(x for x in lines if x)


def test_generated_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: slow(r["html"] or "") for r in pages.collect()}
    rows = extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (None, None, None, None, None), (2, "v", "<p>" + "word " * 200_000, "", 0)]
    got = sorted((tuple(r) for r in extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert [r[3] for r in got] == [len(main_text(PAGE))] * 2 + [999_999, 0]
    assert extract(spark.createDataFrame([], schema)).collect() == []
