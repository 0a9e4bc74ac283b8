import re

import numpy as np

from plumbline.llm.html import blocks, extract_text, main_text, train

TREE = train()
PROSE = "The river rose again in the spring and the people of the valley moved their boats to higher ground before the water came."


def test_own_layouts():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var x = "</p><p>no";</script></head><body class="home">
    <header><a href=/>Site</a><h2>Slogan here</h2></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two words</a></ul></nav>
    <div id="cookie-notice">We use cookies to make this site work for you and for our partners, see the policy.</div>
    <main><article><header><h1>Head &amp; line</h1><p class=byline>By Someone</p></header><p>{PROSE}<p>Short&nbsp;one.
    <div class="ad-box"><p>{PROSE} Buy now!</p></div><blockquote>Quoted <b>bold</b><br>words</blockquote></article></main>
    <aside><p>{PROSE}</p></aside><section id=comments><article class="comment"><p>{PROSE} I agree!</p></article></section>
    <form><label>Name</label> {PROSE}</form><footer>&copy; 2020 Site. {PROSE}</footer></body></html>"""
    assert main_text(page, TREE) == f"Head & line\n{PROSE}\nShort one.\nQuoted bold words"


def test_pages_without_landmarks():
    links = "".join(f'<div><a href="/{i}">Link number {i}</a></div>' for i in range(5))
    page = f"<body>{links}<p>{PROSE}</p><p>Then it fell.</p><p>{PROSE}</p>{links}<div>Copyright us</div>"
    assert main_text(page, TREE) == f"{PROSE}\nThen it fell.\n{PROSE}"


def test_broken_markup():
    for page in (None, "", "<", "a < b", "<p", "<!-- x", "<script>x", "<p title='x>y", "</p></div>", "<a <b <c " * 2000, "<p>" * 5000 + "x", "<b>" * 30000):
        assert isinstance(main_text(page, TREE), str)
    assert [t for t, _ in blocks("<p>a &lt;b&gt; &eacute;\n\t c<p>d")] == ["a <b> é c", "d"]


def test_given_pages(spark, sf):
    """On the given pages the main text is what stands inside the article element, read by plain patterns."""
    import html as h

    pages = spark.read.parquet(f"{sf}/../sf0.01/pages.parquet")
    rows = extract_text(pages).collect()
    good = 0
    for r in rows:
        inner = re.sub(r"<(script|style).*?</\1>|<!--.*?-->", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1], flags=re.S)
        want = [" ".join(h.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        good += r.text.split() == "\n".join(x for x in want if x).split()
    assert good >= 0.98 * len(rows)


def test_tables(spark):
    schema = "page_id long, url string, html string, text string"
    got = extract_text(spark.createDataFrame([(1, None, None, "old"), (None, "u", "", None), (2, "u", f"<article><p>{PROSE * 3000}</article>", None), (2, "u", f"<article><p>{PROSE * 3000}</article>", None)], schema)).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, len(PROSE) * 3000, len(PROSE) * 3000]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_tree_fits_its_table():
    from plumbline.llm.html import LABELLED

    rows = np.array([x.split() for x in LABELLED.split("\n") if x.strip()], float)
    assert all(TREE(list(r[:-1])) == bool(r[-1]) for r in rows)


def test_menus_named_main_do_not_hide_the_article():
    for menu in ('<ul class="main-nav"><li><a href=/a>One</a><li>Two words</ul>', '<div class="sidebar content"><p>Some box text</p></div>', "<nav id=main><h2>Menu</h2><a href=/>x</a></nav>", '<div class="comment post"><p>Me too</div>'):
        page = f"<body>{menu}<div><p>{PROSE}</p><p>{PROSE}</p></div>{menu}</body>"
        assert main_text(page, TREE) == f"{PROSE}\n{PROSE}", menu


def test_attribute_names_are_taken_whole():
    for attr in ('aria-hidden="false"', "data-hidden=1", 'data-hidden="true"', 'title="a hidden cave, class=ad"', "data-class=ad", 'data-id="nav"', "x-style='display:none'"):
        assert main_text(f"<article {attr}><p>{PROSE}</article>", TREE) == PROSE, attr
    for attr in ('aria-hidden="true"', "aria-hidden=true", "hidden", 'x=1 hidden=""', "style='display: none'", 'CLASS="ad"', "a='b'class=ad"):
        assert main_text(f"<article><p>{PROSE}<div {attr}><p>{PROSE}</div></article>", TREE) == PROSE, attr


def test_math_is_text():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>x=\\frac12</annotation></semantics></math>"
    assert main_text(f"<article><p>{PROSE} Here {math} holds.</article>", TREE) == f"{PROSE} Here x = 1 2 holds."


WORDS = "Long paragraphs of the article tell the reader what happened on that day in the town, and they hold many words."
WRAPS = [
    '<article class="post hentry comments-open tag-search">{}</article>', '<div class="content has-sidebar">{}</div>', '<main class="with-sidebar">{}</main>',
    '<div class="layout header-fixed"><div class="entry-content">{}</div></div>', '<div class="page with-menu"><article>{}</article></div>', '<article>{}</article>', '<div id="main">{}</div>',
    '<div class="post-content">{}</div>', '<section class="story">{}</section>', "<div>{}</div>",
]
AROUND = [
    '<div id="comments" class="comments-area"><article class="comment-body"><p>' + WORDS + " Nonsense, says a reader.</p></article></div>",
    '<nav><ul class="main-nav"><li><a href=/a/>Home</a></li><li><a href=/b/>News</a></li></ul></nav>',
    '<script src=/js/>var x = 1;</script><div class="sidebar"><p>' + WORDS + " Buy this now.</p></div>",
]


def test_thirty_layouts():
    import pytest  # noqa: F401

    from plumbline.llm.html import main_text, train

    tree = train()
    inner = "<h1>A title of the story</h1><p>{0}</p><p><a href='x'>One linked line</a></p><p>{0}</p><p>Yes.</p><p>{0}</p>".format(WORDS)
    for wrap in WRAPS:
        for around in AROUND:
            page = f"<html><body class='has-menu'>{around}<div data-x=/a/></div>{wrap.format(inner)}</body></html>"
            got = main_text(page, tree).split("\n")
            want = [WORDS, WORDS, "Yes.", WORDS] if wrap == "<div>{}</div>" else [WORDS, "One linked line", WORDS, "Yes.", WORDS]
            assert [x for x in got if x not in ("A title of the story", "One linked line" if wrap == "<div>{}</div>" else "")] == want, (wrap, around, got)
