"""Main text of pages: layouts with and without articles, broken markup, the query against a plain reading."""

import html
import re

import pytest

from sparkloom.llm import html_text as m

BODY = "The first paragraph says, at some length, what there is to say. It has commas, and stops.", "Short one.", "A third paragraph follows; it is long enough to be read, with signs, and more of them, too."
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)
WANT = " ".join(("Title here", *BODY))
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Menu {k}</a></li>' for k in range(6)) + "</ul>"
BESIDE = {
    "nav": f"<nav>{MENU}</nav>",
    "header": "<header><a href=/>Logo</a><p>Our slogan, which is long enough to look like text, and has commas, too.</p></header>",
    "footer": "<footer><p>&copy; 2020, some company. All rights are reserved, and so on, and so forth.</p></footer>",
    "aside": "<aside><h3>More</h3><p>Read this as well, it is long, and good, and has many signs, in fact.</p></aside>",
    "ad": '<div class="ad">Buy this now, it is cheap, it is good, it is new. Buy it today, or tomorrow.</div>',
    "cookies": '<div id="cookie-notice"><p>We use cookies, as everybody does, to know you better. Do you agree?</p><button>Yes</button></div>',
    "form": '<form action="/x"><label>Name, please, and address</label><input name=q><select><option>One<option>Two</select><textarea>text, typed</textarea></form>',
    "comments": '<section class="comments"><h2>2 comments</h2><article class="comment"><p>I think, as a reader, that this is good. Really, it is, and more.</p></article></section>',
    "thread": '<div id="disqus_thread"><div class="reply"><p>Another reader, who disagrees, with many words, and signs, and so on.</p></div></div>',
    "script": '<script>var x = "<p>not, text</p>"; if (a < b) { go(); }</script><style>p > a { margin: 0 }</style><noscript><p>No script, no fun, sorry.</p></noscript>',
    "comment": "<!-- <p>hidden, text</p> --><!doctype x><?xml version='1.0'?>",
}


def page(body):
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Title &mdash; site</title></head><body class="with-sidebar nav-open">{body}</body></html>'


@pytest.mark.parametrize("part", sorted(BESIDE))
@pytest.mark.parametrize("frame", ["<article><h1>Title here</h1>{}</article>", '<main id="main"><h1>Title here</h1>{}</main>', '<div role="main"><h1>Title here</h1>{}</div>', '<div class="content"><h1>Title here</h1>{}</div>', '<div id="x1"><h1>Title here</h1><div class="x2">{}</div></div>'])
def test_parts_beside_the_text(part, frame):
    text, beside = frame.format(PARAGRAPHS), BESIDE[part]
    inner = frame.format(PARAGRAPHS.replace("</p><p>Short", f"</p>{beside}<p>Short"))
    assert m.extract([page(beside + text), page(text + beside), page(f"<div>{beside}</div>{text}"), page(inner)]) == [WANT] * 4


def test_all_at_once():
    every = "".join(BESIDE.values())
    assert m.extract([page(f"{every}<article><h1>Title here</h1>{PARAGRAPHS}{every}</article>{every}"), page(f'{every}<div class="post-body"><h1>Title here</h1>{PARAGRAPHS}</div>{every}')]) == [WANT] * 2


def test_unnamed_menus_and_wrappers():
    menu = f"<div>{MENU}</div>"
    assert m.extract([page(f"{menu}<div><h1>Title here</h1>{PARAGRAPHS}</div>"), page(f"<article><h1>Title here</h1>{PARAGRAPHS}{menu}</article>")]) == [WANT] * 2
    # names of what stands around an article say nothing of it
    assert m.extract([page(f'<form id="aspnet"><div class="header-wrap"><article><h1>Title here</h1>{PARAGRAPHS}</article></div></form>')]) == [WANT]
    # other articles beside it
    other = '<div class="related"><article><h3>Other</h3><p>Another text, which is long, and has signs, and is not this one.</p></article></div>'
    assert m.extract([page(f"<article><header><h1>Title here</h1><p>By somebody</p></header>{PARAGRAPHS}</article>{other}")]) == [WANT]


def test_classes_of_places_in_a_text():
    rows = '<table class="table"><thead><tr class="header"><th>one<th class="top-header">two<tfoot><tr class="footer"><td>three</table>'
    for head in ('<h1 class="page-header">Title here</h1>', '<div class="article-header"><h1>Title here</h1><span>By me</span></div>', '<header class="entry-header"><h1>Title here</h1></header>'):
        beside = '<div class="side-bar">Beside, it is, and long.</div><div class="nav-bar">Go</div><div id="sideBar">x, y, z.</div><h2 class="comments">Comments</h2>'
        assert m.extract([page(f"<article>{head}{PARAGRAPHS}{rows}{beside}</article>")]) == [WANT + " one two three"]


def test_short_articles_beside_long_adverts():
    long = "<div class='x'>" + "Many words, many signs, and no end of them. " * 50 + "</div>"
    assert m.extract([page(f"{long}<article><h1>Of</h1><p>Of.</p></article>{BESIDE['ad']}")]) == ["Of Of."]
    assert m.extract([page(f"<article></article>{BESIDE['ad']}"), page(""), "", page(BESIDE["nav"] + BESIDE["ad"])]) == [""] * 4


def test_words_are_kept_whole():
    body = "<p>a<b>b</b>c <i>d</i><br>e<br/>f &amp; g&nbsp;h &lt;i&gt; &#233;&#xe9; &notin; AT&T</p><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table><pre>p\n  q\t\tr</pre><h2>end</h2>tail"
    assert m.extract([page(f"<article>{body}</article>")]) == ["abc d e f & g h <i> éé ∉ AT&T one two x y z p q r end tail"]


def test_broken_markup():
    want = "one, long enough, to count. two, also long, and so on. 1 < 2 three"
    for body in (
        "<article><p><b>one, long enough, to count.<br><p>two, also long, and so on.</p><p>1 < 2 three</article>",
        "<article><p>one, long enough, to count.<p><b>two, also long, and so on.<p>1 < 2 three",
        "<ARTICLE><P CLASS='a > b' data-x=1>one, long enough, to count.</P></i></span><DIV>two, also long, and so on.</B></DIV>1 < 2 three</ARTICLE><script>var a = '",
        '<article><p title="x>one, long enough, to count.<p>two, also long, and so on.<p>1 < 2 three</article><!-- open',
    ):
        assert m.extract([body]) == [want]
    assert m.extract(["<", "<>", "</", "<a", "&", "<article>&#0;&#xD800;&#x110000;</article>", "<p", "<!--", "plain text, no tags."])[-1] == "plain text, no tags."


def test_long_pages():
    words = [f"word{k}," for k in range(200_000)]
    deep = "<div>" * 3000 + "<p>deep, text, here.</p>" + "</div>" * 3000
    got = m.extract([page("<article><p>" + "</p><p>".join(" ".join(words[k : k + 50]) for k in range(0, len(words), 50)) + "</p></article>"), page(deep)])
    assert got == [" ".join(words), "deep, text, here."]


def test_pages_do_not_touch_each_other():
    pages = [page(f'{BESIDE["nav"]}<div class="c{k}"><h1>Title here</h1>{PARAGRAPHS}</div>{BESIDE["footer"]}') for k in range(5)] + ["", page("<p>Only this, here.</p>")]
    assert m.extract(pages) == [m.extract([p])[0] for p in pages]


def plain(text):
    """The given tables hold one article each, of a title and paragraphs."""
    found = re.search(r"(?s)<article>(.*?)</article>", text or "")
    parts = re.split(r"</?(?:p|h1|br)[^>]*>", found[1]) if found else []
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in rows)
    assert sorted(map(tuple, m.op11_html(spark, sf_dir).collect())) == want


def test_odd_rows(spark, monkeypatch):
    rows = [(1, "u", None, "t"), (None, None, "", "t"), (2, "u", page(f"<article>{PARAGRAPHS}</article>"), "t"), (2, "u", page(f"<article>{PARAGRAPHS}</article>"), "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(1)
    for size in (1, m.SLICE_CHARS):
        monkeypatch.setattr(m, "SLICE_CHARS", size)
        got = sorted(map(tuple, m.main_text(df).collect()), key=str)
        assert got == sorted([(1, "u", ""), (None, None, ""), *[(2, "u", " ".join(BODY))] * 2], key=str)
    assert m.main_text(df.limit(0)).count() == 0
