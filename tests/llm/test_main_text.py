"""Main text of pages: against the articles of the given pages, on templates of other kinds, and on broken markup."""

import html
import re
import time

import pytest

from tracelake.llm.main_text import extract, main_text, op12_main_text

SF = "/root/testdata/sf0.01"
LONG = "The first sentence of the article says something, and it goes on for a while so that it counts. "
P = f"<p>{LONG}</p><p>Second, rather similar, paragraph of the same article with further words in it.</p>"
TEXT = f"{LONG.strip()} Second, rather similar, paragraph of the same article with further words in it."
LINKS = "".join(f'<li><a href="/{i}">Some other story number {i}</a></li>' for i in range(6))
NOTICE = "We use cookies, and other things, to make this page better for you. Please accept them all."


def test_given_pages(spark):
    """The markup of these pages is known, so that the article can be cut out of it."""
    got = {r.page_id: r for r in op12_main_text(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("</?(p|br|h1)>", " ", inner).replace("<b>", "")).split())
        assert (got[r.page_id].text, got[r.page_id].url, got[r.page_id].n_chars) == (want, r.url, len(want))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><ul>{LINKS}</ul></nav><article>{P}</article><footer>{NOTICE}</footer>",
        f"<body><div class='main-menu'><ul>{LINKS}</ul></div><div id=content>{P}</div><div class='site-footer'>{NOTICE}</div>",
        f"<table><tr><td><ul>{LINKS}</ul></td><td>{P}</td></tr></table>",
        f"<div id='cookie-banner'><p>{NOTICE}</p></div><main>{P}</main><aside><p>{LONG}</p></aside>",
        f"<div class='post has-sidebar'>{P}</div><div class=sideBar>{LONG}</div>",
        f"<article>{P}<form><p>{LONG}</p><textarea>{LONG}</textarea></form></article>",
        f"<form action=/x><article>{P}</article></form>",
        f"<article>{P}<div class='ad'>{LONG}</div><script>if (a<b) document.write('<p>no</p>')</script><style>p>a{{}}</style></article>",
        f"<article>{P}</article><section class='comments'>{''.join(f'<article class=comment><p>{LONG * 3}</p></article>' for _ in range(9))}</section>",
        f"<article>{P}</article><ol class=commentlist><li><p>{LONG * 9}</p></li></ol>",
        f"<article>{P}<ul>{LINKS}</ul></article>",
        f"<div><div class=part>{P}</div></div><div hidden>{LONG}</div><div style='display: none'>{LONG}</div><div role=dialog>{LONG}</div>",
        f"<header><p>{LONG}</p></header><article><header><span>By someone</span></header>{P}</article>",
        f"<!-- <p>{LONG}</p> --><article>{P}<!-- > --></article>",
        f"<article>{P}",
        f"<article>{P}</article><footer>{NOTICE}",
        f"<article>{P}<p><a href='x",
        f"<article>{P.replace('The first', 'The <b>fir<i>st</b></i>')}</article>",
        f"<ARTICLE>{P.upper().replace(LONG.upper(), LONG).replace('SECOND, RATHER SIMILAR, PARAGRAPH OF THE SAME ARTICLE WITH FURTHER WORDS IN IT.', 'Second, rather similar, paragraph of the same article with further words in it.')}</ARTICLE>",
    ],
)
def test_templates(page):
    assert main_text(page) == TEXT


def test_siblings_and_headings_stay():
    assert main_text(f"<body><h1>On things</h1><div class=text>{P}</div><p>Last words of it.</p><p><a href=x>More</a></p>") == f"On things {TEXT} Last words of it."
    assert main_text(f"<article><header><h1>On things</h1></header>{P}<h2>Next</h2>{P}</article>") == f"On things {TEXT} Next {TEXT}"
    assert main_text(f"<div class=a>{P}</div><div class=b>{P}</div><div class=c>{P}</div>") == f"{TEXT} {TEXT} {TEXT}"


def test_references_spaces_and_blocks():
    assert main_text("<article><p>a&amp;b &lt;p&gt; &#233;&eacute;&nbsp; c\n\t d</p><p>e<br>f</p>g<i>h</i>i<ul><li>j<li>k</ul></article>") == "a&b <p> éé c d e f ghi j k"
    assert main_text("<article><p>x &amp;amp; y &unknown; & z</p></article>") == "x &amp; y &unknown; & z"


def test_short_empty_and_plain():
    assert main_text(None) == main_text("") == main_text(" \n") == main_text("<html><head><title>x</title></head><body></body></html>") == main_text("<nav>x</nav><article></article>") == ""
    assert main_text("<nav>x</nav><article><h1>Ti.</h1><p>Ti.</p></article><div class=ad>y</div>") == "Ti. Ti."
    assert main_text("no markup, a < b\n at all") == "no markup, a < b at all"
    assert main_text(f"<div class=notice>{P}</div>") == TEXT  # nothing else has any points


def test_long_and_deep_pages():
    began = time.time()
    assert main_text("<article>" + P * 3000 + "</article>") == " ".join([TEXT] * 3000)
    for page in ("<div>" * 50_000 + P, "<b>" * 50_000 + P, "<p>" * 50_000 + P, "</i>" * 50_000 + P, "<li><ul><div>" * 20_000 + "<li>" * 20_000 + P, "<a" * 50_000, "<!--" * 50_000, '<a b="' * 5_000 + P):
        main_text(page)
    assert main_text("<div>" * 50_000 + P).endswith(TEXT[-20:])
    assert time.time() - began < 60


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "u", f"<article>{P}</article>", "t"), (1, "u", f"<article>{P}</article>", "t"), (None, None, None, None), (2, "v", "", "w")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0
