import random
import re
from html import unescape

import pytest

from lexloom.llm import html_text
from lexloom.llm.html_text import Page, extract_text, main_text

ARTICLE = "<h1>A title of it</h1><p>First paragraph of some length, with words.</p><p>Second paragraph, also of some length.</p>"
WANT = "A title of it\n\nFirst paragraph of some length, with words.\n\nSecond paragraph, also of some length."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{ARTICLE}</article><footer>&copy; all</footer></body></html>",
        f"<body><div class=ad>Buy this now, it is very cheap and good for you.</div><main>{ARTICLE}</main>",
        f"<body><header><h1>Site name</h1></header><div id=content>{ARTICLE}</div><aside>Something else entirely that is long enough to matter here.</aside>",
        f"<body><div class='cookie-notice'>We use cookies for a good many reasons, all of them long.</div><div>{ARTICLE}</div>",
        f"<body><div role=navigation>a b c</div><div>{ARTICLE}</div><section id=comments><article class=comment><p>I disagree with all of this, at great length.</p></article></section>",
        f"<body><div>{ARTICLE}</div><form><p>Subscribe to our newsletter today please</p><input></form><script>var a = '<p>no</p>';</script>",
        f"<body><div hidden><p>Not to be seen by anyone at all, ever.</p></div><!-- <p>comment</p> --><article>{ARTICLE}",
        f"<body class='has-sidebar'><div class='container'><div class='article-header'></div><article><header><h1>A title of it</h1></header>{ARTICLE.split('</h1>')[1]}</article><div class='sidebar'><p>Side matter that runs on and on and on.</p></div></div>",
    ],
)
def test_articles(page):
    assert main_text(page) == WANT


def test_broken_markup_and_references():
    assert main_text("<article><h1>T</h1><p><b>one<br>two<p>three &amp; &lt;b&gt; &eacute;&#8364;&nbsp;x</article>") == "T\n\none two\n\nthree & <b> é€ x"
    assert main_text("<article><p>a < b and c > d</p><p title='x>y'>e</p><p title=\"open>f</p></article>") .startswith("a < b and c > d\n\ne")
    assert main_text("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table></article>") == "one\n\ntwo\n\nx\n\ny\n\nz"
    assert main_text("<article><p>a</b></i></p></div></span>b</article>c") == "a\n\nb"
    assert main_text("<p>just\n\t text</p>") == "just text"
    assert main_text("plain text, no tags") == "plain text, no tags"
    assert main_text("<article><p>end<") == "end<" and main_text("<article><p>end<b") == "end"


def test_nothing():
    for page in (None, "", "<html></html>", "<nav>menu</nav>", "<script>x", "<!-- open"):
        assert main_text(page) == ""


def test_deep_and_long():
    assert main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    text = "word " * 200_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()


def test_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, f"<article>{ARTICLE}</article>", "x"), (1, None, f"<article>{ARTICLE}</article>", "x"), (None, "u", None, None)]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted([(1, None, WANT, len(WANT))] * 2 + [(None, "u", "", 0)], key=str)
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


TALK = "Matter that belongs to the article, and is long enough to be text in its own right."


@pytest.mark.parametrize(
    "inner, want",
    [
        (f'<h2 id="recommended-settings">Recommended settings</h2><p>{TALK}</p>', f"Recommended settings\n\n{TALK}"),
        (f'<section id="related-work"><h2>Related work</h2><p>{TALK}</p></section>', f"Related work\n\n{TALK}"),
        (f'<h2 id="reactions">Reactions</h2><p class="notice">{TALK}</p>', f"Reactions\n\n{TALK}"),
        (f'<div class="widget banner"><p>{TALK}</p></div>', TALK),
        ('<p>See <a href="/hidden-gems">the gems</a> and <a href="?id=ad">more</a> of it.</p>', "See the gems and more of it."),
        ('<p title="a hidden valley">A valley.</p><p data-hidden="false">Shown.</p><p data-id="ad-3">Kept.</p>', "A valley.\n\nShown.\n\nKept."),
        ("<p title='class=ad'>One.</p><p data-style=\"display:none\">Two.</p><p title=\"it's hidden\">Three.</p>", "One.\n\nTwo.\n\nThree."),
        ('<div class="share"><a href=a>Post it</a> <a href=b>Mail it</a></div><ul class="related"><li><a href=c>Another title</a><li><a href=d>And another</a></ul><p>In.</p>', "In."),
        (f'<h2 id="related"><a href="#related">Related</a></h2><div class="related"><p>{TALK} <a href=c>Its source</a></p></div>', f"Related\n\n{TALK} Its source"),
        ('<article class="comment"><p>I disagree.</p></article><p>In.</p>', "In."),
        ('<p hidden>Out.</p><p HIDDEN="">Out.</p><p aria-hidden=true>Out.</p><p style="display: none">Out.</p><div role="alert">Out.</div><p>In.</p>', "In."),
    ],
)
def test_words_do_not_drop_what_an_article_holds(inner, want):
    assert main_text(f"<body><article>{ARTICLE}{inner}</article><footer>all</footer></body>") == f"{WANT}\n\n{want}"
    assert main_text(f"<body><main>{ARTICLE}{inner}</main></body>") == f"{WANT}\n\n{want}"


def test_headings_and_paragraphs_outside_an_article():
    page = f'<body><div><h1>A title of it</h1><h2 id="related-matters">Related matters</h2><p class="share">{TALK}</p><p data-id="ad-3">{TALK}</p></div><div class=ad><p>{TALK}</p></div></body>'
    assert main_text(page) == f"A title of it\n\nRelated matters\n\n{TALK}\n\n{TALK}"


def test_an_article_is_not_dropped_for_a_word():
    for attributes in ('data-comments="3" class="post sponsored related"', 'id="comment-on-the-law"', 'class="comments-open"'):
        assert main_text(f"<body><article {attributes}>{ARTICLE}</article>") == WANT


def pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()


def article_text(page):
    """What stands in the only article of a page that has just headings, paragraphs, b and br."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = re.split("</?(?:h1|p)>", inner)
    return "\n\n".join(x for x in (" ".join(unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks) if x)


def test_pages_as_they_are_and_without_their_telling_tags():
    plain = [re.sub("</?article>", lambda m: m[0].replace("article", "div"), p) for p in pages()]
    for p, q in zip(pages(), plain):
        assert main_text(p) == article_text(p)
        assert main_text(q) == article_text(p)


def test_the_density_decides(monkeypatch):
    """Neither tags nor words find the text by themselves: another measure finds other text."""
    found = [main_text(p) for p in pages()]
    r = random.Random(0)
    monkeypatch.setattr(html_text.Page, "density", lambda self, node, links: r.random())
    assert any(main_text(p) != x for p, x in zip(pages(), found))
    monkeypatch.setattr(html_text.Page, "density", lambda self, node, links: self.link_chars[node] / max(1, self.chars[node]))
    assert all(main_text(p) != x for p, x in zip(pages(), found))


@pytest.mark.parametrize("seed", range(20))
def test_density_sums_against_a_plain_tree(seed):
    """Sums over children, by recursion; the subtree of the greatest sum is chosen."""
    r = random.Random(seed)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return ("p", "w" * r.randint(1, 60), [])
        return ("div", "", [tree(depth - 1) for _ in range(r.randint(1, 4))])

    def html(t):
        return f"<{t[0]}>{t[1]}{''.join(map(html, t[2]))}</{t[0]}>"

    def chars(t):
        return len(t[1]) + sum(map(chars, t[2]))

    def tags(t):
        return sum(1 + tags(c) for c in t[2])

    def density(t):
        import math

        c, n = chars(t), max(1, tags(t))
        return c / n * math.log(c * n) / math.log(math.log(1 + math.e))

    def walk(t):
        yield t
        for c in t[2]:
            yield from walk(c)

    body = ("body", "", [tree(4) for _ in range(3)])
    page = Page("".join(map(html, body[2])))
    nodes = list(walk(body))
    density_, total = page.densities()
    assert total == pytest.approx([sum(map(density, t[2])) for t in nodes])
    best = max(range(len(nodes)), key=lambda i: total[i])
    assert not total[best] or best in page.content()


def test_reader_comments_go_and_notices_of_an_article_stay():
    comments = '<section class="comments"><p>I read this with great interest, and I disagree.</p></section>'
    for box in ("article", "div"):
        assert main_text(f"<body><{box}>{ARTICLE}{comments}</{box}></body>") == WANT
    assert main_text(f'<body><article>{ARTICLE}<div class="notice promotion"><p>{TALK}</p></div><p class="share related">{TALK}</p><math>x</math></article>').startswith(f"{WANT}\n\n{TALK}\n\n{TALK}")


def test_an_article_of_a_few_words_among_longer_adverts():
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>An advert that has far more words than the article itself, and goes on.</div><article><h1>Few words.</h1><p><b>Few words.<br></article><footer>all of it</footer></body>"
    assert main_text(page) == "Few words.\n\nFew words."


def test_sections_belong_together():
    one = f"<section><h2>One</h2>{'<p>' + TALK + '</p>'}{'<p>' + TALK + '</p>'}</section>"
    two = "<section><h2>Two</h2><ul><li>a</li><li>b</li></ul></section>"
    got = main_text(f"<body><nav>menu</nav><div class=ad>Buy.</div><div><h1>T</h1>{one}{two}<div>A line of text without a paragraph, in a box.</div></div></body>")
    assert got == f"T\n\nOne\n\n{TALK}\n\n{TALK}\n\nTwo\n\na\n\nb\n\nA line of text without a paragraph, in a box."
