import random
import re
import time
from html.parser import HTMLParser

import pytest

from notewell.llm import html_extract

ARTICLE = "<h1>Title of it</h1>" + "".join(f"<p>Paragraph {k} of the article, with enough words, surely, to be prose.</p>" for k in range(6))
TEXT = " ".join(re.sub("<[^>]*>", " ", ARTICLE).split())
AROUND = ["layout no-sidebar", "with-sidebar", "post-header", "legal-notes", "content comments-open", "page has-banner", "menu-item", "alert", "sidebar", "comments"]


@pytest.mark.parametrize("names", AROUND)
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "%s"])
def test_names_alone_hide_no_article(names, inner):
    beside = "<div class='comments'><p>A reader says this.</p></div>" if names != "comments" else ""
    page = f"<body><nav><a href=x>Menu</a></nav><div class='{names}'>{inner % ARTICLE}</div>{beside}<div class=ad>Buy now</div><footer>foot</footer></body>"
    assert html_extract.extract(page, []) == TEXT


def test_a_form_around_the_page():
    assert html_extract.extract(f"<body><form action=x>{ARTICLE}<input></form><footer>f</footer>", []) == TEXT
    assert html_extract.extract(f"<body><article>{ARTICLE}<form><label>Mail</label> Sign up <input></form></article>", []) == TEXT


def test_letters_that_grow_when_lowered():
    page = f"<body><p>{'İ' * 60}</p><SCRIPT>x</p></ScRiPt ><p>one two three</p><p>four</p></body>"
    assert html_extract.extract(page, []) == "İ" * 60 + " one two three four"


@pytest.mark.parametrize("part", ["<a ", "<a x=\"", "<a '\"", "<div>", "<span>", "<p>a", "<li>", "</b>", "<a<", "<div class=sidebar>", "<div class=a><p>x", "<table><tr><td>x", "<!-", "<!--", "&amp"])
def test_time_grows_with_length(part):
    def seconds(n):
        began = time.process_time()
        html_extract.extract(part * n + "<p>end</p>", ["body/div.a"])
        return time.process_time() - began

    small, large = seconds(5_000), seconds(50_000)
    assert large < 40 * max(small, 0.02)


def test_a_million_characters_of_unclosed_tags():
    text = html_extract.extract("<p>begin</p>" + "<a " * 350_000 + "<p>the end</p>", [])
    assert text.startswith("begin") and text.endswith("the end")


class _All(HTMLParser):
    """Every text of a page without side matter."""

    def __init__(self):
        super().__init__()
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)

    def handle_starttag(self, tag, attrs):
        if tag not in html_extract.INLINE:
            self.parts.append(" ")

    handle_endtag = lambda self, tag: self.handle_starttag(tag, [])


def test_plain_articles_come_out_whole():
    rng = random.Random(3)
    for _ in range(200):
        pieces = []
        for _ in range(rng.randint(1, 12)):
            words = " ".join(rng.choice(["word", "<b>bold</b>", "caf&eacute;", "&lt;tag&gt;", "x&#33;", "<i>it</i>alic", "line\nbreak"]) for _ in range(rng.randint(1, 30)))
            tag = rng.choice(["p", "h2", "blockquote", "li", "div"])
            pieces.append(f"<{tag}>{words}</{tag}>")
        article = "".join(pieces)
        read = _All()
        read.feed(article)
        read.close()
        wanted = " ".join("".join(read.parts).split())
        page = f"<html><body><nav>menu</nav><article>{article}</article><footer>foot</footer></body></html>"
        assert html_extract.extract(page, []) == wanted


def test_paths_win_by_their_share(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div class='t{'abcdefghijkl'[k % 12]}'>{ARTICLE}</div></body>") for k in range(60)]
    rows = spark.createDataFrame([("h.example", h) for _, _, h in pages], "host string, html string")
    (row,) = html_extract.winning_paths(rows).collect()
    assert len(row.paths) == 12
