"""Main text: the scan against brute force, pages by hand, labelled pages, and tables with odd rows and names."""

import html
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import maintext

SF = "/root/testdata/sf0.01"
A = "<p>" + " ".join(f"word{i}" for i in range(30)) + "</p>"


def plain_stretches(scores):
    """The best stretch, then the same to its left and right, by trying every stretch."""
    if not scores:
        return []
    total, a, b = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (x[0], -(x[2] - x[1]), -x[1]))
    if total <= 0:
        return []
    return [*plain_stretches(scores[:a]), (a, b, total), *[(x + b, y + b, s) for x, y, s in plain_stretches(scores[b:])]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-1000, 1000), max_size=14))
def test_scan_finds_all_maximal_stretches(scores):
    scores = [1024 * s + 2**i % 1021 for i, s in enumerate(scores)]  # hardly any ties
    assert maintext.stretches(scores) == plain_stretches(scores)


def shown(page, weights=None):
    return maintext.main_text(page, weights or maintext.Weights()).replace(A[3:-4], "A").split("\n\n")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div>{A}<p class='advert'>buy this now</p>{A}<p class=\"comment\">I liked it</p><p>x <span hidden>secret</span> y z</p></div>", ["A", "A", "x y z"]),
        (f'<div>{A}<p>see <a title="a > b" href="x">this link</a> here</p></div>', ["A", "see this link here"]),
        (f'<div>{A}<ul><li>one two three<li class="ad">buy it<li>four five six</ul>{A}</div>', ["A", "one two three", "four five six", "A"]),
        (f'<article><header><h1>Head line</h1></header>{A}<div class="article-header"><h2>Sub head</h2></div>{A}</article>', ["Head line", "A", "Sub head", "A"]),
        (f'<article>{A}<div class="social-history"><p>the history of the town</p></div></article>', ["A", "the history of the town"]),
        (f"<div class='content with-sidebar'>{A}</div>", ["A"]),
        (f"<table class='fixed-header'><tr><td>{A}</td></tr></table>", ["A"]),
        (f"<body>{A}<svg width=3 />{A}</body>", ["A", "A"]),
        (f"<div class='site-header'>The site of us</div><nav><a href=/>Home</a></nav><h1>T</h1>{A}<div class=share>tweet</div>{A}<div class='comments'>{A}{A}</div><form><label>Mail</label></form><footer>c 2024</footer>", ["T", "A", "A"]),
        (f"<article>{A}<aside class='related'><ul>{'<li><a href=z>Some other story of ours</a></li>' * 20}</ul></aside>{A}</article>", ["A", "A"]),
        (f"<aside>{A}{A}{A}</aside>{A}", ["A"]),
        ("<p>a&nbsp;\n b<br>c &amp;lt; <script>var x = '<p>';</script></p>", ["a b c &lt;"]),
        ("<nav>a b</nav>", [""]),
        ("", [""]),
    ],
)
def test_pages(page, want):
    assert shown(page) == want


def test_odd_pages_end():
    for odd in ("<", "<p", "<!-- x", "<script>x", "</p></div>", "<" * 100_000, "<a '" * 20_000 + ">", "<b>" * 30_000, "<div>" * 20_000 + "x"):
        maintext.main_text(odd, maintext.Weights())


def fitted(pages):
    words, tags = {}, {}
    for page in pages:
        seen = maintext.observe(page)
        if seen:
            for all_of, part in zip((words, tags), seen, strict=True):
                for place, n in part.items():
                    old = all_of.get(place, [0, 0])
                    all_of[place] = [old[0] + n[0], old[1] + n[1]]
    return maintext.fit(words, tags)


def test_weights_are_learned():
    page = f"<div class=zq7>Words that no list knows of stand here</div><article><h1>T</h1>{A}</article>"
    assert shown(page.replace("article", "div")) == ["Words that no list knows of stand here", "T", "A"]
    weights = fitted([page] * 5)
    assert weights.places[".zq7"] < 0 and shown(page.replace("article", "div"), weights) == ["T", "A"]
    assert maintext.observe("<p>no label</p>") is None and fitted([]) == maintext.Weights()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_labelled_pages(spark, monkeypatch):
    """The texts are those of the article elements, found by a plain expression, and the scan is what finds them."""

    def plain(page):
        article = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if part.startswith("<br") else "", part)).split()) for part in re.split("</?(?:p|h1)>", article.replace("<br>", "<br> "))]
        return "\n\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = maintext.fit_pages(pages)
    found = {r.page_id: r for r in maintext.extract(pages, weights).collect()}
    assert len(found) == pages.count() and all(r.text == plain(r.html) for r in found.values())
    without_article = {k: r.html.replace("article>", "div>") for k, r in found.items()}
    assert all(maintext.main_text(page, weights) == found[k].text for k, page in without_article.items())
    monkeypatch.setattr(maintext, "stretches", lambda scores: [(0, len(scores), 0.0)])
    assert not any(maintext.main_text(r.html, weights) == r.text for r in found.values())


def test_tables(spark):
    rows = [(1, None, "x", "s"), (2, "", "y", None), (3, "<p>a b</p>", None, "s"), (3, "<p>a b</p>", None, "s"), (None, "<p>c d</p>" * 20_000, "z", "t")]
    pages = spark.createDataFrame(rows, "page_id long, `page.html` string, TEXT string, source string")
    weights = maintext.fit_pages(pages, source="page.html")
    done = maintext.extract(pages, weights, source="page.html")
    assert done.columns == ["page_id", "page.html", "source", "text"]
    got = sorted(((r.page_id, r.source, len(r.text)) for r in done.collect()), key=str)
    assert got == sorted([(1, "s", 0), (2, None, 0), (3, "s", 3), (3, "s", 3), (None, "t", 100_000 - 2)], key=str)
    empty = pages.limit(0)
    assert maintext.fit_pages(empty, source="page.html") == maintext.Weights() and maintext.extract(empty, weights, source="page.html").count() == 0


def test_what_shares_the_main_element_stays_and_readers_comments_go():
    body = "<p>" + "The long body of the article goes on with many words and sentences. " * 20 + "</p>"
    advert = "<div class='advert'>Buy cheap shoes now and save a lot of money today my friends</div>"
    talk = "<section class='discussion'><p>Great article, I liked reading it so very much.</p><p>I disagree with all of it, and so does everyone.</p></section>"
    for tag in ("article", "main", "div id='x1'"):
        page = f"<html><body><nav><a href='/'>Home</a></nav><{tag}><p>Short intro here.</p>{advert}{body}{advert}<p>The end.</p></{tag.split()[0]}>{talk}</body></html>"
        text = maintext.main_text(page, maintext.Weights())
        assert text.startswith("Short intro here.\n\nThe long body") and text.endswith("The end."), tag
        assert "shoes" not in text and "disagree" not in text
    loose = f"<html><body>{body}{advert}<p>Copyright line.</p></body></html>"  # no element of its own: only what comes near the best counts
    assert "shoes" not in maintext.main_text(loose, maintext.Weights())
