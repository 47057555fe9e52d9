import html
import re

import numpy as np
import pytest

from emberframe.llm import htmltext as H
from emberframe.llm import queries


@pytest.fixture(scope="module")
def forest():
    return H.train(400)


def test_held_out_pages(forest):
    """Exact main text of pages that training has not seen."""
    pages = [H.training_page(77_000_000 + i) for i in range(150)]
    got = H.main_text([p for p, _ in pages], forest)
    assert sum(g == "\n\n".join(t) for g, (_, t) in zip(got, pages, strict=True)) >= 145


def test_whole_table(spark, sf_dir):
    """The test pages keep their text in one article of headings and paragraphs."""
    rows = {r.page_id: r for r in queries.op9_html_main_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert rows[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_dom():
    page = '<p>a <b>b<br>c</b> d<p>e<ul><li>x<li>y &amp; z</ul><script>if (a < b) {}</script><div hidden>h</div>&eacute;<!-- no --> t <table><tr><td>1<td>2<tr><td>3</table>'
    texts = [" ".join(t.split()) for n in H.dom(page) for _, t in sorted(n.runs)]
    assert sorted(texts) == sorted(["a b c d", "e", "x", "y & z", "h", "é t", "1", "2", "3"])
    for odd in ("", "<", "<p", "</p></p>", "<a><a><a>", "x<b", "<p>" * 3000 + "x", "<!-- open", '<a href="x', "a" * 500_000):
        H.features(H.dom(odd))


def test_decoding_is_consistent():
    r = np.random.default_rng(5)
    nodes = H.dom("<div><section><p>a</p><div><p>b</p><p>c</p></div></section><nav><p>d</p></nav></div>" * 4)
    best = lambda odds: H.decode(nodes, odds)
    for _ in range(50):
        chosen = best(r.normal(0, 3, len(nodes)))
        for i, n in enumerate(nodes):
            if i and chosen[i]:
                # above an inner node: only inner nodes, up to where main text begins
                p, seen_out = n.parent, False
                while p > 0:
                    seen_out |= not chosen[p]
                    assert not (seen_out and chosen[p])
                    p = nodes[p].parent


def test_boosting_learns():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = H.boost(x[:2000], y[:2000], trees=30)
    assert ((f.odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_odd_rows(spark, forest):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><h1>T</h1><p>Some words. And more of them here.</p></article>", "x"), (3, "u", "<nav><a href='/'>home</a></nav>", "x"), (3, "u", "<nav><a href='/'>home</a></nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in H.extract(df, forest).collect()]
    assert got[0] == (1, "u", "") and got[1] == (2, None, "") and got[2] == (None, "u", "T\n\nSome words. And more of them here.")
    assert len(got) == 5 and got[3] == got[4]
    assert H.extract(df.limit(0), forest).count() == 0


def test_places_among_hundreds_of_siblings():
    nodes = H.dom("<article>" + "".join(f"<p>{'w' * (j + 1)}</p>" for j in range(300)) + "</article>")
    x = H.features(nodes)
    at = nodes[1].children
    assert len(at) == 300 and x[at, 12].tolist() == list(range(300)) and x[at, 13].tolist() == list(range(299, -1, -1))
    assert x[at[200], 10] == pytest.approx(np.log1p(201), rel=1e-6)


def test_long_held_out_pages(forest):
    """Blocks of main text on pages with hundreds of siblings that training has not seen."""
    pages = [H.training_page(88_000_000 + i, 70 + 10 * i) for i in range(30)]
    right = wrong = 0
    for got, (_, text) in zip(H.main_text([p for p, _ in pages], forest), pages, strict=True):
        a, b = set(got.split("\n\n")), set(text)
        right += len(a & b)
        wrong += len(a ^ b)
    assert wrong / (right + wrong) < 0.02


def test_unclosed_elements_lose_no_text(forest):
    long = "This is a paragraph of the main text, long enough to be told from a menu."
    for bit in ("<button>Go", "<select><option>One", "<svg><path d='x'>", "<math><mi>x", "<canvas>", "<object data='x'>", "<template>", "<textarea>", "<noscript>", "<iframe src='x'>", "<div><canvas></div>", "<span><button>Go</span>"):
        text = H.main_text([f"<html><body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>{long}</p>{bit}<p>{long} Again.</p><p>{long}</p></article></body></html>"], forest)[0]
        assert [p for p in text.split("\n\n") if p.startswith("This")] == [long, f"{long} Again.", long], bit
        assert "Go" not in text and "One" not in text
    kept = H.main_text([f"<article><p>{long}</p><button><div>Go</div></button><object><object>a</object>b</object><p>{long}</p></article>"], forest)[0]
    assert kept == f"{long}\n\n{long}"


def test_time_follows_length(forest):
    """Hostile markup of a megabyte: each case took hours or its square when tags were rescanned."""
    import time

    n = 100_000
    cases = ["<a " * (3 * n), '<a "' * n, "<!" * n, "<" * n, "<a&eacute;é" * n, "<button>" * n, "<canvas>" * n + "</canvas>", "<style>" * n, "<head>" * n, "<p>x" * n, "<div>" * n + "</b>" * n, "<ul>" + "<i>" * n + "<li>x" * n, "<b><div>" + "<i>" * n + "</b>" * n]
    for page in cases:
        t = time.process_time()
        H.main_text([page], forest)
        assert time.process_time() - t < 30, page[:20]
    assert H.main_text(["<article>" + "<p>Some words of the text. And some more of it." * n + "</article>"], forest)[0].count("\n\n") == n - 1


P = "The harvest festival returned to the valley this week after a break of three years."
Q = "Organisers said that some four thousand visitors came on the first day, more than they had expected."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>{P}</p>", P), (P, P), ("<p>Hello.</p>", "Hello."), (f"<html><body>{P}</body></html>", P), (f"{P}<br>{Q}", f"{P} {Q}"), (f"{P}<hr>{Q}", f"{P}\n\n{Q}"),
        (f"<html><body><p>{P}</p><p>Short one.</p></body></html>", f"{P}\n\nShort one."), (f"<html><body><h1>Title here</h1><p>{P}</p><p>{Q}</p></body></html>", f"Title here\n\n{P}\n\n{Q}"),
        (f"<html><body><div><a href='/'>Home</a> / <a href='/a'>About us</a></div><div><h1>Harvest festival</h1><p>{P}</p><p>{Q}</p></div><div>&copy; 2024 Valley News</div></body></html>", f"Harvest festival\n\n{P}\n\n{Q}"),
        (f"<body><div><div><div><a href=/>Home</a> | <a href=/x>Contact</a></div><div><p>{P}</p><p>{Q}</p></div><div>Copyright 2020 Somebody</div></div></div></body>", f"{P}\n\n{Q}"),
        (f"<body><table><tr><td>{P}</td></tr><tr><td>{Q}</td></tr></table></body>", f"{P}\n\n{Q}"),
        (f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T one</h1><p>{P}</p></article><footer>c</footer></body>", f"T one\n\n{P}"),
        ("<body><p>Вчера в городе открылась новая библиотека для детей.</p><p>Она работает каждый день до восьми часов.</p></body>", "Вчера в городе открылась новая библиотека для детей.\n\nОна работает каждый день до восьми часов."),
    ],
)
def test_pages_the_generator_does_not_write(forest, page, want):
    """Text that stands alone or without a container, containers without names, other scripts."""
    assert H.main_text([page], forest) == [want]
