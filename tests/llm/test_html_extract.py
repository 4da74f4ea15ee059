import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmill.llm import html_extract as h


@pytest.fixture(scope="module")
def field():
    return h.trained()


def plain_article(page):
    """Main text of the tables' pages, which keep it in one article."""
    inner = re.search("<article>(.*)</article>", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(x for x in blocks if x)


def test_pages_of_the_table(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = h.extract(pages.withColumn("raw", F.col("html")), field).collect()
    assert len(rows) == 250
    assert [r["text"] for r in rows] == [plain_article(r["raw"]) for r in rows]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_pages_that_were_not_learnt_from(field):
    right = blocks = wrong = 0
    for page, main in h.made_pages(300, 2024):
        found, main = h.leaf_blocks(page), set(main)
        errors = sum((b.text in main) != k for b, k in zip(found, field.main(found), strict=True))
        right, wrong, blocks = right + (not errors), wrong + errors, blocks + len(found)
    assert right >= 285 and wrong <= 0.005 * blocks


@pytest.mark.parametrize("part", [
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">All</a></li></ul></nav>', '<div class="sidebar"><h3>More</h3><ul><li><a href="/x">Other story</a></li></ul></div>',
    '<div id="cookie-notice"><p>This site uses cookies. You can refuse them.</p><button>Fine</button></div>', '<div class="ad">Buy two for the price of three, today only.</div>',
    '<form><label>Name</label><input name=a><button>Send</button></form>', "<script>var a = '<p>no text</p>';</script>", "<style>p{}</style>", "<!-- <p>note</p> -->",
    '<section class="comments"><h2>Comments</h2><div class="comment"><p>I read this with care, and do not agree at all.</p></div></section>', "<footer>&copy; 2024 Somebody</footer>",
    '<aside>Read more about this, and about that, elsewhere.</aside>', '<header class="site-header"><div>The Daily Name</div></header>',
])
@pytest.mark.parametrize("place", ["before", "after", "inside"])
def test_parts_that_are_no_main_text(field, part, place):
    text = ["A title of some words", "First paragraph of it, with a clause. And a second sentence.", "Short one.", "Last paragraph, somewhat longer than the others, as they are."]
    a, b, c, d = (f"<p>{x}</p>" if i else f"<h1>{x}</h1>" for i, x in enumerate(text))
    if part.startswith("<header") and place == "inside":
        pytest.skip("a header inside an article is the article's own")
    before, inside, after = (part if p == place else "" for p in ("before", "inside", "after"))
    assert field.text(f"<html><body>{before}<article>{a}{b}{inside}{c}{d}</article>{after}</body></html>") == "\n".join(text)


@pytest.mark.parametrize("page, want", [
    ("<p>a<p>b<b>c</b>d", ["a", "bcd"]), ("x < y &amp; z", ["x < y & z"]), ("<p>one\n\t two&nbsp; three<br>four</p>", ["one two three four"]), ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ('<p title="a>b">c</p>', ["c"]), ("<p title='<'>c</p>", ["c"]), ("<a href=x>l</a>ink", ["link"]), ("a<!-- b -->c<!>d<!-->e<?x>f</>g</ h>i", ["acdefgi"]),
    ("<head>no<title>t</title><p>p", ["p"]), ("a<script>b</scriptx>c</script >d", ["ad"]), ("a<SCRIPT>b", ["a"]), ("a<style>b</style", ["a"]), ("a<b", ["a"]), ("a<!-- b", ["a"]), ("&#65;&#x42;&bogus;&amp", ["AB&bogus;&"]),
    ("<template><p>a</template>b<svg><text>c</text></svg>d", ["b", "d"]), ("</p></div>a</li>b", ["a", "b"]), ("<div><td>a</div>b", ["a", "b"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("", []), (None, []), ("a\0b", ["a\0b"]),
    ("<p>a<div>b</div>c</p>d", ["a", "b", "c", "d"]), ("<table><tr><td><div>a</table>b", ["a", "b"]),
])
def test_leaf_blocks(page, want):
    assert [b.text for b in h.leaf_blocks(page)] == want


def test_what_blocks_know():
    blocks = h.leaf_blocks('<body class="has-sidebar"><div class="siteMain"><article id=post-1><p><a href=x>abc</a> de</p></article><div class="comment-list" role=search hidden>x</div></div>')
    assert blocks[0].around == {"k=site", "k=main", "t=article", "k=post"} - {"k=site"} | ({"k=site"} & blocks[0].around)
    assert blocks[0].nearest == {"t=article", "k=post"} and blocks[0].leaf == "p" and blocks[0].linked == 3
    assert blocks[1].nearest == {"k=comment", "r=search", "hidden"} | ({"k=list"} & blocks[1].nearest)


@pytest.mark.parametrize("piece", ["<div>", "<div>a", "</div>", "<a ", "<a x='", '<a x="', "<!--", "<li>", "<td><div></section>", "<table><tr><td>", "<p>a</p>", "&", "<", "<b>", "<script>", "<ul><li>a", "</", "<section><td></section>", "a" * 50 + " "])
def test_reading_is_linear(field, piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    field.text(page)
    assert time.process_time() - began < 20


def test_random_pages_are_read(field):
    rng = random.Random(4)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "<head>", "</head>", "<svg>", "</svg>", "<a>", "</a>", "x ", "<br>", "<dt>", "<dl>", "</td>", "<option>", "<select>", "<!-- -->", "</body>"]
    for _ in range(3000):
        page = "".join(rng.choices(pieces, k=rng.randint(1, 30)))
        assert set(field.text(page)) <= {"x", " ", "\n"}


def test_viterbi_finds_the_best_labels():
    rng = random.Random(5)
    names = ["t=article", "t=nav", "nearest:t=article", "nearest:t=nav", "leaf=p", "size=1", "size=2", "link=0", "first", "last", "bias", "nothing near", "ends"]
    for _ in range(60):
        field = h.Field({n: rng.gauss(0, 1) for n in names}, np.array([[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"]), np.array([rng.gauss(0, 1) for _ in "ab"]))
        blocks = h.leaf_blocks("".join(rng.choice(["<article><p>", "<nav>", "<p>", "</nav>", "</article>", "text. ", "a longer piece of text "]) for _ in range(12)))[:8]
        if not blocks:
            continue
        emit = [sum(field.weights.get(n, 0) for n in ["bias", *h._names(f)]) for f in h.features(blocks)]
        value = lambda y: field.first[y[0]] + sum(e * k for e, k in zip(emit, y, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert value([int(k) for k in field.main(blocks)]) == pytest.approx(value(best))


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(6)
    score, step, first = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = (5, 3, 1)
    real = np.arange(5) < np.array(lengths)[:, None]
    marginal, both, total = h.likelihood(np.where(real, score, 0), step, first, real)
    want, pairs, log = np.zeros((3, 5)), np.zeros((2, 2)), 0.0
    for i, n in enumerate(lengths):
        ys = list(itertools.product((0, 1), repeat=n))
        w = np.exp([first[y[0]] + sum(score[i, t] * y[t] for t in range(n)) + sum(step[a, b] for a, b in itertools.pairwise(y)) for y in ys])
        log += np.log(w.sum())
        for y, p in zip(ys, w / w.sum(), strict=True):
            want[i, :n] += p * np.array(y)
            for a, b in itertools.pairwise(y):
                pairs[a, b] += p
    assert np.allclose(marginal, want) and np.allclose(both, pairs) and np.isclose(total, log)


def test_edges(spark, field):
    schema = "page_id long, url string, html string, text string, n_chars string, extra int"
    page = "<article><p>Some words of an article.</p></article>"
    rows = [(1, "u", None, "old", "old", 1), (2, None, "", None, None, 2), (None, "u", page, "old", "old", 3), (4, "u", page, "old", "old", 4), (4, "u", page, "old", "old", 4), (5, "u", page * 20_000, "", "", 5)]
    got = {(r["page_id"], r["extra"]): r for r in h.extract(spark.createDataFrame(rows, schema), field).collect()}
    assert [got[k]["text"] for k in ((1, 1), (2, 2), (None, 3), (4, 4))] == ["", "", "Some words of an article.", "Some words of an article."]
    assert got[5, 5]["n_chars"] == 20_000 * 26 - 1
    assert h.extract(spark.createDataFrame([], schema), field).count() == 0
    with pytest.raises(ValueError, match="labelled pages"):
        h.train([])
