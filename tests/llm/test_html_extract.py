import itertools
import random
import time

import numpy as np
import pytest

from docloom.llm import html_extract as H

CHROME = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>x";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">Alpha</a></li></ul></nav>
<div class="cookie-banner">We use cookies on this site, please accept them all.</div>
<div id="sidebar"><h3>Popular</h3><p>A side story that is long enough to look like a text of its own, really.</p></div>
<article><h1>The title &amp; more</h1><p>First  <b>bold</b>\n text of the article, with &eacute; and a <a href="x">link</a>.</p><div class="ad">Buy this now!</div>
<p>Second paragraph<br>goes on.<p>Third, unclosed.</p><form><label>Name</label><input value="q"><button>Send</button></form></article>
<section class="comments"><p>Reader comment: this is a very long comment that says nothing about it, but at length.</p></section>
<footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize(("page", "text"), [
    (CHROME, "The title & more First bold text of the article, with é and a link. Second paragraph goes on. Third, unclosed."),
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""),
    ("<article><p>Open to the end of it all", "Open to the end of it all"),
    ("<article><p>One.</p></div></p><p>Two.</p></article>", "One. Two."),
    ("<body><article><!-- <p>no</p> --><p>a&nbsp;&nbsp;b &lt;c&gt;</p><script>1</script></article></body>", "a b <c>"),
])
def test_pages(page, text):
    assert H.extract(page) == text


LONG = "This paragraph goes on for a while, so that it is plain prose, and then it comes to its end."


@pytest.mark.parametrize(("page", "text"), [
    (f'<article><section id="search-algorithms"><p>{LONG}</p></section><section id="share-prices"><h2 id="comments">Prices</h2><p>{LONG}</p></section></article>', f"{LONG} Prices {LONG}"),
    (f'<article><div class="post-header"><h1>Its title</h1></div><div class="form-validation-guide"><p>{LONG}</p></div></article>', f"Its title {LONG}"),
    (f'<main><p>{LONG}</p><p>Oh no</p><p>{LONG}</p><ul><li>one, with words</li><li>two, with words</li></ul><p>{LONG}</p></main>', f"{LONG} Oh no {LONG} one, with words two, with words {LONG}"),
    (f'<body><div class="topnav"><a href="/">Home</a> <a href="/b">Blog</a></div><div id="content"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class="rightSidebar"><p>{LONG}</p></div><div class="ad-slot"><p>{LONG}</p></div></body>', f"Head {LONG} {LONG}"),
    (f'<body><article><p>{LONG}</p><p>{LONG}</p><div class="share-buttons"><span>Tell your friends about this!</span></div></article><ol class="comment-list"><li><p>{LONG}</p></li></ol><div role="complementary"><p>{LONG}</p></div><p hidden>{LONG}</p><div style="display: none"><p>{LONG}</p></div></body>', f"{LONG} {LONG}"),
    (f'<body><header class="site-header">Some Site</header><div class="story"><header><h1>Inner head of it.</h1></header><p>{LONG}</p></div><div class="newsletter-signup"><p>{LONG}</p></div></body>', LONG),
])
def test_names_and_neighbours(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize(("name", "kind"), [("comment-list", -1), ("site-header", -1), ("post-header", 0), ("search-algorithms", 0), ("search", -1), ("main-content", 1), ("sidebar-content", -1), ("post_content", 1), ("leftNav", -1), ("btn", 0), ("", 0), ("related-posts", -1), ("adSlot", -1), ("content", 1)])
def test_names(name, kind):
    assert H.name_kind(name) == kind


def test_the_cut_decides():
    """Weak blocks follow their neighbours: own signs alone leave words out and let words in."""
    page = f"<body><div><p>{LONG}</p><p>Not so.</p><p>{LONG}</p></div><ul><li><a href='/1'>A link here</a></li><li>Short, plain one.</li><li><a href='/2'>Another link</a></li><li><a href='/3'>More links</a></li></ul></body>"
    blocks = H.read(page)
    own = H.costs(blocks, H.STATED)
    kept = H.min_cut(own, H.ties([b[4] for b in blocks]))
    assert [b[0] for b, k in zip(blocks, kept, strict=True) if k] == [LONG, "Not so.", LONG]
    assert sum((c > 0) != k for c, k in zip(own, kept, strict=True)) >= 1


def test_fitted_weights():
    """The fit is the least of the drawn loss: its gradient vanishes, and small steps away are worse."""
    rng = np.random.default_rng(3)
    x, y = rng.random((300, len(H.FEATURES))), rng.integers(0, 2, 300)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    loss = lambda w: (share * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + 0.5 * (H.DRAWN * (w - H.STATED) ** 2).sum()
    w = H.fit(x, y)
    assert all(loss(w) <= loss(w + 1e-3 * rng.standard_normal(len(w))) for _ in range(200))
    assert (H.fit(x, np.zeros(300, int)) == H.STATED).all() and (H.fit(x[:0], y[:0]) == H.STATED).all()


def test_large_weak_page():
    rng = random.Random(5)
    scores = [rng.uniform(-0.5, 0.5) for _ in range(20_000)]
    edges = {(i, i + 1): 1.5 for i in range(len(scores) - 1)} | {(i, i + 3): 0.4 for i in range(len(scores) - 3)}
    assert len(H.min_cut(scores, edges)) == len(scores)


def test_min_cut():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 8)
        scores = [rng.choice([-2, -1, 0.5, 1, 3]) * rng.random() for _ in range(n)]
        edges = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda side: sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, side)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])  # noqa: B023, B905, E731
        assert cost(H.min_cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product([True, False], repeat=n))))


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", CHROME, "x"), (1, "u", CHROME, "x"), (None, None, None, "x"), (3, "v", "<article>" + "<p>w</p>" * 3000, "x")], "page_id long, url string, html string, text string")
    got = H.extract_pages(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 110, 110, 5999]
    assert H.extract_pages(df.limit(0)).count() == 0
    assert H.train(df).shape == H.STATED.shape and (H.train(df.limit(0)) == H.STATED).all()


@pytest.mark.parametrize(("page", "text"), [
    ("<article><h1>Prices</h1><table><tr><th>Item</th><th>Price</th></tr><tr><td>Apple</td><td>10</td></tr></table></article>", "Prices Item Price Apple 10"),
    ("<article><h1>Links</h1><ul><li><a href='/1'>First link item</a></li><li><a href='/2'>Second</a></li><li><a href='/3'>Third</a></li></ul></article>", "Links First link item Second Third"),
    ("<article><h2>Author</h2><p>Copyright law is old.</p><p>So.</p><p>Oh</p></article>", "Author Copyright law is old. So. Oh"),
    (f"<article><div class='legal'><p>{LONG}</p></div><section id='notice'><p>Short.</p></section><div class='popular-science'>Yes</div></article>", f"{LONG} Short. Yes"),
    (f"<article class='social'><p>{LONG}</p></article>", LONG),
    (f"<div class='widget'><main><p>{LONG}</p></main></div>", LONG),
    (f"<article><p>{LONG}</p><article class='comment'><p>{LONG}</p></article><div class='share-links'>Tell a friend</div><footer>By me</footer></article>", LONG),
])
def test_articles_are_kept_whole(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    """Articles of all kinds of blocks among all kinds of chrome: the text is the article's, block for block."""
    rng = random.Random(seed)
    words = "copyright legal notice social note item the of and price law search 12 7.5 & © share".split()
    said = []

    def line(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, n))) + rng.choice(["", ".", "!", ":"])
        return text, text.replace("&", "&amp;")

    def own(n=9):
        text, html = line(n)
        said.append(text)
        return html

    def block():
        kind = rng.randrange(9)
        if kind == 0:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{own(4)}</td>" for _ in range(rng.randrange(1, 4))) + "</tr>" for _ in range(rng.randrange(1, 4))) + "</table>"
        if kind == 1:
            return "<ul>" + "".join(f"<li><a href='/x'>{own(5)}</a></li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if kind == 2:
            return f"<h2 id='comments'>{own(4)}</h2>"
        if kind == 3:
            return f"<div class='{rng.choice(['legal', 'popular-science', 'social', 'search-results', 'note', 'copyright'])}'><p>{own(30)}</p></div>"
        if kind == 4:
            return f"<dl><dt>{own(3)}<dd>{own(12)}</dl>"
        if kind == 5:
            return f"<section id='{rng.choice(['notice', 'share', 'x', 'related'])}'><p>{own(20)}</p></section>"
        if kind == 6:
            return f"<figure><img src=x><figcaption>{own(7)}</figcaption></figure><pre><code>{own(6)}</code></pre>"
        return f"<p>{own(60)}</p>"

    def chrome():
        text = line(40)[1]
        return rng.choice(["<nav><ul><li><a href='/'>%s</a></li></ul></nav>", "<aside><p>%s</p></aside>", "<div class='advert'><p>%s</p></div>", "<form><label>%s</label><input></form>", "<script>%s</script>", "<div class='cookie-notice'>%s</div>", "<div role='navigation'>%s</div>", "<footer><p>%s</p></footer>", "<div class='share-buttons'><span>%s</span></div>", "<section class='comments'><article class='comment'><p>%s</p></article></section>", "<div class='related-posts'><a href='/y'>%s</a></div>"]) % text

    body = []
    for _ in range(rng.randrange(1, 25)):
        body.append(block())
        if rng.random() < 0.3:
            body.append(chrome())
    around = [chrome() for _ in range(6)]
    root = rng.choice(["article", "main"])
    page = f"<html><body><header>Site</header>{''.join(around[:3])}<{root}>{''.join(body)}</{root}>{''.join(around[3:])}</body></html>"
    assert H.extract(page) == " ".join(said)


@pytest.mark.parametrize("page", [
    "<span>" * 80_000 + "</div>" * 80_000, "<div>x" * 170_000, "<p>a" * 200_000, "<li><table>" + "</li>" * 180_000, "<b>" * 100_000 + "x</i>" * 100_000, "<div><span>" * 90_000 + "</p>" * 1000, "<script " * 120_000, "<!--" * 200_000, "<" * 900_000,
    "<ul>" + "<li><a href=x>b c" * 60_000, "<article>" + "<div class=ad>x</div><p>y" * 40_000,
])
def test_hostile_pages_are_read_in_linear_time(page):
    began = time.thread_time()
    H.extract(page)
    assert time.thread_time() - began < 20
