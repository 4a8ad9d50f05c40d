import pytest

from docloom.functions.article import article
from docloom.operators.articles import articles

CHROME = [
    '<div class="ad">PLANTED one</div>', '<div class="sidebar-left"><div>PLANTED</div><p>PLANTED</div>', '<ul class="main-menu"><li>PLANTED<li>PLANTED</ul>', '<nav>PLANTED</nav>',
    '<div role="navigation">PLANTED</div>', '<div class="Comments"><article>PLANTED</article></div>', '<p class="share">PLANTED', "<aside>PLANTED</aside>", '<section class="related"><h2>PLANTED</h2></section>',
]


@pytest.mark.parametrize("chrome", CHROME)
def test_planted_chrome(chrome):
    page = f'<html><head><title> A\nTitle </title></head><body>{chrome}<div class="page"><p>outside</p><article class="post tag-ads category-menu"><h1>Head</h1><p><b>one</b> two{chrome}<p>three</article></div>{chrome}</body></html>'
    title, text = article(page)
    assert title == "A Title" and "PLANTED" not in text and "outside" not in text
    assert text.split() == ["#", "Head", "**one**", "two", "three"]


def test_roots():
    assert article("<body><p>x</p><main><p>long main text here</p><article>tease</article></main></body>")[1].split() == "long main text here tease".split()
    assert article("<body><p>x</p><main><p>by</p><article>the article itself</article></main></body>")[1] == "the article itself"
    assert article('<body><p>x</p><div role="main">m</div><p>y</p></body>')[1] == "m"
    assert article("<body><article></article><p>x</p><p>y</body>")[1] == "x\n\ny"
    assert article("<article>one</article><p>between<article>two</article>")[1].split() == ["one", "two"]
    assert article('<div class="layout-sidebar"><main>kept</main></div>')[1] == "kept"
    assert article("<b><article>one</b> two</article> three")[1].replace("*", "").split() == ["one", "two"]
    assert article('<article><pre>a <span class="comment"># kept</span></pre><div class="has-sidebar">b</div></article>')[1] == "```\na # kept\n```\n\nb"


def test_titles_and_none():
    assert article('<meta property="og:title" content="Og"><title>T</title><h1>H</h1>')[0] == "Og"
    assert article("<article><h1>H <b>x</b></h1>t</article>")[0] == "H x"
    assert article("<svg><title>icon</title></svg><p>t") == (None, "t")
    assert article('<title>T</title><nav>a</nav><div class="menu">b</div><script>var x = "<p>"</script><article> \n<img src="x"></article>') == ("T", None)
    assert article("") == (None, None)


def test_operator(spark):
    pages = [(1, '<article>a</article><div class="ad">b</div>'), (2, None), (3, "<nav>x</nav>"), (2**60 + 1, "<p>y"), (None, "<title>t</title><![bad>z")]
    got = articles(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, None, "a"), (2, None, None), (3, None, None), (2**60 + 1, None, "y"), (None, *article_or_none(pages[4][1]))]))


def article_or_none(page):
    try:
        return article(page)
    except Exception:
        return None, None
