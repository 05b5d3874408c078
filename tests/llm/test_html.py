"""HTML extraction: made pages with a known article, the test pages against their article element."""

import html
import re

import pytest

from evalframe.llm import html_bp
from evalframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def oracle(source):
    """Article element of a test page, cut out by patterns."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", source or "", re.S)
    inner = re.sub(r"<!--.*?-->", "", m.group(1) if m else "", flags=re.S)
    inner = re.sub(r"</?(?:p|h\d|br|div|ul|li)\b[^>]*>", " ", inner)
    inner = re.sub(r"<[^<]*\Z", "", re.sub(r"<[^>]*>", "", inner))
    return " ".join(html.unescape(inner).split())


@pytest.fixture(scope="module")
def model(spark):
    return html_bp.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op3_html_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == oracle(pages[r["page_id"]]["html"]), r["page_id"]
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site</a><p>Slogan of the site</p></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div>
<main><article><h1>A &amp; B</h1><p>First   para&shy;graph with <b>bold</b>er<i>text</i>.<p>Second<br>line &#8364; &lt;tag&gt; 1 < 2
<div class="ad"><p>Buy now</p></div><form><input><button>Send</button><label>Name</label></form>
<ul><li>Point one<li>Point two</ul><script>var x = "<p>no</p>";</script><table><tr><td>c1<td>c2</table></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice article, thank you for it!</p></div></section></main>
<aside><p>Related stories</p></aside><footer>&copy; Site</footer></body></html>"""


def test_parts_of_a_page(model):
    assert html_bp.main_text(PAGE, model) == "A & B First para\xadgraph with bolderText. Second line € <tag> 1 < 2 Point one Point two c1 c2".replace("bolderText", "boldertext")


def test_article_without_semantic_tags(model):
    body = "".join(f"<p>This is paragraph number {i} of the story and it has a good many words in it.</p>" for i in range(6))
    page = f'<html><body><div class="nav"><a>x</a><a>y</a></div><div class="article-body">{body}</div><div class="footer">end</div></body></html>'
    text = html_bp.main_text(page, model)
    assert text.startswith("This is paragraph number 0") and text.endswith("words in it.") and "end" not in text.split()


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "&", "<!--", "plain words", "</p></div>", "<article>" * 3000 + "deep", "<script>x", "<a href='", "\x00<b>\x00"])
def test_broken_pages(model, page):
    assert isinstance(html_bp.main_text(page, model), str)


def test_messages_give_exact_marginals(model):
    """Sum-product against the sum over all labellings."""
    import itertools
    import math

    tree = html_bp.nodes(html_bp.parse("<body><div><p>some words here and there<b>x</b></p></div><nav><a>l</a></nav></body>"))
    own = [model.own_of(n) for n, _ in tree]
    total, content = 0.0, [0.0] * len(tree)
    for ys in itertools.product(html_bp.LABELS, repeat=len(tree)):
        w = model.prior[ys[0]] + sum(own[i][y] for i, y in enumerate(ys)) + sum(model.edge[ys[p]][ys[i]] for i, (_, p) in enumerate(tree) if i)
        total += math.exp(w)
        for i, y in enumerate(ys):
            content[i] += (y == html_bp.CONTENT) * math.exp(w)
    for got, want in zip(model.marginals(tree), content):
        assert abs(got - want / total) < 1e-9


def test_tables(spark):
    ddl = "page_id bigint, html string, text string, n_chars int"
    assert html_bp.extract(spark.createDataFrame([], ddl)).count() == 0
    rows = html_bp.extract(spark.createDataFrame([(1, PAGE, "x", 1), (1, PAGE, None, 2), (None, None, "y", 3)], ddl)).collect()
    assert sorted(r["n_chars"] for r in rows)[0] == 0 and rows[0]["text"] == rows[1]["text"]


def test_formulas_fallbacks_and_figures_of_an_article(model):
    page = (
        "<html><body><nav><a href=/>Home</a><svg><text>Logo</text></svg></nav><article><p>The energy of a body at rest is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> as shown "
        "in many books.</p><object data=a.pdf><p>The report can be read as a file by everyone.</p></object>"
        "<svg><style>.a{}</style><path d='M0'/><text>Mass of the body over time</text></svg><p>More text follows here.</p></article></body></html>"
    )
    got = html_bp.main_text(page, model)
    for part in ("is E=m as shown", "The report can be read as a file", "Mass of the body over time", "More text follows here."):
        assert part in got
    assert "Logo" not in got and ".a" not in got
