import random
import re

import numpy as np
import pytest

from limnos.llm import html_extract as he
from limnos.llm.gbt import BoostedTrees


@pytest.fixture(scope="module")
def model():
    return he.fitted()


def test_held_out_pages(model):
    """Pages of another seed, never fitted on: nodes are labelled right, and most pages are right to the last node."""
    maker, right, nodes, wrong = he._Maker(random.Random(4321)), 0, 0, 0
    for _ in range(150):
        html = maker.page()
        page = he.Page(html)
        truth = [True] + [v == "1" for v in re.findall(r'\by="([01])"', html)]
        keep = page.decode(model.decision(page.features()))
        bad = sum(a != b for a, b in zip(truth, keep))
        right, nodes, wrong = right + (not bad), nodes + len(truth), wrong + bad
    assert wrong < 0.01 * nodes and right > 0.88 * 150


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(1)
    for _ in range(50):
        page = he.Page("")
        n = 9
        page.tag, page.parent = ["div"] * n, [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        odds = rng.normal(size=n) * 2
        keep = page.decode(odds)
        assert all(keep[page.parent[k]] or not keep[k] for k in range(1, n))
        value = lambda y: sum((-np.logaddexp(0, -o) if v else -np.logaddexp(0, o)) for v, o in list(zip(y, odds))[1:])
        best = max(value([True] + [bool(m >> (k - 1) & 1) for k in range(1, n)]) for m in range(1 << (n - 1)) if all(k == 0 or page.parent[k] == 0 or (m >> (page.parent[k] - 1) & 1) or not (m >> (k - 1) & 1) for k in range(1, n)))
        assert np.isclose(value(keep), best)


def article(body):
    return f'<html><head><title>t</title><style>p{{x}}</style></head><body><nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav><!-- no --><div class="ad">Buy this now.</div><article><h1>A  title</h1>{body}</article><div class="comments"><p>First reader says hello.</p></div><footer>&copy; site &middot; More.</footer></body></html>'


def test_whole_pages(spark):
    long = "<p>" + "One long line of text, with words. " * 3000 + "</p>"
    pages = [
        (1, "u", article("<p>Fish &amp; chips&nbsp;cost &#8364;5, it is said.<p>Second\n\n paragraph <b>bold</b>ly stated.</p>")),
        (2, None, None),
        (3, "u", ""),
        (4, "u", article(long)),
        (1, "u", article("<p>Cut off in the middle, it ends here with <b>a few words and &am")[: -len("</article>")]),
        (None, "v", "<p>Only a paragraph without a page, of some length, it seems.<script>var a='</p>'</script>"),
    ]
    got = he.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    by = {(r.page_id, i): r.text for i, r in enumerate(got)}
    texts = [r.text for r in got]
    assert texts[0] == "A title Fish & chips cost €5, it is said. Second paragraph boldly stated."
    assert texts[1] == texts[2] == ""
    assert texts[3] == "A title " + ("One long line of text, with words. " * 3000).strip()
    assert "Home" not in texts[4] and "few words" in texts[4]
    assert "var" not in texts[5]
    assert all(r.n_chars == len(r.text) for r in got) and len(by) == 6
    assert he.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_boosted_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    m = BoostedTrees(trees=80, depth=4).fit(x[:2000], y[:2000])
    assert (((m.decision(x[2000:]) > 0) == y[2000:]).mean()) > 0.9


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<svg class="i" />', "First part, as it begins. Second part, as it goes on."),
        ('<math display="block"/>', "First part, as it begins. Second part, as it goes on."),
        ("<video src=a controls>", "First part, as it begins. Second part, as it goes on."),
        ("<object data=a><canvas id=c><audio src=b>", "First part, as it begins. Second part, as it goes on."),
        ("<svg><g><path d='M0 0'><circle r=1>", "First part, as it begins. Second part, as it goes on."),
        ("<svg><title/><style/><path d=''/></svg>", "First part, as it begins. Second part, as it goes on."),
        ("Where <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=tex>x{=}1</annotation></semantics></math> holds.", "First part, as it begins. Where x=1 holds. Second part, as it goes on."),
        ("<svg><desc>no</desc><text>Deep</text><text>water</text></svg>", "First part, as it begins. Deep water Second part, as it goes on."),
    ],
)
def test_embedded_elements_lose_no_text(model, inner, want):
    html = article(f"<p>First part, as it begins. {inner}<p>Second part, as it goes on.</p>")
    html = html.replace("</footer>", "<svg><path/></svg><video></video><object></object><canvas></canvas><audio></audio><math></math></footer>")
    assert he.main_texts([html], model)[0] == "A title " + want
