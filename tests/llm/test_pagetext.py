import itertools
import math
import random

import pytest

from tessera.llm.pagetext import EDGES, N_FEATURES, _edge, default_weights, extract, extract_pages, featurise, labelled_pages, labels, messages, parse


def test_marginals_are_those_of_all_labellings():
    rng = random.Random(2)
    weights = [rng.uniform(-1, 1) for _ in range(N_FEATURES)], [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(EDGES)]
    nodes = parse("<nav><ul><li>a</ul></nav><div class=post><h1>t</h1><p>x <a>y</a></div>z")
    f = featurise(nodes)
    total, one = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(weights[0][k] for v, fs in zip(y, f) if v for k in fs)
        s += sum(weights[1][_edge(n.tag)][2 * y[n.parent] + y[i]] for i, n in enumerate(nodes) if i)
        total += math.exp(s)
        for i, v in enumerate(y):
            one[i] += v * math.exp(s)
    got, joint = messages(nodes, f, weights)
    assert got == pytest.approx([x / total for x in one])
    assert all(sum(j) == pytest.approx(1) for j in joint[1:])


def test_accuracy_on_pages_not_trained_on():
    weights, right, all_ = default_weights(), 0, 0
    for p in labelled_pages(200, seed=77):
        nodes = parse(p)
        one, _ = messages(nodes, featurise(nodes), weights)
        for n, y, q in zip(nodes, labels(nodes), one):
            if n.tag == "#text":
                right += (q >= 0.5) == bool(y)
                all_ += 1
    assert right / all_ > 0.98


def blocks(page):
    return [n.text for n in parse(page) if n.tag == "#text"]


@pytest.mark.parametrize("page,want", [
    ("a <b>b</b>c&amp;d&nbsp; e", ["a bc&d e"]),
    ("<p>one<p>two<br>three</p>four", ["one", "two three", "four"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<script>x='<p>'</script>t<style>p{}</style><!-- <p>n --> u", ["t u"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<div a='>' b=\">\">x</div><a href=\"q", ["x"]),
    ("<head><title>t</title></head><body>y</body>", ["y"]),
    ("</p></div>z<", ["z<"]),
    ("", []),
    ("<" * 3000, ["<" * 3000]),
    ("<div>" * 20000 + "deep", ["deep"]),
    ("<script>never closed", []),
])
def test_parse(page, want):
    assert blocks(page) == want


ARTICLE = "<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div class=sidebar><p>Read also this and that.</p></div><article><h1>Title here</h1><p>First &eacute; paragraph\n of the  text, with words.</p><ul><li>Point one of the list.</li></ul><div class=ad>Buy now, cheap.</div></article><div id=comments><p>I do not agree with you at all.</p></div><footer>&copy; 2020</footer>"


def test_table(spark):
    want = "Title here\nFirst é paragraph of the text, with words.\nPoint one of the list."
    assert extract(ARTICLE, default_weights()) == want
    df = spark.createDataFrame([(1, "u", ARTICLE, "t"), (2, None, None, "t"), (3, "v", "", "t"), (None, "w", ARTICLE, "t"), (1, "u", ARTICLE, "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (None, "w", want, len(want)), (2, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract_pages(df.limit(0)).collect() == []
