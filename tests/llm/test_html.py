import math
import os
import random
import re
import subprocess
import sys
import time

import numpy as np
import pytest

from quire.llm import html as op


@pytest.fixture(scope="module")
def model():
    return op.Committee(op.weights())


def texts(page):
    return [b[0] for b in op.blocks_of(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n\t c<br>d</p><p>e") == ["a b c d", "e"]
    assert texts("<p><b>a<br><p>b</p>c") == ["a", "b", "c"]
    assert texts('<script>var t="</p><p>x";</script><style>p{}</style><!-- c <p> -->y') == ["y"]
    assert texts("&lt;b&gt; &amp;amp; &#233;&eacute;&nbsp;x") == ["<b> &amp; éé x"]
    assert texts('<p title="a>b">c</p>') == ["c"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("") == texts("<p") == texts("</p></div>") == [] and texts("<") == ["<"]
    assert texts("a < b and c > d") == ["a < b and c > d"]
    assert op.blocks_of('<div class="Main post" id=x><p>t')[0][1].elements() == ("div.main.post.x", "p")
    text, path, linked = op.blocks_of("<article><p><b>a<p>b</article><p>c")[-1]
    assert (text, path.elements(), linked) == ("c", ("p",), 0.0)
    assert op.blocks_of("<p>ab<a>cd</a>")[0][2] == 0.5
    assert len(texts("<div>" * 3000 + "deep")) == 1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    d = op.PATH_DIM + op.WORD_DIM + op.MEASURES
    m = op.Labeller(rng)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x = [rng.standard_normal((n, d)).astype(np.float32) for n in (4, 2)]
    y = [np.array([1, 0, 1, 1.0]), np.array([0, 1.0])]
    _, grad = m.step(x, y)
    for name in m.w:
        at = tuple(rng.integers(0, s) for s in m.w[name].shape)
        old = m.w[name][at]
        sides = []
        for e in (1e-3, -1e-3):
            m.w[name][at] = old + e
            sides.append(m.step(x, y)[0])
        m.w[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[name][at]) < 2e-4, name


def test_held_out_accuracy(model):
    draw, right, total = random.Random(777), 0, 0
    for _ in range(300):
        page, told = op.made_up_page(draw)
        blocks = op.blocks_of(page)
        p = model.probabilities(op.describe([blocks]))[0]
        right += sum((c >= 0.5) == (b[0] in told) for b, c in zip(blocks, p))
        total += len(blocks)
    assert right / total > 0.985


def test_training_again_gives_a_labeller_as_good(monkeypatch):
    monkeypatch.setattr(op, "TRAIN_PAGES", 400)
    found = op.trained(1)
    again, draw, right, total = op.Committee(found), random.Random(778), 0, 0
    assert all(v.shape == op.weights()[k].shape for k, v in found.items()) and len(op.weights()) == op.MEMBERS * len(found)
    for _ in range(100):
        page, told = op.made_up_page(draw)
        blocks = op.blocks_of(page)
        right += sum((c >= 0.5) == (b[0] in told) for b, c in zip(blocks, again.probabilities(op.describe([blocks]))[0]))
        total += len(blocks)
    assert right / total > 0.97


def test_batches_do_not_change_results(model):
    draw = random.Random(5)
    pages = [op.made_up_page(draw)[0] for _ in range(40)] + ["", "<p>x"]
    assert op.main_texts(pages, model) == [op.main_texts([p], model)[0] for p in pages]


def test_extract(spark, sf_dir):
    page = "<html><body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>Title &amp; so</h1><p>One two\n three four five six seven eight nine ten.</p><p>Another paragraph follows here with more words in it.</p></article><aside><p>Related</p></aside><footer>All rights reserved.</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 2), (None, "v", "", 3), (4, "w", "<article>" + "<p>word word word words.</p>" * 3000 + "</article>", 4)], "page_id long, url string, html string, text int")
    rows = {(r.page_id, r.url): r for r in op.extract(df).collect()}
    good = rows[1, "u"]
    assert good.text == "Title & so\nOne two three four five six seven eight nine ten.\nAnother paragraph follows here with more words in it." and good.n_chars == len(good.text)
    assert rows[2, None].text == rows[None, "v"].text == "" and rows[2, None].n_chars == 0
    assert len(rows[4, "w"].text.split("\n")) >= 2990
    assert op.extract(df).count() == 5 and op.extract(df.limit(0)).count() == 0


def test_articles_of_the_pages_table(spark, sf_dir):
    import html
    import re

    def article(page):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        return "\n".join(x for x in parts if x)

    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article(r.html) for r in df.collect()}
    rows = op.extract(df).collect()
    assert sum(r.text == want[r.page_id] for r in rows) >= 0.97 * len(rows)


def test_text_after_a_self_closed_raw_element_is_kept():
    page = '<p>one <svg class="i"/> two</p><p>three <math /></p><svg a="/>"><text>no</text></svg><p>four <svg><path d=""/></svg></p><script src="x"/>no</script><p>five</p>'
    assert [b[0] for b in op.blocks_of(page)] == ["one two", "three", "four", "five"]


def test_markup_that_is_broken():
    assert texts("<p>a</p><p title='x>b</p><p>c") == ["a", "b", "c"]  # a quote that never closes
    assert texts("<p>a<b title='x") == ["a"]
    assert texts("<title>t<p>a</p>") == ["t", "a"] and texts("a<script>b<p>c</p>") == ["a"]
    assert texts("a<!-- b <p>c") == ["a"] and texts("a<!doctype b") == ["a"]


@pytest.mark.parametrize("page", ["<a '" * 100_000, "<a '>" * 100_000, "<div>x" * 100_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<b><p>x" * 50_000, "<p>x</b>" * 100_000, "<svg>" * 100_000, "<!--" * 100_000, "<p>word</p>" * 100_000])
def test_odd_pages_take_time_in_proportion(page):
    began = time.time()
    blocks = op.blocks_of(page)
    op.describe([blocks])
    assert time.time() - began < 20


def test_a_page_of_very_many_blocks_does_not_pad_others(model):
    began = time.time()
    out = op.main_texts(["<article>" + "<p>word word word words.</p>" * 50_000 + "</article>"] + ["<p>a few words here.</p>"] * 12, model)
    assert len(out) == 13 and time.time() - began < 30


@pytest.mark.parametrize("n", [1, 5, 16, 40, 200])
def test_any_number_of_broken_quotes_reads_alike(n):
    assert texts("<b x='>w' " * (n - 1) + "<b x='>w" + '<p data-x="a>b">text</p>')[-1] == "text"


def test_tags_end_as_the_plain_statement_says():
    rng = random.Random(8)
    plain = re.compile(r"(?:[^'\">]|\"[^\"]*\"|'[^']*')*?>")
    for _ in range(3000):
        page = "".join(rng.choice("ab <'\">") for _ in range(rng.randint(1, 14)))
        doomed = set()
        for at in range(len(page)):
            m = plain.match(page, at)
            assert op._tag_end(page, at, doomed) == (m.end() if m else 0), (page, at)


@pytest.mark.parametrize("page", ["<b '>' " * 100_000 + "'", "<b '\">' " * 100_000 + "'", "<b \"'>" * 100_000])
def test_broken_quotes_take_time_in_proportion(page):
    began = time.time()
    op.blocks_of(page)
    assert time.time() - began < 20


def test_logits_equal_a_plain_lstm(model):
    """Each gate written out for one number at a time."""
    blocks = op.blocks_of(op.made_up_page(random.Random(3), False)[0])[:12]
    x = op.describe([blocks])[0].astype(float)
    sig = lambda v: 1 / (1 + math.exp(-v))
    for member in model.members:
        w = {k: v.astype(float) for k, v in member.w.items()}
        hidden = {}
        for way in "fb":
            h, c = [0.0] * op.HIDDEN, [0.0] * op.HIDDEN
            for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
                z = [w["b" + way][j] + float(x[t] @ w["x" + way][:, j]) + sum(h[k] * w["h" + way][k, j] for k in range(op.HIDDEN)) for j in range(4 * op.HIDDEN)]
                c = [sig(z[op.HIDDEN + k]) * c[k] + sig(z[k]) * math.tanh(z[3 * op.HIDDEN + k]) for k in range(op.HIDDEN)]
                h = [sig(z[2 * op.HIDDEN + k]) * math.tanh(c[k]) for k in range(op.HIDDEN)]
                hidden[way, t] = h
        want = [float(np.dot(hidden["f", t] + hidden["b", t], w["o"]) + x[t] @ w["s"] + w["c"][0]) for t in range(len(x))]
        assert np.allclose(member.logits([x.astype(np.float32)])[0], want, atol=1e-3)


@pytest.mark.parametrize("segment", [1, 7, 64, 10_000])
def test_long_pages_are_judged_as_short_ones(model, segment):
    rng = random.Random(5)
    for _ in range(4):
        blocks = op.blocks_of(op.made_up_page(rng, False)[0])
        assert np.allclose(model.long_page(blocks, segment), model.probabilities(op.describe([blocks]))[0], atol=1e-4)


def test_memory_of_a_very_long_page():
    """A page of 10 MB of short blocks, in a process of its own."""
    code = "import resource, sys; from quire.llm import html as op; m = op.Committee(op.weights()); t = op.main_texts(['<article>' + '<p>some more words.</p>' * 450_000 + '</article>'], m)[0]; print(len(t), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True).stdout.split())
    assert n > 0 and mb < 1000, mb


def test_kept_columns_with_the_results_names(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>Some words that make a text of their own.</p></article>", "old", 3)], "page_id long, url string, html string, text string, n_chars long")
    got = op.extract(rows, keep=("page_id", "text", "n_chars")).collect()
    assert got[0].asDict().keys() == {"page_id", "text", "n_chars"} and got[0].text != "old"
    assert op.extract(rows.limit(0)).count() == 0


def test_path_vectors_are_sums_over_the_path():
    path = op.blocks_of("<div id=a><main><section class='b c'><article><p>x")[0][1]
    v = np.zeros(op.PATH_DIM)
    for depth, element in enumerate(reversed(path.elements())):
        v += op._element_vector(element) * (1.0 if depth < 3 else 0.7)
    assert np.allclose(path.vector(), v, atol=1e-5)


def test_layouts_without_names(model):
    """Hand-written pages in styles that the grammar only resembles: cells without names, and a wiki."""
    cells = "<html><body><table><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Search</a></td></tr><tr><td><a href=1>Link one here</a><br><a href=2>Link two here</a><br><a href=3>Third link text</a></td><td><h2>A heading of text</h2><p>This is the main paragraph of the article with many words that tell a story.</p><p>Another paragraph goes on and on with more of the story until it ends.</p></td></tr><tr><td>Copyright 2020 A Person</td></tr></table></body></html>"
    wiki = "<html><body><div id=content class=mw-body><h1 id=firstHeading>Some topic</h1><div id=mw-content-text><p>Some topic is a thing about which much has been written in many books.</p><p>It was first found in the year 1900 by people who looked for it.</p></div></div><div id=mw-navigation><div id=p-namespaces><ul><li><a>Article</a></li><li><a>Talk</a></li></ul></div><div class=portal><h3>Tools</h3><ul><li><a>What links here</a></li></ul></div></div><div id=footer><ul><li>This page was last edited on 1 May 2020.</li></ul></div></body></html>"
    first, second = op.main_texts([cells, wiki], model)
    assert first.split("\n")[1:] == ["This is the main paragraph of the article with many words that tell a story.", "Another paragraph goes on and on with more of the story until it ends."]
    assert second.split("\n")[1:] == ["Some topic is a thing about which much has been written in many books.", "It was first found in the year 1900 by people who looked for it."]
