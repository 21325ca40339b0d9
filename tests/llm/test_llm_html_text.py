"""Main text of pages: the parser on broken markup, the labeller on layouts it has not seen."""

import random
import re

import numpy as np
import pytest

from seriesframe.llm import html_text as h


@pytest.fixture(scope="module")
def model():
    return h.trained_labeller()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Logo</a></header><nav><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies <button>OK</button></div><!-- <p>not seen</p> -->
<article><h1>A &amp; B</h1><p>First   <b>bold</b>\n text, with &lt;marks&gt; and a caf&eacute;.<p>Second<br>line of text, which is open.
<div class="ad">Buy now</div><p>Third paragraph of the story.</p>
<form><label>Name</label><input value="x"><textarea>type here</textarea></form>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Nice post, thanks a lot for it.</p></div></section></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside><footer>&copy; 2020 somebody</footer>"""


def test_blocks_of_broken_markup():
    got = [b.text for b in h.blocks_of(PAGE)]
    assert got == [
        "Logo", "Home", "News", "We use cookies", "OK", "A & B", "First bold text, with <marks> and a café.", "Second line of text, which is open.",
        "Buy now", "Third paragraph of the story.", "Name", "type here", "Comments", "Nice post, thanks a lot for it.", "Related", "Other story",
        "© 2020 somebody",
    ]
    for odd in (None, "", "   ", "<", "<p", "</p></div>", "<p>a</b></p>", "a < b & c &amp d", "<script>never closed", "<!-- open", "<p " + "x" * 100_000):
        h.blocks_of(odd)
    assert [b.text for b in h.blocks_of("plain text only")] == ["plain text only"]


def test_main_text(spark, model):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5), (4, "w", "<nav><a>x</a></nav>", 5), (1, "u", PAGE, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = h.main_texts(pages, model).collect()
    want = "A & B\nFirst bold text, with <marks> and a café.\nSecond line of text, which is open.\nThird paragraph of the story."
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [
        (1, "u", want, len(want)), (2, None, "", 0), (None, "v", "", 0), (4, "w", "", 0), (1, "u", want, len(want))
    ]
    assert h.main_texts(pages.limit(0), model).collect() == []


def test_held_out_made_up_pages(model):
    rng, vectors, n, right = random.Random(77), h.Vectors(), 0, 0
    for _ in range(150):
        parts = h.made_up_page(rng)
        marked = "".join(re.sub(r"(>|^)([^<]+)", lambda m, y=y: f"{m[1]}{h.MARK}{y}{m[2]}", text) for text, y in parts)
        blocks = h.blocks_of(f"<html><body>{marked}</body></html>")
        want = np.array([int(b.text[b.text.index(h.MARK) + 1]) for b in blocks])
        for b in blocks:
            b.texts = [re.sub(h.MARK + "[01]", "", "".join(b.texts))]
        right += ((model.label([vectors.page(blocks)])[0] >= 0.5) == want).sum()
        n += len(want)
    assert right / n > 0.98


def test_very_long_page(model):
    story = "".join(f"<p>Paragraph number {k} of a very long story.</p>" for k in range(5_000))
    blocks = h.blocks_of(f"<body><nav><a>x</a></nav><article>{story}</article></body>")
    chance = model.label([h.Vectors().page(blocks)])[0]
    assert len(blocks) == 5_001 and (chance[1:] >= 0.5).mean() > 0.99 and chance[0] < 0.5


def test_gradients():
    """Back-propagation against differences."""
    net, rng = h.Labeller(), np.random.default_rng(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    lengths = np.array([5, 3, 1])
    active, ahead, back = net.layout(lengths)
    assert sorted(ahead.tolist()) == sorted(back.tolist()) == list(range(9))
    x, pull = rng.normal(size=(9, h.INPUTS)), rng.normal(size=(9, h.HIDDEN))
    out, gates, cells = net.run(x, active, "f", keep=True)
    grads = {k: np.zeros_like(v) for k, v in net.w.items()}
    net.backward(x, active, "f", gates, cells, pull, grads)
    for name in ("xf", "hf", "cf"):
        for at in [tuple(rng.integers(0, s) for s in net.w[name].shape) for _ in range(6)]:
            old, sums = net.w[name][at], []
            for d in (1e-3, -1e-3):
                net.w[name][at] = old + d
                sums.append((net.run(x, active, "f").astype(np.float64) * pull).sum())
            net.w[name][at] = old
            assert abs((sums[0] - sums[1]) / 2e-3 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at]))


def test_ends_left_out():
    texts = lambda page: [b.text for b in h.blocks_of(page)]
    for start in ("<html><head><title>T</title><meta charset=x><body>", "<head><title>T</title>", "<head><script>x</script>\n<noscript><img src=x></noscript><body class=c>", "<head><noscript><link><body>"):
        assert texts(start + "<p>One<p>Two") == ["One", "Two"], start
    assert texts("<head><title>T</title>Bare text<p>Two") == ["Bare text", "Two"]
    assert texts("<head><noscript><div>not seen</div></noscript></head><body><p>One") == ["One"]
    for name in ("noscript", "svg", "template", "canvas"):
        assert texts(f"<body><article><p>One<{name}>not seen<p>Two</p><div>Three</div></article><p>Four") == ["One", "Two", "Three", "Four"], name
        assert texts(f"<body><p>One<{name}><p>not seen</p></{name}><p>Two") == ["One", "Two"], name
        assert texts(f"<div><{name}></div><p>One</p><{name}><p>not seen</p></{name}><p>Two") == ["One", "Two"], name
    assert texts("<article><p>Let <math><mi>x</mi><annotation>not seen</annotation></math> be <object>an object</object>.</p></article>") == ["Let x be an object."]
    assert [b.path for b in h.blocks_of("<table><thead><tr><th>A<tbody><tr><td>B")] == ["table/thead/tr/th", "table/tbody/tr/td"]
