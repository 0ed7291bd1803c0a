import itertools
import random

import numpy as np
import pytest

from bandweave.llm import html_text as H


def text(page):
    return H.main_text(page, H.PRIOR, 1.0)


ARTICLE = "<h1>A title of some words</h1><p>The first paragraph is long enough to count as text, it says.<p>A second one with <a href=x>a link</a> inside, and &amp;amp; or caf&eacute;, goes on&nbsp;here.</p>"
PLAIN = "A title of some words The first paragraph is long enough to count as text, it says. A second one with a link inside, and &amp; or café, goes on here."
PAGES = {
    "semantic": f"<html><head><title>t</title><script>var t='</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{ARTICLE}</article><footer>&copy; 2020 x</footer></body>",
    "classes": f'<body><div class="top-menu"><a href=/>Home</a> <a href=/b>News</a></div><div id="cookie-notice">We use cookies for this and that, accept them.</div><div class="post-content">{ARTICLE}</div><div class=sidebar><p>Related stories for you to read today, with a long line of text.</p></div>',
    "comments": f"<main>{ARTICLE}<section class='comments'><p>Great article, thank you very much for writing all of this down!</p></section></main>",
    "advert": f"<article>{ARTICLE}<div class='ad'>Buy one now and get another one for half of the price, today only.</div></article>",
    "form": f"<article>{ARTICLE}</article><form><p>Subscribe to our letter and get the latest news every week.</p><input name=q><select><option>a</select></form>",
    "header": f"<header><p>The Site of Sites, a daily for all who read and read again.</p></header><article><header>{ARTICLE[:ARTICLE.index('<p>')]}</header>{ARTICLE[ARTICLE.index('<p>'):]}</article>",
    "hidden": f"<article>{ARTICLE}<p style='display: none'>A trap for robots that is long enough to be taken for text.</p></article>",
    "cut off": f"<body><article>{ARTICLE}</article><script>if (a < b) {{ document.write('<p>x</p>')",
    "comment": f"<article><!-- <p>not this one, though it is quite long.</p> -->{ARTICLE}</article><!-- open",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert text(PAGES[name]) == PLAIN


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p></p>", ""), ("<<<>>", ""), ("<article><p>a<b>b</b>c <i>d</i><br>e</p></article>", "abc d e")])
def test_odd_pages(page, want):
    assert text(page) == want if want or page != "<<<>>" else isinstance(text(page), str)


def cost(label, gain, joined):
    return sum(-g for g, x in zip(gain, label, strict=True) if x) + sum(c for a, b, c in joined if label[a] != label[b])


def test_cut_is_a_minimum():
    rng = random.Random(3)
    for _ in range(120):
        n = rng.randrange(1, 10)
        gain = np.array([rng.uniform(-2, 2) for _ in range(n)])
        joined = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        least = min(cost(x, gain, joined) for x in itertools.product([False, True], repeat=n))
        assert cost(H.cut(gain, joined), gain, joined) == pytest.approx(least)
        flow = H.max_flow([max(0, g) for g in gain], [max(0, -g) for g in gain], joined)
        assert cost(flow, gain, joined) == pytest.approx(least)


def test_smoothness_turns_a_doubtful_block():
    gain = np.array([3.0, -0.4, 3.0])
    assert list(H.cut(gain, [])) == [True, False, True]
    assert list(H.cut(gain, [(0, 1, 0.3), (1, 2, 0.3)])) == [True, True, True]


def test_training_learns_from_text_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(H.PRIOR)))
    x[:, 0] = 1
    content = x[:, 3] + 0.1 * rng.normal(size=400) > 0
    w = H.trained(x, content)
    assert w[3] > H.PRIOR[3] and np.array_equal(H.trained(x[:0], content[:0]), H.PRIOR)


def test_table(spark):
    rows = [(i, f"u{i}", page, 7) for i, page in enumerate([*PAGES.values(), None, "", PAGES["form"]])]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text long")
    got = H.extract(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.text == (PLAIN if rows[r.page_id][2] else "") and r.n_chars == len(r.text) and r.url == f"u{r.page_id}"
    assert H.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<div>", "<p>word word word, and so on to a.<li>b", "<", "<a ", '<p class="x', "<!--", "<ul><li>a"])
def test_deep_and_broken_pages(part):
    assert isinstance(text(part * 20_000), str)


def test_distance():
    found, parent = H.blocks("<div><p>a<p>b<ul><li>c<li>d</ul></div><section>e")
    assert [b.text for b in found] == ["a", "b", "c", "d", "e"]
    at = [b.at for b in found]
    assert [H.distance(x, y, parent) for x, y in zip(at, at[1:])] == [2, 3, 2, 4] and H.distance(at[0], at[0], parent) == 0


def test_long_page():
    page = "<article>" + "<p>Some words that make a paragraph of the text.</p>" * 20_000 + "</article><nav><a>x</a></nav>"
    assert text(page).count("Some words") == 20_000 and not text(page).endswith("x")


@pytest.mark.parametrize("inside", ["<math><mi>x</mi></math>", "<svg><text>x</text></svg>", "<noscript>x</noscript>", "<object>x</object>"])
def test_only_what_is_no_text_is_dropped(inside):
    page = f"<article><p>Let {inside} be a value that is long enough to count as text.</p><script>var y</script></article>"
    assert text(page) == "Let x be a value that is long enough to count as text."


@pytest.mark.parametrize("tag", ["div", "x-y"])
def test_end_tags_that_close_nothing_take_linear_time(tag):
    import time

    began = time.perf_counter()
    text(f"<{tag}>" * 40_000 + "<p>a" + "</foo>" * 40_000 + "<li>b<tr>c" * 20_000)
    assert time.perf_counter() - began < 20  # a minute and more if each looked through all open elements


def unmarked(page):
    """The page without what its elements say they are."""
    page = H.re.sub(r"<(/?)(article|main|nav|footer|aside|header|section)\b", r"<\1div", page)
    return H.re.sub(r"""\s(?:class|id|role|style)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_pages_without_marks():
    """Blocks of pages whose elements say nothing, against what the same pages say with their elements."""
    right = total = 0
    for name in ("semantic", "classes", "cut off", "header"):
        known, _ = H.blocks(PAGES[name])
        found, parent = H.blocks(unmarked(PAGES[name]))
        assert [b.text for b in found] == [b.text for b in known] and not any(b.mark for b in found)
        label = H.cut(H.features(found) @ H.PRIOR, H.edges(found, parent, 1.0))
        right += sum(bool(x) == (b.mark > 0) for x, b in zip(label, known, strict=True))
        total += len(known)
    assert right / total >= 0.75
