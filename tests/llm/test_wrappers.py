"""Page trees, alignment and the choice of the main part on pages that are deep, long, hidden or misleading."""

from __future__ import annotations

import random
import time

import pytest
from wardlens.llm import wrappers


def alone(html):
    """The text that a page's own wrapper binds."""
    nodes = wrappers.tree(html)
    return "\n".join(wrappers.blocks(nodes, wrappers.main_paths(wrappers.skeleton(nodes), wrappers._prose(nodes, "", {}))))


def hosted(*pages):
    """The texts of the pages of one host."""
    trees = [wrappers.tree(p) for p in pages]
    prose, whole = {}, None
    for nodes in trees:
        wrappers._prose(nodes, "", prose)
        items = wrappers.skeleton(nodes)
        whole = items if whole is None else wrappers.align(whole, items)
    mains = wrappers.main_paths(whole, prose)
    return ["\n".join(wrappers.blocks(nodes, mains)) for nodes in trees]


STORY = "<p>A story of many words that goes on for a while.</p><p>And it has a second part, too.</p>"
STORY_TEXT = "A story of many words that goes on for a while.\nAnd it has a second part, too."


@pytest.mark.parametrize("page, text", [
    (f"<article>{STORY}<p>x <span class='advert'>buy</span>y</p></article>", STORY_TEXT + "\nx y"),
    (f"<article>{STORY}<p>x<span style='color:red; display: none'>secret</span> y</p></article>", STORY_TEXT + "\nx y"),
    (f"<article>{STORY}<p>x <a class='share-button' href=#>Share <b>now</b></a>y</p></article>", STORY_TEXT + "\nx y"),
    (f"<article>{STORY}<ins class='adsbygoogle ads'>ad <ins>inner</ins> more</ins><p>y</p></article>", STORY_TEXT + "\ny"),
    (f"<article>{STORY}<p>x <span hidden>no <span>nested</span> no</span>y</p></article>", STORY_TEXT + "\nx y"),
    (f"<article>{STORY}<p>x <span class=ad>never closed</p><p>y</p></article>", STORY_TEXT + "\nx\ny"),
    (f"<article>{STORY}<p>a <em class='strong'>kept</em> <img class=ad src=x> b<hr>c</p></article>", STORY_TEXT + "\na kept b\nc"),
    (f"<main>{STORY}<article>teaser</article></main>", STORY_TEXT + "\nteaser"),
    (f"<div class=content>{STORY}</div><article class='comment'>I say</article>", STORY_TEXT),
    (f"<article class='post'>{STORY}</article><article class='comment'><p>{'long words of a reader ' * 20}</p></article>", STORY_TEXT),
    ("", ""), ("<p>", ""), ("just text", ""), ("<body>one<br>two", "one two"),
])
def test_what_a_page_says(page, text):
    assert alone(page) == text or (text == "" and page == "just text")


def test_comment_articles_do_not_stand_for_the_story():
    pages = [f"<div class='content'><h1>T{k}</h1>{STORY}</div><div id=comments><article class='comment reply'><p>{'me too ' * k}</p></article></div>"
             for k in range(1, 9)]
    assert hosted(*pages) == [f"T{k}\n{STORY_TEXT}" for k in range(1, 9)]


@pytest.mark.parametrize("depth", [1_200, 50_000])
def test_deep_pages(depth):
    nested = "<div>" * depth + "deep words" + "</div>" * depth
    page = f"<article>{STORY}{nested}<p>end</p></article>"
    assert alone(page) == STORY_TEXT + "\ndeep words\nend"
    assert alone(f"<article>{STORY}" + "<div>" * depth + "deep") == STORY_TEXT + "\ndeep"
    hidden = f"<article>{STORY}" + "<div>" * depth + "<nav>menu</nav>text<div class=ad>x<p>y</div>z" + "</div>" * depth + "<p>end</p></article>"
    assert alone(hidden) == STORY_TEXT + "\ntext\nz\nend"
    assert len(wrappers.align(wrappers.skeleton(wrappers.tree(page)), wrappers.skeleton(wrappers.tree(hidden)))) == 1


def test_long_page():
    page = "<article>" + "<p>some words of a very long page</p>" * 150_000 + "</article>"
    assert alone(page).count("\n") == 149_999


def test_alignment_of_many_siblings():
    rng = random.Random(1)
    a, b = ([[rng.choice(["p", "h2", "ul", "pre", "div.x", f"div.y{rng.randrange(3000)}"]), False, False, []] for _ in range(10_000)]
            for _ in range(2))
    began = time.monotonic()
    merged = wrappers.align(a, b)
    assert time.monotonic() - began < 8 and {x[0] for x in a + b} <= labels(merged)


def labels(items):
    return {x[0] for x in items} | {y for x in items for y in labels(x[3])}


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        pairs = wrappers.common(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def covers(items, labels_):
    """Does an expression over flat labels match a list of labels? Brute force over its choices."""
    def rest(k, at):
        if k == len(items):
            return {at}
        label, optional, repeated, children = items[k]
        out, todo = set(), {at}
        if optional:
            out |= rest(k + 1, at)
        while todo:
            now = todo.pop()
            if label.startswith("("):
                after = {e for e in ends(children, now)}
            else:
                after = {now + 1} if now < len(labels_) and labels_[now] == label else set()
            for e in after:
                got = rest(k + 1, e)
                out |= got
                if repeated and e > now:
                    todo.add(e)
        return out

    def ends(inner, at):
        return covers_from(inner, at)

    def covers_from(inner, at):
        nonlocal items
        saved, items = items, inner
        got = rest(0, at)
        items = saved
        return got

    return len(labels_) in rest(0, 0)


def test_an_expression_matches_what_it_was_made_of():
    rng = random.Random(3)
    for _ in range(200):
        lists = [[rng.choice("abc") for _ in range(rng.randrange(1, 7))] for _ in range(2)]
        a, b = (wrappers.fold([[x, False, False, []] for x in own]) for own in lists)
        whole = wrappers.align(a, b)
        assert all(covers(whole, own) for own in lists), (lists, whole)


def test_extract_repeated_deep_and_odd_rows(spark):
    page = f"<article>{STORY}</article>"
    rows = [(1, "http://h/1", page), (1, "http://h/1", page), (2, "http://h/2", "<div>" * 3000 + "x"), (3, None, None), (None, "http://h/3", page)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    found = sorted(((r.page_id, r.text, r.n_chars) for r in wrappers.extract(frame).collect()), key=str)
    n = len(STORY_TEXT)
    assert found == sorted([(1, STORY_TEXT, n), (1, STORY_TEXT, n), (2, "x", 1), (3, "", 0), (None, STORY_TEXT, n)], key=str)
