"""Main text of pages: regions by a plain version of the same rules, pages without names, hostile markup."""

import math
import random
import time

import numpy as np
import pytest

from brindle.llm import html_extract as H
from brindle.sources.tables import table

LONG = [f"Paragraph {i} of a page says at some length what it has to say, and {i} more words follow it here." for i in range(8)]


def ancestors(nodes, i):
    out = []
    while i >= 0:
        out.append(i)
        i = nodes[i].up
    return out


def slow_content(lines, nodes, weight):
    """Ratios, their Gaussian mean within each part and the threshold, by double loops."""
    on = [i for i, w in enumerate(weight) if w]
    ratio = {i: weight[i] * max(0, len(lines[i].text) - 2 * lines[i].linked) / max(1, lines[i].tags) for i in on}
    texts = sorted(ratio[i] for i in on if len(lines[i].text) - lines[i].linked >= 40)
    most = (texts[(len(texts) - 1) // 2] + texts[len(texts) // 2]) / 2 if texts else math.inf
    ratio = {i: min(r, most) for i, r in ratio.items()}
    smooth = []
    for a, i in enumerate(on):
        near = [(b, j) for b, j in enumerate(on) if abs(a - b) <= 3 and nodes[lines[i].node].doubtful == nodes[lines[j].node].doubtful]
        k = [math.exp(-0.5 * (a - b) ** 2) for b, _ in near]
        smooth.append(sum(w * ratio[j] for w, (_, j) in zip(k, near)) / sum(k))
    limit = 0.5 * sum(smooth) / max(1, len(smooth))
    top = max(ratio.values(), default=0)
    return {i for i, s in zip(on, smooth) if s > 0 and s >= limit - 1e-9 and ratio[i] >= 0.1 * top}


def slow_regions(lines, nodes, weight, content):
    """Which lines belong, by looking at all pairs of a line and a content line."""
    if not content:
        return {i for i, x in enumerate(lines) if weight[i] and nodes[x.node].named >= 0 and nodes[x.node].doubtful <= nodes[x.node].named}
    box = lambda i: next(a for a in ancestors(nodes, lines[i].node) if a == 0 or nodes[a].tag in H.BOXES and nodes[a].blocks)
    mass = lambda a: sum(len(lines[c].text) for c in content if a in ancestors(nodes, lines[c].node))
    meant = set()
    for kinds in ({"article"}, None):
        named = {i for i, n in enumerate(nodes) if n.named == i and mass(i) and (kinds is None or n.tag in kinds)}
        held = {c for c in content if named & set(ancestors(nodes, lines[c].node))}
        if held and 2 * sum(len(lines[c].text) for c in held) >= mass(0):
            meant = named
            break
    out = set(content)
    part = [nodes[x.node].doubtful for x in lines]
    on = [i for i, w in enumerate(weight) if w]
    for i in on:
        beside = any(box(c) == box(i) for c in content)
        inside = bool(meant & set(ancestors(nodes, lines[i].node)))
        own = part[i] < 0 or any(part[i] in ancestors(nodes, lines[c].node) for c in content)
        before, after = [c for c in content if c < i], [c for c in content if c > i]
        between = before and after and sum(max(before) < j < min(after) for j in on) <= H.GAP and part[i] == part[max(before)] == part[min(after)]
        parent = lambda c: next((a for a in ancestors(nodes, nodes[box(c)].up) if a == 0 or nodes[a].tag in H.BOXES and nodes[a].blocks), -1)
        row = [c for c in content if parent(c) == parent(i)]
        amid = bool(row) and min(row) < i < max(row) and 2 * lines[i].linked <= len(lines[i].text)
        if own and (beside or inside or amid) or between:
            out.add(i)
    return out


def both(html):
    page = H.PageLines()
    lines = page.read(html)
    weight = H.weights(lines, page.nodes)
    content = slow_content(lines, page.nodes, weight)
    want = "\n\n".join(lines[i].text for i in sorted(slow_regions(lines, page.nodes, weight, content)))
    return H.main_text(html), want


def test_tables_pages(spark, sf):
    for r in table(spark, sf, "pages").collect():
        got, want = both(r.html)
        assert got == want


def random_page(rng):
    def block(depth):
        kind = rng.choice(["p", "p", "p", "div", "div", "ul", "h2", "article", "table"] if depth < 3 else ["p", "h2"])
        name = rng.choice(["", "", "", ' class="notice"', ' class="x1"', ' id="comments"', ' class="related-work"', ' class="toc box"'])
        text = " ".join(rng.choice(["word", "of", "a", "sentence", "here"]) for _ in range(rng.choice([1, 3, 8, 40])))
        if kind in ("p", "h2"):
            return f"<{kind}{name}>{f'<a href=x>{text}</a>' if rng.random() < 0.2 else text}</{kind}>"
        inner = "".join(block(depth + 1) for _ in range(rng.randrange(1, 5)))
        if kind == "ul":
            return f"<ul{name}>{''.join(f'<li>{text} {i}' for i in range(3))}</ul>"
        return f"<table><tr><td>{text}</td><td>{inner}</td></tr></table>" if kind == "table" else f"<{kind}{name}>{inner}</{kind}>"

    return "<body>" + "".join(block(0) for _ in range(rng.randrange(1, 6)))


def test_random_pages():
    rng = random.Random(3)
    for _ in range(300):
        got, want = both(random_page(rng))
        assert got == want


def bare(article):
    chrome = "<div><div><a href=a>Home</a></div><div><a href=b>News</a></div><div><a href=c>About us</a></div></div>"
    return f"<body><div>{chrome}<div>{article}</div><div><div>Terms</div><div>&copy; 2020 Example</div></div></div>"


def test_the_ratio_decides_without_names(monkeypatch):
    article = f"<h1>A title</h1>{''.join(f'<p>{x}</p>' for x in LONG[:4])}<p>Short.</p><ul><li>One<li>Two</ul>{''.join(f'<p>{x}</p>' for x in LONG[4:])}<p>End.</p>"
    want = ["A title", *LONG[:4], "Short.", "One", "Two", *LONG[4:], "End."]
    assert H.main_text(bare(article)).split("\n\n") == want
    monkeypatch.setattr(H, "content_lines", lambda lines, *_: np.ones(len(lines), bool))
    assert H.main_text(bare(article)).split("\n\n") != want


def test_uneven_paragraphs_stay():
    """One paragraph of many times the others' length doesn't cost them, in boxes or in sections, named or not."""
    short = [f"Paragraph {i} has a hundred characters or so, which is the ordinary length of one on this page, and ends here." for i in range(24)]
    for times in (1, 5, 20, 40, 100, 400):
        for place in (0, 11, 23):
            texts = short[:place] + [" ".join(["A very long paragraph goes on and on."] * 3 * times)] + short[place:]
            assert H.main_text(bare("".join(f"<div>{x}</div>" for x in texts))).split("\n\n") == texts
            assert H.main_text(bare("".join(f"<div><p>{x}</p></div>" for x in texts))).split("\n\n") == texts
        sections = [("A", " ".join([short[0]] * times)), ("B", short[1]), ("C", short[2]), ("D", short[3])]
        html = "".join(f"<section><h2>Section {h}</h2><p>{x}</p></section>" for h, x in sections)
        want = [y for h, x in sections for y in (f"Section {h}", x)]
        assert H.main_text(bare(html)).split("\n\n") == want
        assert H.main_text(f"<body>{html}").split("\n\n") == want


def test_random_lengths_stay():
    rng = random.Random(8)
    lost = total = 0
    for _ in range(200):
        texts = [" ".join(rng.choice(["some", "words", "of", "various", "lengths"]) for _ in range(max(6, int(rng.lognormvariate(3.3, 1.1))))) + f" {i}." for i in range(rng.randrange(5, 40))]
        kept = H.main_text(bare("".join(f"<div>{x}</div>" for x in texts))).split("\n\n")
        assert set(kept) <= set(texts), set(kept) - set(texts)
        lost += len(texts) - len(kept)
        total += len(texts)
    assert lost <= 0.005 * total, (lost, total)


def test_comment_containers_go_and_link_lists_stay():
    body = "".join(f"<p>{x}</p>" for x in LONG)
    for name in ("disqus_thread", "comment-thread", "comments_list"):
        assert H.main_text(f"<article>{body}</article><div id='{name}'><p>{LONG[0]} I agree.</p></div>").split("\n\n") == LONG, name
    links = "".join(f"<li><a href=x{i}>Entry {i} of the list</a></li>" for i in range(4))
    assert H.main_text(f"<nav><a href=a>Home</a></nav><main><ul>{links}</ul></main>").split("\n\n") == [f"Entry {i} of the list" for i in range(4)]


def test_whole_names_count():
    body = "".join(f"<p>{x}</p>" for x in LONG)
    for name in ("related-work", "comment-free", "ad-hoc", "navy", "loading"):
        assert H.main_text(f"<article>{body}<div class='{name}'><p>It is kept.</p></div></article>").endswith("It is kept."), name
    for name in ("ad", "post-comments", "comment-list", "cookie-notice", "site-footer", "sidebarBox", "newsletter_signup"):
        assert "gone" not in H.main_text(f"<article>{body}<div class='{name}'><p>It is gone, and {LONG[0]}</p></div></article>"), name


def test_doubtful_names_weigh_by_ratio():
    body = "".join(f"<p>{x}</p>" for x in LONG)
    for name in ("notice", "share", "toc", "menu", "reply-box"):
        assert "Click" not in H.main_text(f"<article>{body}<div class='{name}'><p>Click here</p></div></article>")
        told = " ".join(LONG * 3)
        assert H.main_text(f"<article>{body}<div class='{name}'><p>{told}</p></div></article>").endswith(told)


def test_named_pages_of_many_forms():
    body = "".join(f"<p>{x}</p>" for x in LONG)
    for page in (
        f"<div class='site-header'>Name</div><div id=content>{body}</div><div id=sidebar><p>{LONG[0] * 3}</p></div>",
        f"<nav>x</nav><main>{body}<section id=comments><article class=comment><p>{LONG[1] * 2}</p></article></section></main>",
        f"<main><div role=search>Find</div><article>{body}</article><div class=promo>{LONG[2]}</div></main>",
        f"<body class='has-sidebar menu'><div class='post-content'>{body}<form><input><label>Mail</label></form></div><footer>{LONG[3]}</footer>",
        f"<table><tr><td><a href=a>A</a><p><a href=b>B</a></p></td><td>{body}</td></tr></table>",
    ):
        assert H.main_text(page).split("\n\n") == LONG


def test_markup_that_breaks_parsers():
    assert H.main_text("<p>a</p><![foo[x]]><p>b</p>") == "a\n\nb"
    assert H.main_text("<p>a</p><![ x") == H.main_text("<p>a</p><!-- never closed <p>b</p>") == "a"
    assert H.main_text("<p>a<![CDATA[ x > y ]]> b<?php echo '>' ?></p>") == "a b' ?>"
    assert H.main_text("<p>a &lt; b &#233; &amp;amp; <3 c</p>") == "a < b é &amp; <3 c"


@pytest.mark.parametrize(
    "html",
    [
        "<b>" * 150_000 + "</i>" * 150_000, "<div>x" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<!-- " * 200_000, "<a " * 300_000,
        "<?" * 300_000, "<![CDATA[" * 100_000 + "x>", "</b " * 200_000, "<ul><li>a" * 60_000, "<script>" + "</b>" * 200_000,
    ],
)
def test_a_megabyte_takes_seconds(html):
    began = time.process_time()
    H.main_text(html)
    assert time.process_time() - began < 6


def test_ties_and_clashes(spark):
    same = "<body>" + "<div><p>just the same</p></div>" * 3
    assert H.main_text(same) == "just the same\n\njust the same\n\njust the same"
    pages = spark.createDataFrame([(1, same, 7, "y"), (1, same, 7, "y"), (2, None, None, None)], "page_id long, html string, n_chars int, text string")
    got = H.extract(pages).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [43, 43, 0] and got[0] == got[1]
