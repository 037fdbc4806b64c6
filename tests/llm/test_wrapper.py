"""Wrapper induction: the alignment, and pages on which it alone decides."""

import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

from quarrymill.llm import wrapper


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def bare_page(rng, i, extra=""):
    """A page with no element names but p, div and h1, and no class, id or role."""
    body = "".join(f"<p>{words(rng, 20)}" for _ in range(2 + i % 4))
    head = f"Title {words(rng, 3)}"
    html = (
        f"<div><div>Home</div><div>About us</div><div>Offer {i % 7}</div></div><div><div><p>Advert: buy</p></div><div><h1>{head}</h1>{body}<p>Share this</p>"
        f"</div>{extra}</div><div><p>Imprint and terms</p></div>"
    )
    blocks = [head, *(b for b in body.split("<p>") if b)]
    return html, "\n".join(blocks)


def test_without_names_the_induced_template_decides(spark):
    rng = np.random.default_rng(3)
    pages = [bare_page(rng, i) for i in range(30)]
    rows = [(i, f"http://bare.org/{i}", h) for i, (h, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in rows_of(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got == {i: t for i, (_, t) in enumerate(pages)}
    # the rules about elements alone leave all in
    for h, t in pages:
        assert wrapper.main_text(wrapper.parse(h)) != t


def test_layouts_of_one_host_have_their_own_templates(spark):
    """Two layouts, and lists longer than the reference's, whose constant entries are template all the same."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(40):
        h, t = bare_page(rng, i)
        if i % 5 < 2:
            items = "".join(f"<p>{words(rng, 12)}</p><p>Read on</p>" for _ in range(3 + i % 9))
            h = f"<section><div><p>Other start</p></div><div><h1>News {i}x</h1>{items}</div><div><p>Other end</p></div></section>"
            t = "\n".join([f"News {i}x", *(x for x in items.replace("</p>", "").split("<p>") if x and x != "Read on")])
        rows.append((i, f"http://two.org/{i}", h))
        want[i] = t
    got = {r["page_id"]: r["text"] for r in rows_of(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got == want


def test_tree_matching_keeps_order():
    shapes = wrapper.Shapes()
    a, b = wrapper.parse("<ul><li>x<li>y<li>z</ul>", shapes), wrapper.parse("<ul><li>y<li>new<li>z</ul>", shapes)
    texts = [(x.own, y.own) for x, y in wrapper.match(a, b, shapes) if x.tag == "li"]
    assert ("y", "y") in texts and ("z", "z") in texts


def plain_weight(x, y):
    """Size of the largest matching, by trying all."""
    if x.sig != y.sig:
        return 0
    best = 0
    for n in range(1, min(len(x.children), len(y.children)) + 1):
        for p in itertools.combinations(x.children, n):
            for q in itertools.combinations(y.children, n):
                best = max(best, sum(plain_weight(a, b) for a, b in zip(p, q, strict=True)))
    return 1 + best


def random_tree(rng, depth=0):
    inner = "".join(random_tree(rng, depth + 1) for _ in range(rng.integers(0, 4 - depth))) if depth < 3 else ""
    tag = rng.choice(["div", "section"])
    return f"<{tag}>{inner}</{tag}>"


def test_matching_size_equals_trying_all():
    rng = np.random.default_rng(8)
    shapes = wrapper.Shapes()
    for _ in range(60):
        a, b = (wrapper.parse(f"<div>{random_tree(rng)}{random_tree(rng)}</div>", shapes) for _ in range(2))
        want = plain_weight(a.root, b.root)
        assert shapes.match(a.root.shape, b.root.shape) == want == len(wrapper.match(a, b, shapes))


def test_alignment_in_halves_is_as_good(monkeypatch):
    rng = np.random.default_rng(9)
    shapes = wrapper.Shapes()
    for _ in range(20):
        a, b = (wrapper.parse("".join(f"<{t}>{x}</{t}>" for t, x in zip(rng.choice(["p", "div"], 30), rng.integers(0, 6, 30), strict=True)), shapes) for _ in range(2))

        def worth():
            pairs = wrapper.match(a, b, shapes)  # noqa: B023
            return sum(2 + 3 * (x.own == y.own) for x, y in pairs[1:])

        whole = worth()
        monkeypatch.setattr(wrapper, "WHOLE_PAIRS", 20)
        assert worth() == whole
        monkeypatch.undo()


@pytest.mark.parametrize(
    "html",
    ["<a " * 350_000, '<a "' * 250_000, "<a '<b \">" * 100_000, "<div>" * 50_000 + "</x>" * 50_000, "<b>" * 50_000 + "<x>" * 50_000, "<" * 10**6],
)
def test_odd_pages_take_linear_time(html):
    began = time.time()
    wrapper.main_text(wrapper.parse(html))
    assert time.time() - began < 6


def test_long_and_deep_pages_are_aligned_whole():
    shapes = wrapper.Shapes()
    page = lambda n, salt: wrapper.parse("<ul>" + "".join(f"<li><b>Share</b>{salt}{i}<i>x</i></li>" for i in range(n)) + "</ul>", shapes)
    assert len(wrapper.match(page(400, "a"), page(2000, "b"), shapes)) == 2 + 3 * 400
    deep = [wrapper.parse("<div>" * 5000 + t, shapes) for t in "ab"]
    assert len(wrapper.match(*deep, shapes)) == 5001


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in rows_of(wrapper.extract(df))}


@pytest.mark.parametrize("pages", [1, 2, 4, 12])
def test_names_lose_no_main_text(spark, pages):
    """Modifiers of layouts are no boilerplate, and titles inside an article stay, with and without votes."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(pages):
        bodies = [(f"Title {words(rng, 4)}", [words(rng, 40) for _ in range(3)]) for _ in range(3)]
        paragraphs = ["".join(f"<p>{b}</p>" for b in body) for _, body in bodies]
        t = [h for h, _ in bodies]
        rows += [
            (3 * i, f"http://a.org/{i}", f'<body><div class="layout has-sidebar"><nav>Home</nav><article><h1>{t[0]}</h1>{paragraphs[0]}</article>'
             f'<div class="sidebar"><p>{words(rng, 9)}</p></div></div></body>'),
            (3 * i + 1, f"http://b.org/{i}", f'<body><div class="menu">Home</div><main class="single post-with-comments"><h1>{t[1]}</h1>{paragraphs[1]}'
             f'<div class="comments"><p>{words(rng, 9)}</p></div></main></body>'),
            (3 * i + 2, f"http://c.org/{i}", f'<body><header class="header">Site</header><article class="widget"><header class="entry-header"><h1>{t[2]}</h1></header>'
             f'{paragraphs[2]}<section class="related-posts"><h3>{words(rng, 5)}</h3></section></article></body>'),
        ]
        want |= {3 * i + k: "\n".join([h, *body]) for k, (h, body) in enumerate(bodies)}
    assert extracted(spark, rows) == want


def stripped(html):
    """The page without the names that the rules know: all structural elements are div, without attributes."""
    html = re.sub(r"(?i)<(/?)(?:article|nav|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", html)
    return re.sub(r'(?i)<div class="[^"]*">', "<div>", html)


def test_given_pages_without_names(spark, sf_dir):
    """With all names taken out of the given pages, the induced wrapper finds the same text; without it the rest of the page stays in."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    host = lambda url: url.split("/")[2]
    many = Counter(host(p.url) for p in pages)
    rows = [(p.page_id, p.url, p.html) for p in pages if many[host(p.url)] > 1]
    want = extracted(spark, rows)
    bare = [(i, url, stripped(html)) for i, url, html in rows]
    got = extracted(spark, bare)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert not any(wrapper.main_text(wrapper.parse(html)) == want[i] for i, _, html in bare)


@pytest.mark.parametrize("pages", [3, 20])
def test_misleading_names_do_not_outweigh_the_wrapper(spark, pages):
    """Teasers in article elements, and content in a div below one whose name is that of a sidebar."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for i in range(pages):
        body = [words(rng, 50) for _ in range(4)]
        teasers = "".join(f"<article><h3>{words(rng, 2)}</h3><span>{words(rng, 3)}</span></article>" for _ in range(3))
        content = f"<h1>T{i} {words(rng, 3)}</h1>" + "".join(f"<p>{b}</p>" for b in body)
        rows.append((i, f"http://odd.org/{i}", f'<body><div class="sidebar"><div><div>{teasers}</div><div>{content}</div></div></div></body>'))
        want[i] = content.replace("<h1>", "").replace("</h1><p>", "\n").replace("</p><p>", "\n").replace("</p>", "")
    assert extracted(spark, rows) == want


def test_copies_of_a_page_are_one_vote(spark):
    """Text of a page that most rows of a host repeat is no template."""
    rng = np.random.default_rng(7)
    html, texts = zip(*(bare_page(rng, i) for i in range(8)), strict=True)
    picked = [*range(8), *[3] * 90]
    rows = [(n, f"http://copies.org/{n}", html[i]) for n, i in enumerate(picked)]
    assert extracted(spark, rows) == {n: texts[i] for n, i in enumerate(picked)}


def test_names_are_whole():
    for names in ("sidebar", "site-footer", "box Related-Posts", "comment_list", "ad-3", "widget-area", "cookie-banner", "side-bar"):
        assert wrapper.named_boilerplate(names, True), names
    for names in ("has-sidebar", "post-with-comments", "entry-header", "header", "content", "no-share", "", "leadership", "comments-open"):
        assert not wrapper.named_boilerplate(names, True), names
    assert wrapper.named_boilerplate("page-header", False)
