"""Wrappers are learned from all pages of a host, of each layout, once an article and from every root."""

import random
import sys

from quillspark.llm import html_text


def story(i):
    return f"story {i} " + " ".join(f"word{(i * 7 + j * 13) % 997}" for j in range(10))


def texts(spark, pages):
    rows = [(i, "http://h.example/x", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_every_layout_has_its_template(spark):
    a = [f'<body><div class="a"><p>Site one</p></div><div class="t"><p>{story(i)}</p></div>' for i in range(60)]
    b = [f'<body><section class="b"><p>Desk of letters</p><div><p>{story(i)}</p></div><p>Write to us</p></section>' for i in range(60, 75)]
    assert texts(spark, a + b) == {i: story(i) for i in range(75)}


def test_copies_are_one_article(spark):
    pages = [f"<body><script>{i}</script><div>Site name</div><div><p>{story(1)}</p></div><i>{i}</i>" for i in range(30)]
    pages += [f"<body><div>Site name</div><div><p>{story(i)}</p></div>" for i in range(100, 110)]
    got = texts(spark, pages)
    assert all(story(1) in got[i] for i in range(30)) and all(got[i] == story(i + 70) for i in range(30, 40))


def test_every_root_is_aligned(spark):
    pages = [f"<body><article><p>{story(i)}</p></article><article><p>{story(i + 500)}</p><p>Read on below</p></article>" for i in range(20)]
    assert texts(spark, pages) == {i: f"{story(i)}\n{story(i + 500)}" for i in range(20)}


def brute(a, b):
    """Simple tree matching by its definition, on (label, text, kids) trees: the number of nodes, equal leaves twice."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2], 1):
        for j, y in enumerate(b[2], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute(x, y))
    return 1 + (a[1] is not None and a[1] == b[1]) + m[-1][-1]


def nested(t, i):
    label, text, kids = t.nodes[i]
    return label, text, [nested(t, k) for k in kids]


def test_alignment_matches_most_nodes():
    rng = random.Random(3)

    def page(deep=0):
        kids = "".join(page(deep + 1) for _ in range(rng.randint(0, 4))) if deep < 4 else ""
        tag = rng.choice(("div", "section", "ul"))
        return f"<{tag}>{kids or rng.choice(('x', 'y', 'z'))}</{tag}>"

    for _ in range(60):
        a, b = html_text.Tree(html_text.parse(page() + page())), html_text.Tree(html_text.parse(page() + page()))
        got = html_text.align(a, b)
        assert len(set(got.values())) == len(got) and all(a.nodes[x][0] == b.nodes[y][0] for x, y in got.items())
        score = sum(1 + (a.nodes[x][1] is not None and a.nodes[x][1] == b.nodes[y][1]) for x, y in got.items())
        assert score == brute(nested(a, a.root), nested(b, b.root))


def test_template_of_pages_that_tell_nothing(spark):
    """No article, no telling element or class: what all pages share goes, whatever stands before it; slots stay."""
    def page(i):
        more = "".join(f"<td>{story(1000 + 10 * i + j)}</td>" for j in range(i % 4))
        return f"<body><table><tr><td>Town paper of all days</td><td>Read it every morning</td></tr></table><table><tr>{more}<td>{story(i)}</td><td>Printed by the town press</td></tr></table>"

    pages = [page(i) for i in range(12)]
    got = texts(spark, pages)
    assert got == {i: "\n".join([*(story(1000 + 10 * i + j) for j in range(i % 4)), story(i)]) for i in range(12)}


def test_wide_nodes_and_null_pages(spark, monkeypatch):
    monkeypatch.setattr(html_text, "WIDE", 4)
    rows = "".join(f"<p>{i}</p>" for i in range(300))
    a, b = html_text.Tree(html_text.parse(f"<div>a{rows}</div>")), html_text.Tree(html_text.parse(f"<div><p>new</p>{rows}<p>last</p><p>of all</p></div>"))
    assert len(html_text.align(a, b)) >= 300
    pages = spark.createDataFrame([(None, None, None), (None, "http://h/1", "<p>a b"), (3, "http://h/1", ""), (3, "http://h/1", "")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract_pages(pages).collect()) == [(0, ""), (0, "a b"), (3, ""), (3, "")]


def test_long_footers_are_no_article(spark):
    """A footer longer than every story, nothing that names it: the stories alone stay, copies of one among them."""
    foot = "".join(f"<div><p>{' '.join(f'line{k}of{j}' for j in range(60))}</p></div>" for k in range(3))
    tell = lambda i, n: " ".join(f"s{(i * 31 + j * 17) % 4999}" for j in range(n))
    told = {i: tell(i if i < 30 else 1, 20 + 5 * (i % 2)) for i in range(40)}
    pages = [f"<body><div><p>{told[i]}</p></div>{foot}" for i in range(40)]
    assert texts(spark, pages) == told
    wrapper, model = html_text.induce(pages), html_text.Tree(html_text.parse(pages[0]))
    assert [html_text.extract(p, wrapper, model) for p in pages] == list(told.values())


def calls(f, *args):
    """What f returns, and how many functions of Python it calls."""
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event == "call"

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        out = f(*args)
    finally:
        sys.setprofile(before)
    return out, n


def test_matching_does_no_work_on_what_is_equal_or_alike():
    """Equal subtrees in the middle of pages, and rows of blocks of which none are equal, are not compared one by one."""
    menu = "<ul>" + "".join(f"<li><div>menu {i}</div><div>more {i}</div></li>" for i in range(100)) + "</ul>"
    rows = lambda i: "".join(f"<p>{story(i + j)}</p>" for j in range(300))
    page = lambda i: f"<body><h1>{story(i)}</h1>{menu}<div>{rows(i)}</div><h2>{story(i + 1)}</h2>"
    a, b = html_text.Tree(html_text.parse(page(0))), html_text.Tree(html_text.parse(page(1000)))
    got, n = calls(html_text.align, a, b)
    assert len(got) == len(a.nodes) == len(b.nodes) and got == {i: i for i in range(len(a.nodes))}
    assert n < 100


def test_alignment_of_blocks_with_other_texts():
    """As by the definition where most texts differ and few children are equal."""
    rng = random.Random(9)

    def page(deep=0):
        tag = rng.choice(("div", "div", "section"))
        kids = "".join(page(deep + 1) for _ in range(rng.randint(0, 5))) if deep < 3 else ""
        return f"<{tag}>{kids or rng.randint(0, 60)}</{tag}>"

    for _ in range(80):
        a, b = html_text.Tree(html_text.parse(page() + page())), html_text.Tree(html_text.parse(page() + page()))
        got = html_text.align(a, b)
        assert len(set(got.values())) == len(got)
        score = sum((a.nodes[x][0] == b.nodes[y][0]) + (a.nodes[x][1] is not None and a.nodes[x][1] == b.nodes[y][1]) for x, y in got.items())
        assert score == brute(nested(a, a.root), nested(b, b.root))


def test_wide_nodes_are_matched_as_narrow_ones(monkeypatch):
    """Children beyond WIDE cells match as by the definition: rows with a cell of other text, not equal subtrees alone."""
    rng = random.Random(4)
    row = lambda i, j: f"<section><p>row {i}</p><p>{rng.choice(('yes', 'no', f'only {j}'))}</p></section>"
    many = lambda at, tag: "".join(row(i, at + i) if rng.random() < 0.7 else f"<{tag}>{rng.randint(0, 9)}</{tag}>" for i in range(at, at + 60))
    for wide, kept in ((0, 50), (100, 4_000_000)):
        for at in range(6):
            pages = [html_text.Tree(html_text.parse(f"<div>{many(s, rng.choice(('p', 'ul')))}</div>")) for s in (0, 7 * at)]
            monkeypatch.setattr(html_text, "WIDE", 10**9)
            want = html_text.align(*pages)
            monkeypatch.setattr(html_text, "WIDE", wide)
            monkeypatch.setattr(html_text, "KEPT", kept, raising=False)
            got = html_text.align(*pages)
            assert got == want
    a, b = pages
    score = sum(1 + (a.nodes[x][1] is not None and a.nodes[x][1] == b.nodes[y][1]) for x, y in got.items())
    assert score == brute(nested(a, a.root), nested(b, b.root))


def test_many_rows_of_a_table_find_their_partners():
    """1,200 rows of which no two pages have an equal one: each matches its like, cell by cell."""
    page = lambda n, d: "<table>" + "".join(f"<tr><td>name {i}</td><td>told by day {d}</td></tr>" for i in range(n)) + "</table>"
    a, b = html_text.Tree(html_text.parse(page(1200, 1))), html_text.Tree(html_text.parse(page(1150, 2)))
    got = html_text.align(a, b)
    assert sum(a.nodes[x][1] is not None and a.nodes[x][1] == b.nodes[y][1] for x, y in got.items()) == 1150
