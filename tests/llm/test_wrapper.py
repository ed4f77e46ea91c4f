import random

import pytest

from coldsplit.llm import dom as D
from coldsplit.llm import wrapper_induction as W


def texts(page):
    return [t for _, t, _ in D.parse(page)[1]]


def test_parse_leaves_out_what_markup_names():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no";</script></head>
    <body class="sidebar-left"><header><a>Site</a></header><nav><ul><li><a>Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy</div><div id="cookie-notice">Cookies</div><main><article><header><h1>A &amp; B &lt;c&gt; &#233;&nbsp;&eacute</h1></header>
    <p><b>One <i>two</i>
      three<br>four<p>Five <span class="ad">buy <span>now</span> all</span> six<ul><li>a<li>b</ul><button>Share</button>
    <table><tr><td>x<td>y</table><blockquote>q</blockquote></article>
    <section class="comments"><article><p>Nice post</p></article></section></main><form><input class="ad">Mail</form><aside>Also</aside><footer>&copy; x</footer>"""
    assert texts(page) == ["A & B <c> é é", "One two three four", "Five six", "a", "b", "x", "y", "q"]


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p><b>", "</p></div>", "<!-- x", "<script>a", "a &am", "<p a='x>y", "\x00<\x00>", "<div>" * 5000, "<p>x" * 5000, "<b>" * 20000, '<a "' * 3000])
def test_any_html_is_read(page):
    skeleton, blocks = D.parse(page)
    assert all(n < len(skeleton.split("\n")) for n, _, _ in blocks) and D.places(skeleton, skeleton) == list(range(len(skeleton.split("\n"))))


def test_broken_html():
    assert texts("a &am") == ["a &am"] and texts("<p>a<p>b</div>c") == ["a", "bc"] and texts("x < y <p>z") == ["x < y", "z"]
    assert texts("<article><h1>T</h1><p><b>One.<br></article><footer>f") == ["T", "One."]


def brute_match(a, b, x=0, y=0):
    """The plain recursion of simple tree matching."""
    if a.label[x] != b.label[y]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute_match(a, b, xs[0], ys[0]) + best(xs[1:], ys[1:]))

    return 1 + best(a.kids[x], b.kids[y])


def _tree(rng, depth=3):
    lines = ["0 body"]

    def grow(d):
        for _ in range(rng.randint(0, 3)):
            lines.append(f"{d} {rng.choice('pqr')}")
            if d < depth:
                grow(d + 1)

    grow(1)
    return "\n".join(lines)


def test_alignment_is_the_largest_and_merging_keeps_all():
    rng = random.Random(3)
    for _ in range(60):
        s, t, u = (_tree(rng) for _ in range(3))
        a, b = D.Tree(s), D.Tree(t)
        at = D.align(a, b)
        assert len(at) == brute_match(a, b)
        assert all(a.label[x] == b.label[y] and (y == 0 or at[b.parent[y]] == a.parent[x]) for y, x in at.items())
        w = D.merge([s, t, u])
        for part in (s, t, u):
            assert -1 not in D.places(w, part)


def test_skeletons_merge_repeats():
    one = "".join(f"<li><a>{i}</a></li>" for i in range(9))
    page = f"<nav><ul>{one}</ul></nav>" + "<h2>t</h2><p>x</p>" * 50 + "<div class=c1><p>a</p></div><div class=c2><p>b</p><p>c</p></div>"
    skeleton, blocks = D.parse(page)
    assert skeleton == "0 body\n1 nav\n2 ul\n3 li\n1 h2\n1 p\n1 div.c\n2 p"
    assert [n for n, _, _ in blocks] == [4, 5] * 50 + [7, 7, 7]


def page(title, body, extra=""):
    return f"<html><body><div><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in body)}</div>{extra}<div><p>All rights of this site</p></div>"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "t", 1) for r in rows], "page_id long, url string, html string, n_chars int, text string, host int").repartition(4)
    return {r["page_id"]: r["text"] for r in W.extract(df).collect()}


def test_unnamed_template_goes_by_alignment(spark, monkeypatch):
    """No element or class says what is a menu: only what the pages of a host have
    in common does. A notice that half of the pages lack shifts all that follows."""
    monkeypatch.setattr(W, "FOLD", 2)
    notice = "<section><p>We moved</p></section>"
    rows = [(i, "http://a.example/x", page(f"Title {i}", [f"text {i} {j}" for j in range(1 + i % 3)], notice if i % 2 else "<table><tr><td>odd</td></tr></table>")) for i in range(40)]
    # the same site with copies of one article: they are not template
    rows += [(100 + i, "https://b.example/", page("Same", ["Same article", "twice"]) if i < 30 else page(f"Own {i}", [f"own {i}"])) for i in range(45)]
    got = run(spark, rows)
    for i in range(40):
        assert got[i] == "\n\n".join([f"Title {i}", *[f"text {i} {j}" for j in range(1 + i % 3)]])
    assert got[100] == "Same\n\nSame article\n\ntwice" and got[140] == "Own 40\n\nown 40"


def test_small_hosts_share_evidence_by_label_path(spark):
    rows = [(i, f"http://h{i}.example/" if i % 3 else None, f"<div class=text{i}><h2>t{i}</h2><p>the longer text {i}</p></div><div class=legal><p>All rights</p></div>") for i in range(20)]
    assert run(spark, rows) == {i: f"t{i}\n\nthe longer text {i}" for i in range(20)}


def test_small_hosts_use_markup(spark):
    html = "<nav>m</nav><article><h1>T</h1><p>only page</p></article><footer>f</footer>"
    assert run(spark, [(1, "http://one.example/", html)]) == {1: "T\n\nonly page"}


def test_edge_rows_and_empty_tables(spark):
    rows = [(0, None, None), (1, "http://a.example", None), (2, "http://a.example", ""), (None, "x", "<p>y"), (3, "http://a.example", "<p>" + "long text " * 100_000), (4, "//u@b.example:80/?q", "<p>one"), (4, "//u@b.example:80/?q", "<p>one")]
    got = run(spark, rows)
    assert got == {0: "", 1: "", 2: "", None: "y", 3: ("long text " * 100_000).strip(), 4: "one"}
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.extract(df).collect() == []


def test_all_pages_of_the_table(spark, sf_small):
    """The articles of the generated pages, as their markup says."""
    import html as H
    import re

    pages = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in W.op11_query(spark, sf_small).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in want if b)
        assert got[p["page_id"]] == (want, len(want))
