import random

from rasterweave.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>";</script><style>p{{}}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/{0}">{0}</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy {0}</div>
<article><h1>Title &amp; {0}</h1><p><b>first &lt;{0}&gt;<br><p>second   <i>para</i>&nbsp;{0}</p>{1}<aside>note</aside><form><p>mail</p></form><div id="comments"><p>reader {0}</p></div></article>
<footer>&copy; host</footer></body></html>"""
SCHEMA = "page_id long, url string, html string, host string, mask string, blocks int"


def page(i, extra=""):
    return PAGE.format(f"w{i}", extra)


def texts(df):
    return {r.page_id: r.text for r in w.extracted(df).collect()}


def test_article(spark):
    extra = ["", "<h2>part</h2><p>a</p><h2>more</h2><p>b</p><p>c</p>", "<ul><li>x<li>y</ul>", "<table><tr><td>1<td>2</table>"]
    rows = [(i, f"http://h.org/{i}", page(i, extra[i % 4]), "x", "y", 1) for i in range(40)]
    tail = ["", "\npart\na\nmore\nb\nc", "\nx\ny", "\n1\n2"]
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert got == {i: f"Title & w{i}\nfirst <w{i}>\nsecond para w{i}" + tail[i % 4] for i in range(40)}


def test_without_articles(spark):
    plain = '<html><body><div class="menu"><a>m{0}</a></div><div class="wrap"><h1>T{0}</h1><p>text {0}</p></div><div><a href=x>all links {0}</a></div><p class="x">same</p></body></html>'
    main = "<body><header>top {0}</header><main><p>in {0}</p></main><p>out {0}</p></body>"
    rows = [(i, "http://a.org/", plain.format(i), "", "", 0) for i in range(5)] + [(10 + i, "http://b.org/", main.format(i), "", "", 0) for i in range(3)]
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert got == {**{i: f"T{i}\ntext {i}" for i in range(5)}, **{10 + i: f"in {i}" for i in range(3)}}


def test_edges(spark):
    rows = [(1, None, None, None, None, None), (2, "", "", "", "", 0), (3, "http://[bad", "just text", "", "", 0), (4, "http://x", "<div>" * 3000 + "deep" + "</div>" * 3000, "", "", 0), (None, "http://x", "<article>" + "<p>é  w</p>" * 5000 + "</article>", "", "", 0), (5, "http://x", "<p unclosed", "", "", 0)]
    rows += [rows[2]] * 2
    got = w.extracted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[3].text == "just text" and by[4].text == "deep"
    assert by[None].text == "\n".join(["é w"] * 5000) and by[None].n_chars == 5000 * 4 - 1
    assert w.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapper_takes_every_page_it_was_made_of():
    r = random.Random(3)
    parts = ["<p>a</p>", "<h2>b</h2><p>c</p>", "<ul><li>d</li></ul>", "<div class=k>e</div>", "f"]
    trees = [w.parse("<article>" + "".join(r.choice(parts) for _ in range(r.randint(0, 8))) + "</article>") for _ in range(60)]
    shapes = [w.skeleton(t) for t in trees]
    out = w.tree_of(shapes[0])
    for s in shapes[1:]:
        out = w.met(out, w.tree_of(s))
    for s in shapes:
        got = w.mask(w.tree_of(w.plain(out)), w.tree_of(s))
        assert set(got[:-1]) <= {"1"}


def test_merging_in_a_tree_of_groups(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN", 2)
    rows = [(i, "http://h.org/", page(i, "".join(f"<div class=k{'abcdefgh'[j]}>z{j}</div>" for j in range(8) if i >> j & 1)), "", "", 0) for i in range(16)]
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert got[5].endswith("para w5\nz0\nz2") and len(got) == 16


def main_text(html):
    tree = w.parse(html)
    keep = w.View(tree).chosen(*w.View(tree).found())
    return " ".join(t for _, t in sorted((o, t) for s in w.slots(tree) if id(s) in keep for o, t, _ in s.texts))


def test_deep_nesting():
    deep = "<div>" * 150 + "<p>in</p><nav><div>menu</div></nav><form><p>mail</form><p>more</p>" + "</div>" * 150
    assert main_text(f"<body><div><article><p>first</p>{deep}<p>rest</p></article></div><p>out</p></body>") == "first in more rest"
    far = "<div>" * 150 + "<p>before</p><article><p>in</p></article><p>after</p>" + "</div>" * 150
    assert main_text(f"<body>{far}</body>") == "in"


def test_names_that_only_hold_a_bad_word():
    for name in ("layout has-sidebar", "nav-open", "with-menu", "no-sidebar"):
        side = '<div class="sidebar"><article>teaser</article></div><div class="related-posts">more</div>'
        assert main_text(f'<body><div class="{name}"><article><p>text</p></article>{side}</div></body>') == "text"
    inner = '<section id="search-methods"><p>a</p></section><h2 id="legal-history">b</h2><div class="advert">no</div><div id="comments">no</div>'
    assert main_text(f"<body><article>{inner}</article></body>") == "a b"
    assert main_text('<body><div class="related-posts"><article>other</article></div><main>own</main></body>') == "own"


def test_icons_and_formulas():
    assert main_text('<article><p>a <svg class="i"/>b</p><p>c <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><p>d</article>') == "a b c x=1 d"
    assert main_text("<article><div>a<svg><g>no</div><p>rest</p></article>") == "a rest"


def test_names_that_are_doubtful_in_an_article_need_evidence(spark):
    names = ("legal-analysis", "dialog", "notice-of-award", "search", "share-price", "social-history", "alert", "register", "rail-network", "related-work")
    for name in names:
        assert main_text(f'<body><article><p>first</p><section class="{name}"><p>real body</p></section></article></body>') == "first real body"
    one = '<body><article><p>{0}</p><div class="share">Tell your friends</div><section class="search"><p>how I searched {0}</p></section></article></body>'
    rows = [(i, "http://h.org/", one.format(f"w{i}"), "", "", 0) for i in range(5)]
    assert texts(spark.createDataFrame(rows, SCHEMA)) == {i: f"w{i}\nhow I searched w{i}" for i in range(5)}


def test_only_alignment_tells(spark):
    """No label helps: the same divs hold menus, template, adverts and the text."""
    one = "<div><div><div>Our paper</div><div><a href=a>one {0}</a> <a href=b>two</a></div></div><div><div>{1}</div>{2}<div>Printed by us</div></div><div><span>buy {0}</span></div></div>"
    rows = [(i, "http://h.org/", one.format(i, f"long text of page {i} " * 9, "<div><div>more of it</div></div>" * (i % 3 == 0)), "", "", 0) for i in range(9)]
    got = w.extracted(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        assert r.text.startswith(f"long text of page {r.page_id}") and "Printed" not in r.text and "Our" not in r.text and "buy" not in r.text and "one" not in r.text.split()
    assert sum(r.by_evidence for r in got) == 9
    alone = {i: main_text(rows[i][2]) for i in range(9)}
    assert all("Printed by us" in t for t in alone.values())  # a page alone can't tell


def test_a_container_of_template_is_none(spark):
    one = "<body><article><p>About this site, as on every page.</p></article><div><p>text {0} that differs</p><p>and more of it {0}</p></div></body>"
    rows = [(i, "http://h.org/", one.format(i), "", "", 0) for i in range(5)]
    assert texts(spark.createDataFrame(rows, SCHEMA)) == {i: f"text {i} that differs\nand more of it {i}" for i in range(5)}


def test_alignment_against_brute_force():
    from functools import lru_cache

    def most(a, b):
        @lru_cache(None)
        def f(i, j):
            return 0 if i == len(a) or j == len(b) else max(f(i + 1, j), f(i, j + 1), (a[i] == b[j]) + f(i + 1, j + 1))

        return f(0, 0)

    r = random.Random(5)
    for table in (0, w.TABLE):
        w.TABLE, kept = table, w.TABLE
        for _ in range(300):
            a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
            got = w.matches(a, b)
            assert len(got) == most(tuple(a), tuple(b)) and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        w.TABLE = kept


def test_repeats_of_any_period():
    for period in (2, 3, 7, 12):
        one = "".join(f"<div class=k{'abcdefghijkl'[i]}>x</div>" for i in range(period))
        assert w.skeleton(w.parse(f"<section>{one * 3}</section>")).count("#") == period
    assert w.skeleton(w.parse("<div>a</div><div>b</div>")).count("#") == 2 and w.skeleton(w.parse("<div>a</div>" * 5)).count("#") == 1


def test_trees_as_text_and_back():
    r = random.Random(8)

    def tree(depth):
        return w.Node(r.choice(["div.a", "p", "x:y"]), r.randint(0, 3), [tree(depth - 1) if r.random() < 0.6 else w.Node(w.SLOT, 0, None, [[3, 4, 0, 7, 9]]) for _ in range(r.randint(1, 4))] if depth else [])

    for _ in range(50):
        t = w.plain(tree(4), True)
        assert w.plain(w.tree_of(t), True) == t


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L as page_id, cast(X'687474703A2F2F61FF' as string) as url, cast(X'3C703E61FF623C2F703E' as string) as html")
    assert w.extracted(df).select("text").first().text == "a\ufffdb"
