"""Attributes and forms of web pages; templates against slow matching and counting."""

import itertools
import random
import time

import pytest
import xxhash

from provspark.llm import wrapper


def text(page):
    return "\n".join(b.text for b in wrapper.blocks(wrapper.parse(page)) if not b.junk)


@pytest.mark.parametrize("tag", [
    '<p title="the hidden truth">', '<p aria-hidden="false">', '<p data-hidden="0">', '<p data-id="menu">', "<p data-class='share' data-role=search>",
    '<p data-x=/a?id=share>', "<p title = 'id=menu class=ad'>", '<p data-style="display:none">', '<p title="style=display:none">', '<p title="a"class="b">', "<p =hidden-not>", '<p title="hidden',
])
def test_names_inside_names_and_values_say_nothing(tag):
    close = "" if tag.endswith(">") else '">'
    assert text(f"<h1>a</h1>{tag}{close}b</p>") == "a\nb"


def test_links_keep_their_text():
    assert text('<p>see <a href="/hidden-valley">the valley</a>, <a href="/x?id=share">this</a></p>') == "see the valley, this"


@pytest.mark.parametrize("tag", [
    "<div hidden>", '<div HIDDEN="">', '<div title="x"hidden>', '<div id="menu">', "<div class = 'x share'>", "<div role=navigation>", '<div style="display: none">', "<div a=1 id=menu>", "<div/hidden>",
])
def test_exact_names_count(tag):
    assert text(f"<h1>a</h1>{tag}b</div>") == "a"


def test_forms_around_the_page():
    search = '<form><input name=q><button>go</button>find</form>'
    assert text(f"<body><form><h1>a</h1><p>b</p></form></body>") == "a\nb"
    assert text(f"<body><form><div>{search}</div><div><p>b c d</p></div></form></body>") == "b c d"
    assert text(f"<body>{search}<article><p>b</p><form><p></p>no</form></article></body>") == "b"
    assert text("<form><label>name</label><input></form>") == ""
    assert text('<form class="signup"><h1>a</h1></form><p>b</p>') == "b"


def test_heads_inside_articles_stay():
    assert text('<article><div class="article-header"><h1>Title</h1></div><p>x</p></article>') == "Title\nx"
    assert text('<article><div class="header"><h1>Title</h1></div><p>x</p></article>') == "Title\nx"
    assert text('<div class="header">Site</div><article><p>x</p><div class="share">no</div></article>') == "x"


def spots(tree):
    sign, *kids = tree
    s = wrapper.Spot(sign)
    s.kids = [spots(k) for k in kids]
    return wrapper.measure(s)


def slow_match(a, b):
    """The textbook recursion: equal roots, then the best pairing of children in order."""
    if a.sign != b.sign:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, j in itertools.product(range(1, len(a.kids) + 1), range(1, len(b.kids) + 1)):
        m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + slow_match(a.kids[i - 1], b.kids[j - 1]))
    return 1 + m[-1][-1]


def grown(rng, depth):
    return (rng.choice("ab"), *[grown(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)])


def test_simple_tree_matching():
    rng = random.Random(3)
    for _ in range(300):
        a, b = spots(("r", *grown(rng, 3)[1:])), spots(("r", *grown(rng, 3)[1:]))
        assert wrapper.weight(a, b, 9) == slow_match(a, b)
        pairs = wrapper.aligned(a.kids, b.kids, 9)
        assert [p[:2] for p in pairs] == sorted(p[:2] for p in pairs) and len({i for i, _, _ in pairs}) == len(pairs) == len({j for _, j, _ in pairs})
        assert 1 + sum(w for _, _, w in pairs) == slow_match(a, b)


def test_long_lists_of_siblings():
    a, b = ([spots((rng.choice("abc"), *[("x",)] * rng.randrange(3))) for _ in range(20_000)] for rng in (random.Random(1), random.Random(2)))
    t = time.time()
    pairs = wrapper.aligned(a, b)
    assert time.time() - t < 5 and len(pairs) > 5_000 and all(a[i].sign == b[j].sign for i, j, _ in pairs)
    assert text("<div>" * 3000 + "deep") == "deep"


def site(rng, i, notice=True):
    """A page whose menu and notice are constant and carry no telling name."""
    p = "".join(f"<p>text {i} {rng.random()}</p>" for _ in range(rng.randrange(1, 5)))
    again = "<p>Subscribe to our list today</p>" if i % 10 == 0 else ""
    return f"<body><div><p>Home of all</p><p>About us</p></div><div>{p}{again}</div>" + ("<div><b>All rights</b> are ours</div>" if notice else "") + "</body>"


def test_constant_nodes_go(spark):
    rng = random.Random(5)
    rows = [(i, "http://a.example/x", site(rng, i, i % 8 > 0)) for i in range(120)]
    rows += [(1000 + i, "http://a.example/x", rows[3][2]) for i in range(500)]  # repeated pages count once
    rows += [(2000 + i, f"http://few.example/{i}", "<p>Home of all</p><p>both alike</p>") for i in range(2)]
    # the constant text as content, at another node, stays
    rows += [(3000, "http://a.example/y", "<body><div><p>Home of all</p><p>About us</p></div><div><p>a quote:</p><ul><li>Home of all</li></ul></div></body>")]
    rows += [(4000, None, None), (4001, "", ""), (None, "http://a.example/z", "<p>alone</p>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, _salted int")
    got = {r["page_id"]: r for r in wrapper.extract(pages.repartition(1)).collect()}
    other = {r["page_id"]: r for r in wrapper.extract(pages.repartition(17)).collect()}
    assert got == other and len(got) == len(rows) and set(got[0].asDict()) == set(pages.columns)
    for i, _, page in rows[:120]:
        found = got[i]["text"].split("\n")
        assert "Home of all" not in found and "About us" not in found and "All rights are ours" not in found
        assert found == [b.text for b in wrapper.blocks(wrapper.parse(page)) if b.text not in ("Home of all", "About us", "All rights are ours")]
    assert got[1005]["text"] == got[3]["text"] and got[2000]["text"] == "Home of all\nboth alike"
    assert got[3000]["text"] == "a quote:\nHome of all"
    assert (got[4000]["text"], got[4001]["text"], got[None]["text"]) == ("", "", "alone")
    assert wrapper.op10_query(pages.where("false")).count() == 0


def test_constants_are_counted_on_all_distinct_pages(spark):
    rng = random.Random(6)
    shown = [rng.random() < 0.85 for _ in range(200)]
    rows = [(i, "http://h.example/", f"<div><p>{'the notice' if on else f'other {i}'}</p></div><div><p>own {i}</p></div>") for i, on in enumerate(shown)]
    rows += [(i, u, h) for i, u, h in rows if "other" in h for _ in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    fixed = wrapper.constants(pages, wrapper.templates(pages)).collect()
    share = sum(shown) / len(shown)
    assert (len(fixed) == 1) == (share >= wrapper.SHARE)
    assert not fixed or fixed[0]["_texts"] == [wrapper.checksum("the notice")]


@pytest.mark.parametrize("page", [
    '<article><h1>a</h1><h2 id="side-effects">b</h2><p>c</p></article>', '<article><h1>a</h1><h2 id="related-work">b</h2>c</article>', '<article>a<section id="social-history"><p>b</p></section>c</article>',
    '<article>a<h2 id="comments-policy">b</h2>c</article>', '<p>a</p><p id="menu-1">b</p><p>c</p>', '<div>a</div><div class="post share-story"><p>b</p></div><div>c</div>', "<h1>a</h1><h2 class=header>b</h2><p class=notice>c</p>",
])
def test_names_of_texts_say_nothing(page):
    assert text(page).split() == ["a", "b", "c"]


def test_links_in_sentences_stay_whatever_their_class():
    assert text('<p>See <a class="nav-link">this paper</a> for more.</p>') == "See this paper for more."


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "site-header", "sidebar left", "cookie-banner", "share-buttons", "related-posts", "comments_area", "main-nav", "x menu"])
def test_compounds_of_boilerplate_go(name):
    assert text(f'<h1>a</h1><div class="{name}">b</div><p>c</p>') == "a\nc"


def test_menus_without_names_go_though_their_links_vary(spark):
    """No text is constant and no element tells; the articles' own links stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows, want = [], {}
    for i in range(60):
        links = lambda n: "".join(f'<p><a href="/{word()}">{word()} {word()}</a></p>' for _ in range(n))
        own = [f"{word()} {word()} {i}", f"see {word()} here"]
        body = f'<p>{own[0]}</p><p>see <a href="/x">{own[1].split()[1]}</a> here</p>'
        rows.append((i, "http://m.example/", f"<body><div><div>{links(4)}</div><div>{body}</div></div><div>{links(2)}</div></body>"))
        want[i] = "\n".join(own)
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_constant_texts_that_no_page_of_the_sample_has(spark):
    """The pages of the least hashes, which the template is grown from, lack a notice and a whole section that the others have."""
    low, other, most = -(2**62), [], []
    for i in range(2_000):
        own = f"<div><p>own {i}</p></div>"
        without, having = f"<div><p>other {i}</p></div>{own}", f"<div><p>the notice</p></div>{own}<section><p>a banner</p></section>"
        signed = lambda h: (x := xxhash.xxh64_intdigest(h.encode(), 42)) - (x >> 63 << 64)
        if len(other) < wrapper.FIT_PAGES and signed(without) < low:
            other.append((i, "http://s.example/", without))
        elif len(most) < 6 * wrapper.FIT_PAGES and signed(having) > low:
            most.append((i, "http://s.example/", having))
    pages = spark.createDataFrame(other + most, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()}
    assert len(other) == wrapper.FIT_PAGES and len(most) == 6 * wrapper.FIT_PAGES
    assert got == {i: f"other {i}\nown {i}" for i, _, _ in other} | {i: f"own {i}" for i, _, _ in most}
