"""Small hand-made documents for every selector."""

import pytest

from forgelake.functions.text import unescape
from forgelake.operators.frontier import crawl_transitions, one_hop
from forgelake.sources import pages

BASE = "https://hub.example"


def docs(spark, rows, columns="org string, page int, html string"):
    return spark.createDataFrame(rows, columns)


def repos_of(spark, rows, **options):
    found = pages.organisation_repos(docs(spark, rows), base_url=BASE, **options)
    return {(r.org, r.id): r for r in found.collect()}


def test_each_organisation_selector(spark):
    html = """<body>
      <a href="/o/plain">no match</a>
      <A class=x data-hovercard-type="repository" HREF='/o/one'>1</A>
      <h3 class="t"><span><a href="/o/two/tree/main">2</a></span></h3>
      <h4><a href="/o/four">no match</a></h4>
      <li class="a Box-row b"><a href="/o/three">3</a><a href="/elsewhere/x">other</a></li>
      <li class="Box-rows"><a href="/o/nine">no match</a></li>
      <a data-hovercard-type="user" href="/o/ten">no match</a>
    </body>"""
    got = repos_of(spark, [("o", 1, html)])
    assert {k: (v.selector_rank, v.url) for k, v in got.items()} == {
        ("o", "o/one"): (1, f"{BASE}/o/one"),
        ("o", "o/two"): (2, f"{BASE}/o/two/tree/main"),
        ("o", "o/three"): (3, f"{BASE}/o/three"),
    }


def test_nested_unclosed_and_quoted_markup(spark):
    html = """<a data-hovercard-type="repository" href="/org/hover">x</a>
      <ul><li class="Box-row"><ul><li>x</li></ul><a href="/org/nested">n</a></li><li><a href="/org/none">n</a></li></ul>
      <h3><a title="a > b" href="/org/gt">g</a></h3><div><h3><a href="/org/unclosed">u</a></div><a href="/org/after">a</a>
      <H3><br><img src=x><a href='/org/void'>v</a></H3></h3><a href="/org/stray">s</a>"""
    got = repos_of(spark, [("org", 1, html)])
    assert {k[1]: v.selector_rank for k, v in got.items()} == {
        "org/hover": 1, "org/gt": 2, "org/unclosed": 2, "org/void": 2, "org/nested": 3,
    }


def test_first_sighting_wins_per_organisation(spark):
    h3 = "<h3><a href='/o/r{}'>x</a></h3>"
    hover = "<a data-hovercard-type='repository' href='/o/r/pulse'>x</a>"
    rows = [("o", 2, hover), ("o", 1, h3.format("/code") + hover), ("p", 1, h3.format(""))]
    got = repos_of(spark, rows)
    # On page 1 the first selector comes first, wherever it stands on the page.
    assert got[("o", "o/r")].url == f"{BASE}/o/r/pulse" and got[("o", "o/r")].page == 1
    assert got[("p", "o/r")].url == f"{BASE}/o/r" and len(got) == 2


def test_path_shapes_and_noise(spark):
    html = (
        "<h3><a href='/two'>short</a></h3><h3><a href='https://x/o/abs'>absolute</a></h3><h3><a>none</a></h3>"
        "<h3><a href='/o/deep/a/b/c'>deep</a></h3><h3><a data-href='/o/wrong' href=/o/bare>b</a></h3>"
        "<!-- <h3><a href='/o/comment'>c</a></h3> --><script>var s = \"<h3><a href='/o/script'>s</a></h3>\";</script>"
        "<style>/* <h3><a href='/o/style'></a></h3> */</style><h3><a href='/o/a&amp;b'>e</a></h3>"
    )
    got = repos_of(spark, [("o", 1, html)])
    assert {k[1] for k in got} == {"o/deep", "o/bare", "o/a&b"}
    assert got[("o", "o/deep")].owner == "o" and got[("o", "o/deep")].name == "deep"


def test_page_limit(spark):
    rows = [("o", n, f"<h3><a href='/o/r{n}'>x</a></h3>") for n in (1, 50, 51)]
    assert len(repos_of(spark, rows)) == 3
    assert {k[1] for k in repos_of(spark, rows, max_pages=50)} == {"o/r1", "o/r50"}


def test_organisation_sweep_budget(spark):
    rows = [(o, n, f"<h3><a href='/{o}/r{n}'>x</a><a href='/{o}/s{n}'>x</a></h3>") for o in "ab" for n in (1, 2)]
    found = pages.organisation_repos(docs(spark, rows), base_url=BASE)
    orgs = spark.createDataFrame([("b", 1), ("a", 2)], "org string, org_pos int")
    assert [r.id for r in pages.organisation_sweep(found, orgs, 5).collect()] == ["b/r1", "b/s1", "b/r2", "b/s2", "a/r1"]


def test_trending_logins(spark):
    html = (
        "<article><h1 class='h3'><a href='/ada'>Ada</a></h1><h1><a href='https://x'>no</a></h1><p><a href='/not'>x</a></p></article>"
        "<h1><a href='/outside'>x</a></h1><article><h1><a href='/grace'>G</a><a href='/'>empty</a><a href='/ada'>again</a></h1></article>"
    )
    rows = docs(spark, [(1, html), (2, html)], "page int, html string")
    got = pages.trending_logins(rows).orderBy("page", "selector_rank", "pos").collect()
    assert [(r.login, r.page) for r in got] == [("ada", 1), ("grace", 1)]


CARDS = """
<h3><a href="/ada/outside">x</a></h3>
<article><h3><a href="/ada/one/tree">1</a></h3><p> First <b>one</b> &amp; only </p><p>second</p>
  <span itemprop="programmingLanguage"> C++ </span></article>
<article><h3><a href="/ada">short</a><a href="other/x">relative</a></h3></article>
<article><h3><a href="/bob/two">2</a><a href="/bob/three">3</a></h3></article>
<h3><a href="/ada/tail">x</a></h3>
"""


def test_profile_cards(spark):
    rows = docs(spark, [("ada", CARDS)], "login string, html string")
    got = pages.profile_cards(rows, ["login"], base_url=BASE).orderBy("pos").collect()
    assert [(r.id, r.description, r.language, r.stars, r.url) for r in got] == [
        ("ada/outside", "", "", 0, f"{BASE}/ada/outside"),
        ("ada/one", "First one & only", "C++", 0, f"{BASE}/ada/one"),
        ("bob/two", "", "", 0, f"{BASE}/bob/two"),
        ("bob/three", "", "", 0, f"{BASE}/bob/three"),
        ("ada/tail", "", "", 0, f"{BASE}/ada/tail"),
    ]


def test_nested_and_unclosed_cards(spark):
    html = (
        '<article><article>in</article><h3><a href="/o/r">r</a></h3><p>desc</p><i itemprop=programmingLanguage>C</i></article>'
        '<article><p>outer<article><h3><a href="/o/in">i</a></h3><div><p>inner <b>text</b><ul><li>x</ul></div></article>'
        '<h3><a href="/o/out">o</a></h3></article>'
        '<article><h3><a href="/o/last">l</a></h3><p>never <!-- c --> closed'
    )
    got = pages.profile_cards(docs(spark, [("o", html)], "login string, html string"), ["login"], base_url=BASE)
    assert [(r.id, r.description, r.language) for r in got.orderBy("pos").collect()] == [
        ("o/r", "desc", "C"), ("o/in", "inner text", ""), ("o/out", "outer", ""), ("o/last", "never   closed", ""),
    ]


def test_one_hop_expansion(spark):
    def card(path):
        return f"<article><h3><a href='{path}'>x</a></h3></article>"

    rows = [("ada", card("/ada/a") + card("/ada/b")), ("bob", card("/bob/c")), ("cy", card("/cy/d"))]
    cards = pages.profile_cards(docs(spark, rows, "login string, html string"), ["login"], base_url=BASE)
    users = spark.createDataFrame([("bob", 1), ("ada", 2), ("bob", 3), ("cy", 4)], "login string, place int")
    hops = crawl_transitions(one_hop(users, cards, 3)).orderBy("seq").collect()
    assert [(h.from_state, h.to_state) for h in hops] == [("bob", "bob/c"), ("ada", "ada/a"), ("ada", "ada/b")]
    fallback = spark.createDataFrame([("cy", 1)], "login string, place int")
    assert [r.id for r in one_hop(users.limit(0), cards, 3, fallback=fallback).collect()] == ["cy/d"]


def test_first_elements(spark):
    html = "<script>var t='</p>';</script><article><h1>T&lt;</h1><p>one<br><p>two</article><article><h1>no</h1></article>"
    rows = docs(spark, [(1, html), (2, "nothing")], "page int, html string")
    got = pages.first_elements(rows, ["page"], scope="article", names={"t": "h1", "p": "p"})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "T<", "one"), (2, "", "")]



@pytest.mark.parametrize(
    "text, want",
    [("a&#233;&#x27;b", "aé'b"), ("&eacute;&euro;&copy;", "é€©"), ("&amp;lt; &lt;", "&lt; <"), ("&amp;#233;", "&#233;"),
     ("&nope; &#0; &#xD800; &amp", "&nope; &#0; &#xD800; &amp"), ("&#38;amp;", "&amp;"), ("&#038;amp; &amp;", "&amp; &"), ("&#x1F600;", "😀"), (None, None)],
)
def test_character_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(unescape("t")).first()[0] == want
