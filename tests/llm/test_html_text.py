import pytest

from forgelake.llm import html_text
from forgelake.llm.html_text import main_text

LONG = "The man is in the house and the dog is on the way to it with all of us in the car and so on."
ITALIAN = "Questo paese vicino mare offriva ogni giorno qualcosa che nessuno avrebbe mai immaginato prima, davvero molto bello."
CHINESE = "这座城市位于河流旁边,每天都有许多人来到这里参观古老的建筑。" * 4
NAMES = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("no tags at all", "no tags at all"),
        ("<p>a&amp;b &eacute;&#233;&#x27; &lt;b&gt;", "a&b éé' <b>"),
        ("<p>a\n\t b<br>c<p>d</p>e", "a b c\nd\ne"),
        ("<title>t</title><script>if (a < b) '</p>'</script><style>p{}</style><p>x<!-- y --></p>", "x"),
        (f"<article><h1>T</h1><p>{LONG}<a title='a > b' href=x>link</a></p></article>", f"T\n{LONG}link"),
        (f"<nav><ul><li><a href=/a>A</a></ul></nav><header>H</header><p>{LONG}</p><footer>f</footer>", LONG),
        (f"<main><p>{LONG}</p><div class='comments'><p>{LONG} A comment.</p></div><p>End", f"{LONG}\nEnd"),
        (f"<div id='cookie-notice'>{LONG}</div><p>{LONG}</p><form><p>{LONG}</p></form><aside>{LONG}</aside>", LONG),
        (f"<div class='with-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<article><p>{NAMES}</p><p>{LONG}</p></article>", f"{NAMES}\n{LONG}"),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><footer>by</footer></article>", f"T\n{LONG}"),
        (f"<div class=ad>{LONG}</div><article><p>{LONG}</p></article>", LONG),
        # Languages whose stop words are not known: length decides.
        (f"<h1>{ITALIAN[:19]}</h1><p>{ITALIAN}</p><p>{ITALIAN}!</p><p><a href=/a>{ITALIAN}</a></p>", f"{ITALIAN[:19]}\n{ITALIAN}\n{ITALIAN}!"),
        (f"<nav>{CHINESE}</nav><p>{CHINESE}</p><div class=ad>{CHINESE}</div>", CHINESE),
        (f"<article class='post category-promotion tag-social'><h1>T</h1><p>{LONG}</p></article>", f"T\n{LONG}"),
        (f"<article class='promo post'><h1>T</h1><p>{LONG}</p></article>", f"T\n{LONG}"),
        (f"<p>{LONG}</p><article class='comment'><p>{LONG} Me too.</p></article>", LONG),
        ("<div hidden>x</div><p style='display:none'>y</p><p>z</p>", "z"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_first_pass_by_stop_words_length_and_links():
    block = lambda text, links=0, **k: html_text.Block(text, links, k.get("outside", False), k.get("article", False), False, False)
    assert html_text.first_pass(block(LONG)) is True
    assert html_text.first_pass(block(NAMES)) is False
    assert html_text.first_pass(block(NAMES), known=False) is True
    assert html_text.first_pass(block(NAMES, len(NAMES)), known=False) is False
    assert html_text.first_pass(block(NAMES, article=True)) is None
    assert html_text.first_pass(block("short")) is None
    assert html_text.first_pass(block(LONG, len(LONG))) is False
    assert html_text.first_pass(block(LONG, outside=True)) is False


def test_second_pass_inherits_from_the_nearest_neighbour():
    def blocks(*sizes):
        return [html_text.Block("x" * n, 0, False, False, False, False) for n in sizes]

    assert html_text.second_pass(blocks(90, 10, 90), [True, None, True]) == [True, True, True]
    assert html_text.second_pass(blocks(90, 10, 90), [False, None, False]) == [False, False, False]
    # Two open blocks between unlike neighbours: each takes the nearer side.
    assert html_text.second_pass(blocks(90, 10, 20, 90), [True, None, None, False]) == [True, True, False, False]
    assert html_text.second_pass(blocks(10), [None]) == [True]


def test_extract_keeps_columns_and_rows(spark):
    rows = [(1, "u", f"<p>{LONG}", 5), (1, "u", f"<p>{LONG}", 5), (None, None, None, None), (3, "v", "<p>" + "word the " * 100_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_blocks int")
    found = html_text.extract(df)
    assert found.columns == ["page_id", "url", "n_blocks", "text"]
    got = sorted((r["page_id"] or 0, r["url"], len(r["text"])) for r in found.collect())
    assert got[0] == (0, None, 0) and got[1] == got[2] == (1, "u", len(LONG)) and got[3][2] == 9 * 100_000 - 1
    assert html_text.extract(df.limit(0)).count() == 0
