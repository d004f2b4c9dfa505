"""The wrapper's judgement inside and outside of named markup, on small hosts, copies and odd markup."""

import time

import pytest

from millrace.llm import wrapper_html


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = wrapper_html.extract(frame).collect()
    assert len(found) == len(rows)
    return {r.page_id: r.text for r in found}


def plain(i, host="h.org"):
    """No markup names the article."""
    return i, f"http://{host}/{i}", (f"<body><div class=top><ul><li>Home</li><li>Shop</li></ul></div><div class=x><h1>Title {i}</h1><p>First words of {i}.</p><p>More of {i}.</p></div>"
                                     f"<div class=end><p>Terms apply</p></div></body>")


@pytest.mark.parametrize("n", [2, 3, 7, 20])
def test_menus_of_small_hosts(spark, n):
    got = texts(spark, [plain(i) for i in range(n)])
    assert got == {i: f"Title {i}\n\nFirst words of {i}.\n\nMore of {i}." for i in range(n)}


def test_a_single_page_has_no_template(spark):
    assert texts(spark, [plain(0)])[0].startswith("Home\n\nShop\n\nTitle 0")


def test_copies_are_one_page(spark):
    """Ten pages, three times each; and one page a hundred times beside three others."""
    rows = [(100 * k + i, u, h) for i, u, h in map(plain, range(10)) for k in range(3)]
    got = texts(spark, rows)
    assert all(t == f"Title {i % 100}\n\nFirst words of {i % 100}.\n\nMore of {i % 100}." for i, t in got.items())
    hot = [(1000 + k, "http://h.org/0", plain(0)[2]) for k in range(100)] + [plain(i) for i in (1, 2, 3)]
    assert set(texts(spark, hot).values()) == {f"Title {i}\n\nFirst words of {i}.\n\nMore of {i}." for i in range(4)}


def test_template_inside_an_article(spark):
    """What every page repeats in its article goes; what some repeat stays."""
    page = lambda i: f"<article><h1>T {i}</h1><div class=q>Send this to a friend</div><p>Text {i}</p>{'<p>A quote that some share</p>' if i % 3 == 0 else ''}<p>Ask us for more</p></article>"
    got = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(20)])
    assert got[1] == "T 1\n\nText 1" and got[3] == "T 3\n\nText 3\n\nA quote that some share"
    # two pages are too few to overrule the markup
    got = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(2)])
    assert got[1] == "T 1\n\nSend this to a friend\n\nText 1\n\nAsk us for more"


def test_content_outside_an_article(spark):
    page = lambda i: f"<body><p class=up>Latest offers</p><article><p>Text {i}</p></article><div class=rest><p>It goes on {i}</p></div><nav>Go {i}</nav><div class=comments><p>I like {i}</p></div></body>"
    got = texts(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(20)])
    assert got == {i: f"Text {i}\n\nIt goes on {i}" for i in range(20)}
    assert texts(spark, [(0, "http://a.org/0", page(0))]) == {0: "Text 0"}


def test_pages_that_the_wrapper_changes(spark):
    """The same pages on hosts of their own, where nothing can be compared, come out differently in every case."""
    together, alone = texts(spark, [plain(i) for i in range(12)]), texts(spark, [plain(i, f"h{i}.org") for i in range(12)])
    assert sum(together[i] != alone[i] for i in range(12)) == 12


def test_deep_and_broken_markup(spark):
    rows = [(0, "http://d.org/0", "<div>" * 1200 + "deep" + "</div>" * 1200 + "<p>after"), (1, "http://d.org/1", "<div><b>" * 700 + "<p>deep too"),
            (2, "http://d.org/2", "<svg><p>kept"), (3, "http://d.org/3", "<p>before<script>var x = '<p>no'"), (4, "http://d.org/4", "<a " * 50_000 + "<p>end"),
            (5, "http://d.org/5", "".join(f"<div class=k{chr(97 + i % 26)}>" for i in range(3000)) + "bottom")]
    start = time.time()
    got = texts(spark, rows)
    assert got[0] == "deep\n\nafter" and got[1] == "deep too" and got[2] == "kept" and got[3] == "before" and got[4].endswith("end") and got[5] == "bottom"
    assert time.time() - start < 60


@pytest.mark.parametrize("part", ["<a ", "<!", "<!--", "<head>", "<svg>", "<div>", "<p>", "<a '", '<a "', "</div>", "<li>", "<title>", "<script", "<a x=\"'"])
def test_parsing_takes_linear_time(part):
    spent = []
    for n in (5_000, 40_000):
        start = time.process_time()
        wrapper_html.parse(part * n)
        spent.append(time.process_time() - start)
    assert spent[1] < 30 * max(spent[0], 0.02)


def test_a_long_page(spark):
    body = "".join(f"<p>{i} {'word ' * 50}</p>" for i in range(5000))
    got = texts(spark, [(0, "http://l.org/0", f"<article>{body}</article>"), (1, None, f"<div>{body}</div>"), (2, "http://l.org/0", None)])
    assert got[0] == got[1] and got[0].count("\n\n") == 4999 and got[2] == ""
