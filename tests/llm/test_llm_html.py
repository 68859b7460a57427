import math
import random
import re

from terravet.llm import html_text
from terravet.llm.html_text import main_text

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<nav><a href=x>a</a></nav><main><article><header><h1>Head &amp; line</h1></header><div class="body">
<p>One <b>bo</b>ld text that is quite long, really.<p>Two&nbsp;x   y <a href=q>link</a> long text follows here.</div>
<section id="comments"><div class="comment">Nice!</div></section></article></main>
<div class="sidebar"><p>side text here that is long and has no links at all in it</p></div>
<form><input name=q><label>Search</label></form><aside>other</aside><script>var t="</p>";</script><footer>(c)</footer>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == ("Head & line One bold text that is quite long, really. Two x y link long text follows here.")


def test_density_without_article_element():
    page = """<body><div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=content>
    <h1>Title here</h1><p>First long paragraph with many words in it.<p>Second long paragraph with many words in it.
    <div class=part><p>Third paragraph, in a part, with words.</div></div><div><a href=1>x</a> <a href=2>y</a></div>"""
    assert main_text(page) == ("Title here First long paragraph with many words in it. Second long paragraph with many"
                               " words in it. Third paragraph, in a part, with words.")


def test_second_dense_subtree_is_kept():
    part = "<div><p>{0} words of the first kind, many of them.</p><p>{0} more words of the kind.</p><p>{0} and more.</p></div>"
    text = main_text("<body>" + part.format("Alpha") + part.format("Beta") + "<div><a href=1>x</a></div></body>")
    assert "Alpha words" in text and "Beta words" in text and "x" not in text.split()


def test_broken_and_extreme_pages():
    assert main_text("") == "" and main_text("a < b <p") == "a < b"
    assert main_text("plain <b>text</b> only") == "plain text only"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<p>" + "word " * 200_000).count("word") == 200_000
    assert main_text("<article><p>&lt;b&gt; &#233;&eacute; &unknown; &amp</article>") == "<b> éé &unknown; &"
    assert main_text("</div></p></b>x<!-- open") == "x"


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "v", "<p>a</p><p>b</p>", None), (3, "v", "<p>a</p><p>b</p>", None),
                                (None, None, "<nav>x</nav>", "t")], "page_id bigint, url string, html string, text string")
    out = html_text.extract(df, keep=["page_id", "url"]).collect()
    assert [r.text for r in out] == ["", "", "a b", "a b", ""]
    assert html_text.extract(df.limit(0), keep=["page_id"]).count() == 0


def test_every_page_gives_its_article(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in html_text.extract(pages, keep=["page_id", "html"]).collect():
        body = row.html[row.html.index("<article>") + 9:].split("</article>")[0]
        assert row.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_names_do_not_drop_the_main_part():
    body = "<article><p>First words of the text, many of them here.</p><p>More words of the text, many of them.</p></article>"
    text = "First words of the text, many of them here. More words of the text, many of them."
    menu = "<nav><a href=1>One</a></nav><div class='sidebar'><a href=2>Two</a></div>"
    for opened, closed in (('<div class="content no-sidebar">', "</div>"), ('<div class="has-sidebar">', "</div>"),
                           ('<section class="discussion">', "</section>"), ('<div id="social-policy">', "</div>"),
                           ('<form action="x">', "</form>"), ('<form><div class="comments">', "</div></form>")):
        for inner in (body, body.replace("article", "div")):
            assert main_text(f"<body>{menu}{opened}{inner}{closed}</body>") == text, (opened, inner)
    assert main_text("<body><div class=comments><p>Some words.</p></div><div class=social><p>Other text.</p></div></body>") != ""
    comments = "<section class='comments'><p>Short reply of a reader, one of many more.</p></section>"
    assert main_text(f"<body><div>{body}{comments * 3}</div></body>") == text
    others = "".join(f"<div class='promo-{i}'><p>Words {'of an offer ' * 4}here.</p></div>" for i in range(5))
    assert main_text(f"<body><h4>Top</h4><section class=discussion><div>{body[9:-10]}</div></section>{others}</body>").endswith(text)


def test_all_articles_and_the_lead_are_kept():
    part = "<article><h2>{0} head</h2><p>{0} words of the text, many of them here.</p><p>{0} more words of the text.</p></article>"
    lead = "<p>Lead words of the text before its article.</p>"
    both = "{0} head {0} words of the text, many of them here. {0} more words of the text."
    text = both.format("Alpha") + " " + both.format("Beta")
    menu = "<div><a href=1>One</a> <a href=2>Two</a></div>"
    for page in (f"<body>{menu}{part.format('Alpha')}{part.format('Beta')}{menu}</body>",
                 f"<body>{menu}<div>{part.format('Alpha')}{menu}{part.format('Beta')}</div></body>"):
        assert main_text(page) == text
    assert main_text(f"<body>{menu}<main>{lead}{part.format('Alpha')}{part.format('Beta')}</main>{menu}</body>") == (
        "Lead words of the text before its article. " + text)


def given_pages():
    import pyarrow.parquet as pq
    return [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


def renamed(html):
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", html)


def test_density_finds_the_article_without_its_element():
    pages = given_pages()
    assert sum(html_text.main_text(p) == html_text.main_text(renamed(p)) for p in pages) >= len(pages) - 1


def plain_page(rng):
    """(html, main text) of a page of plain divs: a menu, adverts, related links and a footer around the text."""
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    link = lambda n: f'<a href="/{word()}">{text(n)}</a>'
    menu = "<div>" + "".join(f"<div>{link(rng.randint(1, 3))}</div>" for _ in range(rng.randint(5, 25))) + "</div>"
    advert = lambda: f"<div><div>{link(rng.randint(3, 6))}</div><div>{link(2)}</div></div>"
    related = "<div>" + "".join(f"<div>{link(rng.randint(5, 9))} </div>" for _ in range(rng.randint(4, 9))) + "</div>"
    footer = f"<div><div>{link(1)} {link(1)} {link(2)} {link(1)}</div></div>"
    blocks = [text(rng.randint(3, 8))] + [text(rng.randint(25, 90)) for _ in range(rng.randint(3, 9))]
    main = f"<div><h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + "</div>"
    inner = f"<div>{menu}{advert()}{main}{related}{advert()}</div>" if rng.random() < 0.5 else menu + advert() + main + related
    return f"<html><body>{inner}{footer}</body></html>", " ".join(blocks)


def test_plain_divs_need_the_density(monkeypatch):
    rng = random.Random(6)
    pages = [plain_page(rng) for _ in range(120)]
    right = sum(html_text.main_text(html) == text for html, text in pages)
    monkeypatch.setattr(html_text, "composite_density", lambda *_: 1.0)
    constant = sum(html_text.main_text(html) == text for html, text in pages)
    assert right >= 0.97 * len(pages) and constant <= 0.2 * len(pages)


def test_density_sums_and_threshold_equal_a_plain_walk():
    rng = random.Random(9)
    for html in [plain_page(rng)[0] for _ in range(20)] + [renamed(p) for p in given_pages()[:40]]:
        tree = html_text.Tree()
        tree.feed(html)
        tree.close()
        n = len(tree.tags)
        children = {i: [j for j in range(1, n) if tree.parent[j] == i] for i in range(n)}
        own = {i: "".join(t for node, t in tree.pieces if node == i and t) for i in range(n)}

        def count(i):
            """(characters, link characters, tags, link tags) of a subtree, walked from its root."""
            if tree.drop[i]:
                return (0, 0, 0, 0)
            size = len(re.sub(r"[ \n\t\r]", "", own[i]))
            total = [size, size if tree.in_link[i] else 0, 0, 0]
            for j in children[i]:
                c = count(j)
                total = [a + b for a, b in zip(total, c)]
                if not tree.drop[j]:
                    total[2] += 1
                    total[3] += tree.in_link[j]
            return tuple(total)
        last, body, density, sums, best, linked = html_text.measured(tree, tree.drop)
        counts = {i: count(i) for i in range(n)}
        share = counts[body][1] / max(counts[body][0], 1)
        for i in range(n):
            c, k, t, kt = counts[i]
            want = 0.0 if tree.drop[i] or not c else c / max(t, 1) * math.log(max(c / max(k, 1) * max(t, 1) / max(kt, 1), 1.0)) / math.log(
                math.log(c / max(c - k, 1) * max(k, 1) + share * c + math.e))
            assert math.isclose(density[i], want, abs_tol=1e-12)
        for i in range(n):
            assert math.isclose(sums[i], sum(density[j] for j in children[i]), abs_tol=1e-9)
        inside = [i for i in range(n) if body <= i < last[body]]
        assert math.isclose(sums[best[body]], max(sums[i] for i in inside))


def test_marks_in_scripts_are_no_comments():
    assert html_text.main_text('<body><script>var s="<!--";</script><article><p>kept text</p></article></body>') == "kept text"
    assert html_text.main_text("<body><p>kept text</p><!-- never closed <p>gone</p></body>") == "kept text"
    assert html_text.main_text("<body><p>kept</p><!-- a --><style>/* <!-- */</style><p>too</p></body>") == "kept too"


def test_column_of_the_result_is_replaced(spark):
    pages = spark.createDataFrame([(1, "<p>new words</p>", "old")], "page_id bigint, html string, text string")
    assert [r.asDict() for r in html_text.extract(pages).collect()] == [{"page_id": 1, "text": "new words"}]
