"""Operators 2 and 10: wrapper induction and revisit resolution."""
import duckdb
from pyspark.sql import functions as F

from cohortlake.llm import warc as C
from cohortlake.llm import wrappers as W

from .conftest import prose


def page(host, i, body, menu="Home About"):
    items = "".join(f"<li><a href=/x>{m}</a>" for m in menu.split())
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><ul class=top>{items}</ul>"
            f"<div><b>{host} news</b></div><div id=main-text>{body}</div><div>All rights reserved</div></body></html>")


def test_template_without_semantic_marks_is_induced(spark):
    bodies = {i: (f"<h1>Title {prose(i, 3)}</h1>", f"{prose(i + 100, 40)}") for i in range(12)}
    rows = [(i, f"http://a.example/{i}", page("a", i, f"{h}<p>{p}<p>{p[::-1]}")) for i, (h, p) in bodies.items()]
    got = {r.page_id: r for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (h, p) in bodies.items():
        want = f"{h[4:-5]} {p} {p[::-1]}"
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].n_template == 4


def test_wrappers_of_a_host_with_copies_and_two_layouts(spark):
    """Most rows are copies of two pages, and the rest shares two layouts; no name tells the template."""
    rows, want = [], {}
    for i in range(600):
        n = i % 2 if i < 540 else i
        body = prose(n, 30)
        left = f"<ul><li>Home</ul><div><b>site news</b></div><div><p>{body}</p></div><div>All rights</div>"
        right = f"<table><tr><td>Shop front</table><section><p>{body}</p></section><section>Call us</section>"
        rows.append((i, "http://a.example/x", f"<html><body>{right if n % 3 == 0 else left}</body></html>"))
        want[i] = body
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), sample=8).collect()}
    assert got == want


def test_recurring_texts_are_counted_over_all_pages(spark):
    """A note that is the same on 22 or on 28 of a host's 100 pages, the others' own: a quarter decides, whichever pages some draw would hit."""
    rows, want = [], {}
    for h in range(16):
        for i in range(100):
            key = h * 100 + i
            body, note = prose(key, 30), "buy now" if i < (22 if h % 2 else 28) else prose(key + 10_000, 6)
            rows.append((key, f"http://h{h}.example/{i}", f"<body><ul><li>Home</ul><div><p>{body}</p></div><h6>{note}</h6></body>"))
            want[key] = f"{body} {note}" if h % 2 else body
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


def test_recurring_share_of_few_pages_is_exact():
    assert W.recurs([(1, 9), (3, 1)]) and not W.recurs([(1, 10), (3, 1)]) and not W.recurs([(3, 1)])
    assert W.recurs([(1, 72), (28, 1)]) and not W.recurs([(1, 78), (22, 1)])
    assert not W.recurs([(2, 5000)]) and W.recurs([(100, 100)])  # 10,000 pages: pairs don't come back among 40, a stock of 100 does


def test_trees_are_sent_whole():
    root = W.parse("<body class=x><nav>a</nav><article><p>b<p>c<br>d</article><div class=ad>e</div></body>")
    again = W.unpack(W.pack(root))
    assert [(n.text, h) for n, h in W.node_hashes(again)] == [(n.text, h) for n, h in W.node_hashes(root)] and W.without(again, None) == W.without(root, None) == ("b c d", 0)
    assert list(W._texts(W.unpack(W.pack(root, outside=True)))) == ["a", "e"]


def test_stock_menus_outside_an_article_are_template():
    stock = ["one two", "three four", "five six"]
    sources = [f"<ul>{''.join(f'<li>{w}' for w in stock[i % 3].split())}</ul><div>{prose(i, 30)}</div>" for i in range(12)]
    made = W.induce(sources)
    import json
    tree = W._tree(json.loads(made))
    assert W.main_text(sources[4], tree)[0] == prose(4, 30)


def test_article_is_cut_by_structure():
    src = """<body><nav>menu</nav><header>site</header><div class="cookie-notice">We use cookies</div>
    <article><header><h1>A &amp; B&nbsp;C</h1></header><p>One<br>two <b>bo</b>ld.<p>x &lt; y <!-- no --> z<form><input>send</form><aside>see also</aside>
    <div class="ad">buy</div><table><tr><td>1<td>2</table><section class="comments"><article>reader</article></section></article><footer>foot</footer></body>"""
    assert W.main_text(src, None)[0] == "A & B C One two bold. x < y z 1 2"


def test_marks_are_whole_names_and_never_the_frame():
    for frame in ("single-post has-sidebar", "no-sidebar", "cookies-not-set", "sidebar", "menu"):
        assert W.main_text(f"<html class='{frame}'><body class='{frame}'><div class='site-footer'>foot</div><article>Text here</article></body>", None)[0] == "Text here"
        assert W.main_text(f"<body class='{frame}'><p>Text here<div class='site-footer'>foot</div></body>", None)[0] == "Text here"
    for name in ("post category-social", "comments-open", "social"):
        assert W.main_text(f"<div class='cookie-notice'>We use</div><article class='{name}'>Text here</article>", None)[0] == "Text here"
    assert W.main_text("<div class=overlay><article>Text here</article></div><footer>f</footer>", None)[0] == "Text here"
    assert W.main_text("<div class=related><p>Text here, most of it</div><div>short</div>", None)[0] == "Text here, most of it short"
    assert W.main_text("<p>Text<div class='main-menu'>Home</div><div class='cookie-notice'>We</div>more of the text", None)[0] == "Text more of the text"


def test_all_top_level_articles_stay():
    src = "<main><article>first one</article><p>between<article>second, longer</article></main><div class=comments><article>a reader's very long answer to both</article></div>"
    assert W.main_text(src, None)[0] == "first one second, longer"


def test_broken_markup():
    assert W.main_text("<article><p>cut off <b>here<br", None)[0] == "cut off here"
    assert W.main_text("plain text", None)[0] == "plain text"
    assert W.main_text("<article>a<script>never closed", None)[0] == "a"
    assert W.main_text("<p>1 < 2 &am</p>", None)[0] == "1 < 2 &am"
    assert W.main_text("", None)[0] == ""


def test_tree_matching_counts():
    a, b = W.parse("<div><p>x<p>y<ul><li>z</ul></div>"), W.parse("<div><p>x<ul><li>z<li>w</ul></div>")
    pairs = []
    assert W.match(a, b, pairs) == 7 and [(x.text, y.text) for x, y in pairs][-1] == ("z", "z")
    long_a, long_b = (W.parse("<div>" + "".join(f"<p>{i}" for i in range(n)) + "</div>") for n in (300, 200))
    assert W.match(long_a, long_b) >= 2 + 2 * 200


def test_long_lists_are_aligned_whole(monkeypatch):
    """A heading that moved from the end to the front of 100 paragraphs: the paragraphs match, not the heading alone."""
    a, b = (W.parse(f"<div>{x}</div>") for x in ("<h1>t</h1>" + "<p>x" * 100, "<p>x" * 100 + "<h1>t</h1>"))
    pairs = []
    assert W.match(a, b, pairs) == 2 + 2 * 100 and len(pairs) == 100
    import random
    draw = random.Random(7)
    some = lambda n: W.parse("".join(draw.choice(["<p>x</p>", "<p>x<div>y</div></p>", "<ul><li>z<li>w</ul>", "<h1>t</h1>", "<div><p>q</div>"]) for _ in range(n)))
    for _ in range(40):
        a, b, found = some(draw.randrange(30)), some(draw.randrange(30)), []
        for align, known, cells in ((64, 9999, 9999), (0, 9999, 9999), (0, 2, 3)):  # loops, arrays, arrays with little kept
            monkeypatch.setattr(W, "ALIGN", align), monkeypatch.setattr(W, "KNOWN", known), monkeypatch.setattr(W, "CELLS", cells)
            pairs = []
            found.append((W.match(a, b, pairs), [(id(p), id(q)) for p, q in pairs]))
        assert found[0] == found[1] == found[2]


def test_pages_awkward(spark):
    rows = [(1, None, None, "x"), (2, "http://h/", "", "x"), (3, None, "<p>a</p>", "x"), (None, "nonsense", "<p>b</p>", "x"), (5, "http://h/", "<p>" + "w " * 50_000, "x"), (5, "http://h/", "<p>q", "x")]
    got = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == 6 and {(r.page_id, r.text) for r in got if r.n_chars < 9} == {(1, ""), (2, ""), (3, "a"), (None, "b"), (5, "q")}
    assert W.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


HEAD = "WARC-Type: {}\r\nWARC-Target-URI: {}\r\nWARC-Date: 2024-01-0{}T00:00:00Z"


def record(i, kind, url, day, http="", body="", digest=None):
    return (i, HEAD.format(kind, url, day) + (f"\r\nWARC-Payload-Digest: {digest}" if digest else ""), http, body)


def resolved(spark, rows, **options):
    raw = spark.createDataFrame(rows, "record_id long, head string, http string, body string")
    return {r.record_id: r for r in C.resolve_revisits(C.parse_records(raw), **options).collect()}


def test_revisits(spark):
    etag = 'HTTP/1.1 200 OK\r\nETag: "a"\r\nContent-Type: text/html\r\nX: 1'
    rows = [record(1, "response", "http://www.H.example:80/p/?b=2&a=1&utm_source=z#f", 1, etag, "body", "d1"),
            record(2, "revisit", "https://h.example/p?a=1&b=2", 2, 'ETag: W/"a"\r\nContent-Type: none\r\nExpires: never'),
            record(3, "response", "http://h.example/p?a=1&b=2", 3, 'ETag: "b"', "other", "d2"),
            record(4, "revisit", "http://h.example/p?a=1&b=2", 4, 'ETag: "a"'),
            record(5, "revisit", "http://h.example/p?a=1&b=2", 5, "Date: x"),
            record(6, "revisit", "http://h.example/p?a=1&b=2", 5, "", "", "d2"),
            record(7, "revisit", "http://h.example/none", 5, 'ETag: "a"'),
            record(8, "revisit", "http://h.example/p?a=1&b=2", 1, 'ETag: "a"'),
            (9, None, None, None), (10, "WARC-Type: revisit", None, None)]
    for block_rows in (C.BLOCK_ROWS, 2):
        got = resolved(spark, rows, block_rows=block_rows)
        assert {i: (r.status, r.refers_to) for i, r in got.items()} == {
            1: ("response", None), 2: ("resolved", 1), 3: ("response", None), 4: ("mismatch", 3), 5: ("no_validator", 3), 6: ("resolved", 3), 7: ("no_response", None), 8: ("resolved", 1),
            9: (None, None), 10: ("no_response", None)}
        assert got[2].merged_headers == {"etag": 'W/"a"', "content-type": "text/html", "x": "1", "expires": "never"} and got[2].resolved_length == 4 and got[4].merged_headers is None


def test_time_blocks_change_nothing(spark):
    import random
    r = random.Random(8)
    rows = [record(i, r.choice(["response", "revisit"]), f"http://h/{r.randrange(3)}", r.randrange(1, 9), f'ETag: "{r.randrange(2)}"', "x" * i) for i in range(300)]
    want = resolved(spark, rows)
    assert resolved(spark, rows, block_rows=7) == want


def test_only_whole_responses_of_status_200_are_targets(spark):
    ok, url = 'HTTP/1.1 200 OK\r\nETag: "a"', "http://h.example/p"
    for i, other in enumerate(["HTTP/1.1 404 Not Found", 'HTTP/1.1 500 Oh\r\nETag: "b"', 'HTTP/1.1 206 Partial Content\r\nETag: "a"', 'HTTP/1.1 304 Not Modified\r\nETag: "a"']):
        rows = [record(1, "response", url, 1, ok, "whole body", "d1"), record(2, "response", url, 2, other, "part", f"x{i}"), record(3, "revisit", url, 3, 'ETag: "a"')]
        got = resolved(spark, rows)[3]
        assert (got.status, got.refers_to, got.resolved_length) == ("resolved", 1, 10)
    cut_off = (2, HEAD.format("response", url, 2) + "\r\nWARC-Truncated: length", ok, "who")
    assert resolved(spark, [rows[0], cut_off, rows[2]])[3].refers_to == 1


def test_time_blocks_of_a_burst_are_bounded(spark):
    rows = spark.range(1000).select(F.lit("h").alias("canonical"), F.when(F.col("id") == 0, 0).otherwise(10 ** 12 + F.col("id")).alias("micros"))
    blocked, large = C.with_blocks(rows, 100)
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert large and sum(sizes) == 1000 and max(sizes) <= 110


def test_no_records(spark):
    raw = spark.createDataFrame([], "record_id long, head string, http string, body string")
    assert C.resolve_revisits(C.parse_records(raw)).count() == 0


def test_records_of_pages_against_sql(spark):
    rows = [(i, f"http://{'www.' if i % 3 else ''}h{i % 4}.example/{i % 5}{'?ref=1&b=2' if i % 2 else '#x'}", None if i == 7 else f"<p>{i % 6}") for i in range(60)] + [(61, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = C.resolve_revisits(C.parse_records(C.records_of_pages(pages))).withColumn("merged", C.header_lines(F.col("merged_headers"))).drop("merged_headers")
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "int64"}))
    want = con.sql(C.ORACLE)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
