from datetime import datetime

import numpy as np
import pytest

from textquarry.llm.pages import Page, host_of, main_body, pack, parse, plain, unpack

SCHEMA = "page_id bigint, url string, html string, status_code int, links array<string>, depth int, metadata map<string,string>, fetched_at timestamp, ingested_at timestamp, host string, known int"
T = datetime(2025, 1, 1)


def crawl(spark, rows):
    return spark.createDataFrame([(i, u, h, 200, None, 0, None, T, T, "clash", 1) for i, u, h in rows], SCHEMA)


def body(spark, rows):
    out = {}
    for r in main_body(crawl(spark, rows)).collect():
        out.setdefault(r.page_id, set()).add(r.block)
    return out


def page(k, site):
    main = f"<h1>Head {site} {k}</h1><P>Own text number {k} of {site} is told here with words. <b>Bold</b> part<br>goes on.<P>Second paragraph {k} {site} says other things.<ul><li>Point {k} {site}</li></ul>"
    return (
        f"<!DOCTYPE html><html><head><title>x</title><script>var a='<p>no</p>';</script></head><body><!-- <p>old</p> --><div class=nav1><a href=/a>Home</a> | <a href=/b>Shop</a> | <a href=/c>Press</a></div>"
        f"<div id=content>{main}<p class=ad>Subscribe to our letter now.</p></div>"
        f"<div class=side><h3>Most read</h3><ul><li><a href=/x{k}>Other story {k} of {site}</a></li></ul><p>Teaser {k} {site} with many words to read on. <a href=/y>Read more</a></p></div>"
        f"<div id=comments><h3>{k} comments</h3><div class=c><b>joe{k}</b><p>Not so sure about number {k} {site} at all.</p></div></div>"
        f"<div class=foot><p>All rights reserved.</p><p>Made in {site}.</p></div></body></html>"
    )


def error(site):
    return f"<html><body><div class=nav1><a href=/a>Home</a> | <a href=/b>Shop</a> | <a href=/c>Press</a></div><div id=content><h1>Page not found</h1><p>Try again later please.</p></div><div class=foot><p>All rights reserved.</p></div></body></html>"


def test_consensus(spark):
    rows, k = [], 0
    for site in ("alpha", "beta", "gamma", "delta"):
        for _ in range(8):
            k += 1
            rows.append((k, f"https://{site}.example/p/{k}", page(k, site)))
        k += 1
        rows.append((k, f"https://{site}.example/p/{k}", error(site)))
    got = body(spark, rows)
    for i, url, html in rows:
        if "not found" in html:
            assert i not in got
        else:
            site = host_of(url).split(".")[0]
            assert got[i] == {
                plain(f"Head {site} {i}"), plain(f"Own text number {i} of {site} is told here with words. Bold part goes on."),
                plain(f"Second paragraph {i} {site} says other things."), plain(f"Point {i} {site}"),
            }


def test_dirty_rows(spark):
    rows = [(1, "https://a.example/1", page(1, "a")), (1, "https://a.example/1", page(1, "a")), (2, None, None), (3, "https://a.example/3", ""), (4, "::", " \n"), (None, "https://a.example/5", page(5, "a")), (6, None, page(6, "b")),
            (7, "https://a.example/7", "<p>" + "long text " * 40_000 + "</p>"), (8, "https://a.example/8", "no mark-up at all, just some words")]
    got = body(spark, rows)
    assert plain("Own text number 1 of a is told here with words. Bold part goes on.") in got[1]
    assert {2, 3, 4}.isdisjoint(got) and 6 in got and 8 in got and len(next(iter(got[7])).split()) == 80_000
    assert body(spark, []) == {}


def test_blocks():
    nodes, blocks = parse("<div>a<p>b <i>c</i><br>d<ul><li>e<li>f</ul>g<table><tr><td>h<td>i</table><noscript><p>no</p></noscript>&amp;j")
    assert [b[1] for b in blocks] == ["a", "b c d", "e", "f", "g", "h", "i", "j"]
    assert [nodes[b[0]][1] for b in blocks[-3:-1]] == ["td[0]", "td[1]"]
    assert Page(nodes, blocks, set()).paths[blocks[2][0]] == "/div/ul/li"


@pytest.mark.parametrize("source", ["", "<", "<<<>>>", "</div></p>", "<p", "<!--", "<script>x", "<table><td><tr></table></td>", "<a href='>x"])
def test_careless_markup_does_not_fail(source):
    parse(source)


def test_host():
    assert [host_of(u) for u in ("https://WWW.A.example:80/x", None, "nonsense", "http://[bad")] == ["a.example", "", "", ""]


def test_hosts_joined_instead_of_sent(spark):
    rows = [(k, f"https://{s}.example/p/{k}", page(k, s)) for k, s in enumerate(("alpha", "beta", "gamma") * 6, 1)]
    sent = {tuple(r) for r in main_body(crawl(spark, rows)).collect()}
    assert sent and {tuple(r) for r in main_body(crawl(spark, rows), most_told=0).collect()} == sent


def test_a_quotation_on_many_hosts_is_no_furniture(spark):
    quote = "Whoever keeps the lamp burning will see the ship come home before the winter ends."
    rows = []
    for n in range(30):
        for k in range(4):
            said = f"<p>Words of its own {n} {k} stand here in this place.</p><p>Some more is told {k} of {n} below it.</p>" + (f"<p>{quote}</p>" if k == 0 else f"<p>Then a last line {n} {k} follows here.</p>")
            rows.append((10 * n + k, f"https://h{n}.example/{k}", f"<body><div class=nav><a href=/>Home</a></div><div class=text><h1>Title {n} {k}</h1>{said}</div><div class=foot><p>All rights reserved here.</p></div></body>"))
    got = body(spark, rows)
    assert all(plain(quote) in got[10 * n] for n in range(30))
    assert not any(plain("All rights reserved here.") in b for b in got.values())


def test_every_class_and_id_counts():
    nodes, _ = parse("<div class='b a box-1234' id=Main>x<p>y</p></div><div id=main class='box- a b'>z</div>")
    assert nodes[1][1] == nodes[3][1] == "div#main.a.b.box-"
    nodes, blocks = parse("<div class='col wide cookie-notice'><p>We set some files on your device.</p></div><div class='col wide text'><p>This is the text of the page.</p></div>")
    assert list(Page(nodes, blocks, set()).scores()) == [3]


def test_packed_pages_come_back():
    pages = [parse(page(k, "a")) for k in range(3)]
    before = [([list(n) for n in nodes], [list(b) for b in blocks]) for nodes, blocks in pages]
    packed, hashes, ends = pack(iter(pages))
    assert sum(ends) == len(hashes)
    assert list(unpack(packed, np.array(hashes, np.int64).tobytes())) == before
