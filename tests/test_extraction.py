"""From stored HTML to findings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siteweave.functions.text import simhash
from siteweave.plans import engine, extraction

MENU = '<nav><ul><li><a href="/">Home page of ours</a></ul></nav>'
LD = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","@id":"https://s.test/#o","name":"Untitled"}</script>'
PAGE = "site string, page_id string, ord long, url string, html string"


def page(k, body):
    return ("s.test", f"p{k}", k, f"https://s.test/{k}", f"<html lang=en><title>Page {k}</title><body>{MENU}<p>This line is on every page</p>{body}")


@pytest.fixture(scope="module")
def extracted(spark):
    pages = [page(k, f"<main><h2>Heading</h2><p>text {'word ' * k}</p><li>item</li><p hidden>three hidden words</p></main>{LD}") for k in range(5)]
    pages += [("s.test", "null", 5, "https://s.test/null", None), ("t.test", "p0", 0, "https://t.test/", "<h1>Own</h1><p>This line is on every page</p><script type='application/ld+json'>{,}</script>")]
    return extraction.extract_site(spark.createDataFrame(pages, PAGE))


def test_facts_without_furniture(extracted):
    got = {(r.site, r.page_id): r for r in extracted.pages.collect()}
    assert len(got) == 7
    for k in range(5):
        r = got["s.test", f"p{k}"]
        # Heading, own text and item; neither the menu nor the line of every page ("Heading" is one, but headings always count).
        assert (r.facts.extractable_words, r.facts.hidden_words, r.nodes, r.errors) == (1 + 1 + k, 0, 1, [])
    alone = got["t.test", "p0"]
    assert alone.facts.extractable_words == 7 and len(alone.errors) == 1 and alone.content_md == "# Own\n\nThis line is on every page\n"
    none = got["s.test", "null"]
    assert none.facts is None and none.content_md is None and none.content_simhash is None


def test_links_of_every_page_are_chrome(extracted):
    assert {(r.to, r.in_chrome) for r in extracted.links.collect()} == {("https://s.test/", True)}


def test_markdown_of_content(extracted):
    md = {r.page_id: r.content_md for r in extracted.pages.where("site = 's.test'").collect()}
    assert md["p2"] == "# Page 2\n\n## Heading\n\ntext word word\n"


def test_findings_from_html(extracted):
    found = engine.run_checks(extracted.context(), ("entity", "graph", "breadcrumb", "google", "robots", "indexing", "link", "coverage", "content", "url"))
    got = {(r.site, r.check) for r in found.collect()}
    assert ("s.test", "value.placeholder") in got and ("t.test", "syntax.malformed-json") in got and ("t.test", "page.title-missing") in got
    assert not any(site == "s.test" and check == "page.title-missing" for site, check in got)


def test_empty_table(spark):
    e = extraction.extract_site(spark.createDataFrame([], PAGE))
    assert e.pages.count() == e.nodes.count() == e.links.count() == 0


def test_simhash_against_brute_force(spark):
    def brute(text):
        w = text.lower().split()
        votes = [0] * 64
        for s in [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []:
            d = int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big")
            votes = [v + (1 if d >> (63 - b) & 1 else -1) for b, v in enumerate(votes)]
        return f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):016x}"

    texts = ["", "a", "a b c d", "A b c A b c A b c", " ".join(str(i % 37) for i in range(500))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", simhash(F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == [*map(brute, texts), None]


def test_slices_bound_what_a_worker_holds():
    """Many small pages and one that is over the bound: every row once and in order, no piece over the bound but by one row."""
    import pyarrow as pa

    from siteweave.sources.html import slices

    rows = [None, "", *["x" * 300] * 50, "y" * 5000, *["ä" * 100] * 20, None]
    pieces = list(slices(pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["k", "html"]), "html", 1000))
    assert [k for p in pieces for k in p.column("k").to_pylist()] == list(range(len(rows)))
    bytes_of = lambda p: sum(len((h or "").encode()) for h in p.column("html").to_pylist())
    assert all(bytes_of(p) <= 1000 or p.num_rows == 1 for p in pieces) and len(pieces) < 25
    assert list(slices(pieces[0].slice(0, 0), "html")) == []


def test_a_parsed_page_needs_no_garbage_collector():
    """Trees of pages used to refer to themselves, so a worker kept them until a full collection."""
    import gc

    from siteweave.sources import html

    gc.collect()
    gc.disable()
    try:
        for k in range(20):
            html.extract("p", "https://s.test/", page(k, "<div><p>a<p>b<ul><li>c</ul></div>" * 20)[4])
        assert sum(isinstance(x, (html.Node, html.Tree)) for x in gc.get_objects()) == 0
    finally:
        gc.enable()


def test_only_what_is_read_is_made(spark):
    """Links and words once made every page's fingerprint, Markdown, nodes and values too."""
    rows = [page(k, f"<main><p>text {'word ' * k}</p><p hidden>three hidden words</p></main>{LD}") for k in range(5)] + [("s.test", "null", 5, "https://s.test/null", None), ("s.test", "bare", 6, "https://s.test/bare", "<i>x</i>")]
    e = extraction.extract_site(spark.createDataFrame(rows, PAGE))
    words = {r.page_id: (r.extractable_words, r.hidden_words) for r in e.words.collect()}
    assert {r.to for r in e.links.collect()} == {"https://s.test/"}
    assert not {"pages", "_pages", "_long", "nodes", "values"} & set(vars(e))
    assert words == {r.page_id: (r.facts.extractable_words, r.facts.hidden_words) if r.facts else (None, None) for r in e.pages.collect()}
    assert words["null"] == (None, None) and words["bare"] == (0, 0) and words["p4"][0] == 5
