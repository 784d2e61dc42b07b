"""The site engine on small hand-built sites."""

import pytest
from hypothesis import given, strategies as st

from siteweave import rules
from siteweave.functions import text as text_functions
from siteweave.functions.url import canonicalise
from siteweave.operators.checks import CHECKS
from siteweave.operators.context import NODE_SCHEMA, PAGE_SCHEMA, VALUE_SCHEMA, Context
from siteweave.plans import catalogue, engine
from siteweave.sources import html, jsonld, robots

URLS = [
    ("case", "HTTP://Example.COM/Path", "http://example.com/Path"), ("port", "https://e.test:443/", "https://e.test/"), ("other port", "http://e.test:8080/", "http://e.test:8080/"), ("dots", "http://e.test/a/./b/../c", "http://e.test/a/c"),
    ("root", "http://e.test", "http://e.test/"), ("unreserved", "http://e.test/%7Ea%2f", "http://e.test/~a%2F"), ("malformed", "http://e.test/%zz", "http://e.test/%zz"), ("fragment", "http://e.test/#x", "http://e.test/"),
    ("tracking", "http://e.test/?utm_a=1&b=2&gclid=3&a=1", "http://e.test/?a=1&b=2"), ("repeat", "http://e.test/?b=2&b=1", "http://e.test/?b=2&b=1"), ("credentials", "http://u:p@e.test/", "http://e.test/"), ("idn", "http://bücher.test/", "http://xn--bcher-kva.test/"),
]


@pytest.mark.parametrize(("name", "given_", "want"), URLS)
def test_canonicalise(name, given_, want):
    assert canonicalise(given_) == want == canonicalise(want)


@given(st.text(alphabet="ab/?&=%2E.:#", max_size=30))
def test_canonicalise_is_idempotent(tail):
    c = canonicalise("http://e.test/" + tail)
    assert c is None or canonicalise(c) == c


def test_rules():
    rules.validate()
    assert len(CHECKS) >= 55 and {n.partition(".")[0] for n in CHECKS} == set(rules.GROUPS)
    with pytest.raises(ValueError, match="entity.contradiction"):
        engine.selected(("entity.contradictoin",))


def site(spark, values, pages=6, **more):
    """Pages p0.. and node values ``(page, node, prop, kind, text)`` of Organizations, or of types given by ``types``."""
    types = more.pop("types", {})
    page = [{"site": "s", "page_id": f"p{i}", "ord": i, "url": f"https://s.test/p{i}", "canonical_url": f"https://s.test/p{i}", "source": "sitemap", "http_status": 200, "nodes": 1} for i in range(pages)]
    nodes = [("s", p, int(p[1:]), k, n, None, n.startswith("_:"), [rules_type]) for k, (p, n) in enumerate(sorted({(v[0], v[1]) for v in values})) for rules_type in [f"https://schema.org/{types.get(n, 'Organization')}"]]
    at = {(n[1], n[4]): n[3] for n in nodes}
    rows = [("s", p, int(p[1:]), at[p, n], n, f"https://schema.org/{prop}", i, kind, text) for i, (p, n, prop, kind, text) in enumerate(values)]
    return Context(spark, spark.createDataFrame(page, PAGE_SCHEMA), spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(rows, VALUE_SCHEMA), **more)


def keys(ctx, name):
    return {r.key for r in CHECKS[name][1](ctx).collect()}


def test_contradiction_and_silence(spark):
    org = "https://s.test/#org"
    same = [(f"p{i}", org, "telephone", "literal", "1") for i in range(3)]
    assert keys(site(spark, same), "entity.contradiction") == set()
    assert keys(site(spark, [*same, ("p3", org, "telephone", "literal", "2")]), "entity.contradiction") == {f"{org}|https://schema.org/telephone"}
    assert keys(site(spark, [*same, ("p3", org, "sameAs", "id", "x:y")]), "entity.contradiction") == set()
    scoped = site(spark, [(f"p{i}", org, "url", "id", f"https://s.test/{i}") for i in range(6)])
    assert keys(scoped, "entity.page-scoped-value") == {f"{org}|https://schema.org/url"} and keys(scoped, "entity.contradiction") == set()


def test_blank_values_are_compared_by_content(spark):
    org, values = "https://s.test/#org", []
    for i in range(2):
        values += [(f"p{i}", org, "address", "id", f"_:p{i}/a"), (f"p{i}", f"_:p{i}/a", "streetAddress", "literal", "Street 1")]
    assert keys(site(spark, values), "entity.contradiction") == set()
    values[-1] = ("p1", "_:p1/a", "streetAddress", "literal", "Street 2")
    assert keys(site(spark, values), "entity.contradiction") == {f"{org}|https://schema.org/address"}


def test_graph_and_rich_results(spark):
    ctx = site(spark, [("p0", "https://s.test/#p", "isPartOf", "id", "https://s.test/#gone"), ("p0", "https://s.test/#p", "name", "literal", "Jane Doe")], types={"https://s.test/#p": "Product"})
    assert keys(ctx, "graph.dangling-reference") == {"https://s.test/#gone"}
    assert keys(ctx, "google.incomplete-alternative") == {"Product|offers|review|aggregateRating"}
    assert keys(ctx, "value.placeholder") == {"https://schema.org/name|jane doe"}


def test_all_checks_run(spark):
    ctx = site(spark, [("p0", "https://s.test/#o", "name", "literal", " ")])
    assert all(f(ctx).columns == ["site", "key", "subject", "property", "value", "page_id", "pattern"] for _, f in CHECKS.values())
    found = engine.run_checks(ctx, tuple(g for g in rules.GROUPS if g not in ("value", "page")))
    assert "value.empty" in {r.check for r in found.select("check").collect()}


def test_html_facts_and_links():
    page = '<html lang=en><title> T </title><body><nav><a href="/n">Nav</a></nav><article><h1>H</h1><p>one two three four <a href="b?x#y">link</a><p hidden>gone</article><img src=a alt="IMG_1234.jpg"><img><script type="application/ld+json">{"@context":"https://schema.org"}</script>'
    rows = html.extract("p", "https://s.test/a/", page)
    assert [r["kind"] for r in rows].count("link") == 2 and [r["kind"] for r in rows].count("ld") == 1
    facts = next(r["payload"] for r in rows if r["kind"] == "facts")
    assert '"title": "T"' in facts and '"missing_alt": 1' in facts and "IMG_1234" in facts and '"html_lang": "en"' in facts


def test_jsonld():
    nodes, error = jsonld.expand("p", "https://s.test/a", 0, '{"@context":"https://schema.org","@type":"Organization","@id":"#o","name":"N","address":{"@type":"PostalAddress","streetAddress":"S"}}')
    assert error is None and {n["node_id"] for n in nodes} == {"https://s.test/a#o", "_:p/json-ld/0/address"} and nodes[0]["raw_id"] == "#o"
    assert jsonld.expand("p", "u", 1, '{"a":1,}')[1] == "ld-block-1: the block has a trailing comma"
    assert "refused" in jsonld.expand("p", "u", 2, '{"@context":"https://other.test/"}')[1]


def test_robots_and_sitemaps():
    r = robots.parse_robots("User-agent: GPTBot\nUser-agent: x\nDisallow: /\n\nUser-agent: *\nAllow: /a/b\nDisallow: /a\nDisallow:\nSitemap: https://s.test/m.xml")
    assert r["groups"][0] == {"agents": ["gptbot", "x"], "allow": [], "disallow": ["/"]} and r["sitemaps"] == ["https://s.test/m.xml"]
    assert robots.allowed(r, "other", "/a/b/c") and not robots.allowed(r, "other", "/a/c") and robots.parse_robots(None) is None
    assert robots.parse_sitemap(b'<urlset xmlns="x"><url><loc>https://s.test/</loc></url></urlset>')["urls"] == ["https://s.test/"]
    assert robots.parse_sitemap(b"<!doctype html>")["error"] == "an HTML page" and robots.parse_sitemap(b"<urlset>")["error"].startswith("malformed")


def test_simhash(spark):
    row = spark.createDataFrame([("a b c d",), ("",), ("a b c d",)], "t string").select(text_functions.simhash(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("h")).collect()
    assert row[0].h == row[2].h and len(row[0].h) == 16 and row[1].h == "0" * 16


def test_entry_names():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("n", [2, 8, 11])
def test_breadcrumb_loops_of_any_length(spark, n):
    """Page k's trail names k - 1 as its parent, around a loop; a tail of twenty pages leads into it, another chain to a root."""
    u = lambda k: f"https://s.test/u{k:02}"
    pairs = [(u((k - 1) % n), u(k)) for k in range(n)] + [(u(40 + k - 1) if k else u(0), u(40 + k)) for k in range(20)] + [(u(70 + k), u(71 + k)) for k in range(10)]
    values, types = [], {}
    for k, (parent, child) in enumerate(pairs):
        types |= {f"_:b{k}": "BreadcrumbList", f"_:x{k}": "ListItem", f"_:y{k}": "ListItem"}
        for at, (item, url) in enumerate([(f"_:x{k}", parent), (f"_:y{k}", child)]):
            values += [(f"p{k}", f"_:b{k}", "itemListElement", "id", item), (f"p{k}", item, "position", "literal", str(at + 1)), (f"p{k}", item, "item", "id", url)]
    got = keys(site(spark, values, pages=len(pairs), types=types), "breadcrumb.cycle")
    assert got == {" > ".join(u(k) for k in range(n))}


def test_pairs_of_identity_fracture_are_made_once_and_not_shuffled(spark):
    """Against brute force: shared names and links, more than ``few`` links, groups of more than one cell, types that clash."""
    from pyspark.sql import functions as F

    from siteweave.operators.checks import fracture_pairs

    values, types = [], {}
    for i in range(40):
        node, page = f"https://s.test/#n{i:02}", f"p{i % 6}"
        types[node] = ("Organization", "LocalBusiness", "Event")[i % 3]
        values += [(page, node, "name", "literal", f" Name {i % 4}"), (page, node, "name", "literal", f"Other {i % 5}")] + [(page, node, "sameAs", "id", f"https://x.test/{(i + k) % 8}") for k in range(1 + i % 5)]
    of = lambda prop: {n: {v[4].strip().lower() for v in values if v[1] == n and v[2] == prop} for n in types}
    named, linked, up = of("name"), of("sameAs"), {n: set(rules.ancestors(t)) for n, t in types.items()}
    want = sorted((x, y, name) for x in types for y in types if x < y and linked[x] & linked[y] and (up[x] <= up[y] or up[y] <= up[x]) for name in named[x] & named[y])
    ctx = site(spark, values, types=types)
    for few, cell in ((64, 4096), (3, 4), (1, 2)):
        assert sorted((r.x, r.y, r.name) for r in fracture_pairs(ctx, few, cell).collect()) == want
    pairs = catalogue.QUERIES["graph_identity_fracture_part"](spark, "/root/testdata/sf0.001")
    pairs.agg(F.count("*")).collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    # Above the join that makes pairs of links seen once, nothing is exchanged.
    first = min(k for k, line in enumerate(plan.splitlines()) if "Join" in line)
    assert not any("Exchange" in line for line in plan.splitlines()[:first])


def test_link_hop_deals_links_to_tasks_of_bounded_rows(spark):
    """A page that all link to, repeats, a page without address, outside links, assets and known pages; the same in one task and in many."""
    from siteweave.operators import crawl

    u = "https://s.test/"
    rows = [("s", f"p{k}", u + "home", True) for k in range(300)] * 2 + [("s", f"p{k % 7}", f"{u}{k % 40}", True) for k in range(400)] + [("s", None, u + "alone", True), ("s", "p1", "https://o.test/", False), ("s", "p1", u + "a.css", True)]
    links = spark.createDataFrame(rows, "site string, from_page string, to_url string, internal boolean")
    known = spark.createDataFrame([("s", u + "3")], "site string, url string")
    seen = {}
    for _, page, to, internal in rows:
        if internal and to not in (u + "3", u + "a.css"):
            seen.setdefault(to, set()).update({page} - {None})
    want = [(to, len(p), k + 1) for k, (to, p) in enumerate(sorted(seen.items(), key=lambda x: (-len(x[1]), x[0])))]
    for most, many in ((1 << 20, False), (50, True)):
        got = crawl.link_hop(links, known, task_rows=most)
        assert sorted(((r.to_url, r.pages, r["rank"]) for r in got.collect()), key=lambda x: x[2]) == want
        assert ("REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()) == many


def test_verdicts_dealt_to_tasks_of_bounded_rows(spark):
    """Observations of one entity by many pages, with a text that is common to all: verdicts and findings do not depend on the dealing."""
    org = "https://s.test/#o"
    values = [(f"p{i % 9}", f"{org}{i % 5}", "telephone", "literal", str(i % 2 if i % 5 else 1)) for i in range(45)] + [(f"p{i}", f"{org}0", "keywords", "literal", "x") for i in range(9)]
    values += [("p1", f"{org}1", "address", "id", "_:p1/a"), ("p1", "_:p1/a", "streetAddress", "literal", "S"), ("p2", f"{org}1", "address", "id", "_:none"), ("p3", f"{org}2", "url", "id", "_:p1/a")]
    from siteweave.operators import checks

    found = []
    for most in (1 << 20, 4):
        ctx = site(spark, values, pages=9, task_rows=most)
        assert bool(ctx.tasks) == (most == 4)
        each = checks.contradictions(ctx)
        found.append((sorted(map(str, each.select(*sorted(each.columns)).collect())), sorted((r.node_id, r.prop, r.verdict, r.n_buckets, r.n_carriers, r.n_obs) for r in checks.verdicts(ctx).collect())))
        assert sorted((r.node_id, r.verdict) for r in checks.verdicts(ctx, "https://schema.org/telephone").collect()) == [(f"{org}0", "consistent"), *((f"{org}{k}", "contradiction") for k in range(1, 5))]
        # Only texts that may name a blank node are joined by text.
        plan = ctx.values._jdf.queryExecution().optimizedPlan().toString()
        assert "StartsWith(text" in plan
    assert found[0] == found[1] and len(found[0][0]) == 45 + 9 + 3


def test_page_scoped_verdict_of_dealt_values(spark):
    """An address for each page of one entity: page-scoped, in one task and in many, and no page's observation is lost."""
    from siteweave.operators import checks

    for most in (1 << 20, 2):
        ctx = site(spark, [(f"p{i}", "https://s.test/#o", "url", "id", f"https://s.test/{i}") for i in range(30)], pages=30, task_rows=most)
        assert [(r.verdict, r.n_buckets, r.n_carriers, r.n_obs) for r in checks.verdicts(ctx, "https://schema.org/url").collect()] == [("page-scoped", 30, 30, 30)]
