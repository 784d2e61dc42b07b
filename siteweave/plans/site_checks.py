"""One query for each check over a site made from ``customer``: a page and a node per row, each property by arithmetic on its key.

The SQL states what a check is to find from the same arithmetic, without the engine's relations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.checks import CHECKS
from ..operators.context import LINK_SCHEMA, NODE_SCHEMA, PAGE_SCHEMA, VALUE_SCHEMA, Context
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PAGES = """SELECT 's' AS site, concat('p', k) AS page_id, k AS ord, url, url AS canonical_url,
  CASE WHEN k % 11 = 0 THEN concat('https://site.test/s', (k + 1) % 7, '/i', k + 1) WHEN k % 13 = 0 THEN 'https://other.test/x' END AS declared_canonical,
  CASE WHEN k % 9 = 0 THEN 'link-hop:x' WHEN k % 4 = 0 THEN 'input' ELSE 'sitemap:a' END AS source, CAST(CASE WHEN k % 17 = 0 THEN 404 ELSE 200 END AS INT) AS http_status,
  transform(CASE WHEN k % 19 = 0 THEN array(1, 2) WHEN k % 19 = 1 THEN array(1) ELSE CAST(array() AS ARRAY<INT>) END, x -> named_struct('url', url, 'status', 301, 'location', url)) AS redirect_chain,
  CAST(array() AS ARRAY<STRUCT<url: STRING, source: STRING, http_status: INT, redirect_chain: ARRAY<STRUCT<url: STRING, status: INT, location: STRING>>>>) AS aliases,
  concat('sha', floor(k / 3)) AS content_sha256, CASE WHEN k % 2 = 0 THEN 60000L ELSE 1000L END AS bytes, CASE WHEN k % 43 = 0 THEN 0 ELSE 1 END AS nodes,
  CASE WHEN k % 47 = 0 THEN 2 ELSE 0 END AS microdata_items, CASE WHEN k % 47 = 0 THEN array('https://schema.org/Person') ELSE CAST(array() AS ARRAY<STRING>) END AS microdata_types,
  CASE WHEN k % 53 = 0 THEN array('ld-block-0: the block is not JSON') WHEN k % 59 = 0 THEN array('ld-block-1: remote context refused: https://ctx.test/c') ELSE CAST(array() AS ARRAY<STRING>) END AS errors,
  named_struct('title', CASE WHEN k % 23 = 0 THEN NULL ELSE concat('T', k % 100) END, 'meta_description', '', 'heading_levels', CASE k % 5 WHEN 0 THEN array(2) WHEN 1 THEN array(1, 1) ELSE array(1, 2) END,
    'noindex', k % 5 = 0, 'html_lang', CASE WHEN k % 29 = 0 THEN NULL ELSE 'en' END, 'has_main', k % 3 = 0, 'has_article', k % 10 = 0, 'images', 3, 'missing_alt', CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END,
    'suspect_alt', CASE WHEN k % 37 = 0 THEN array('img') ELSE CAST(array() AS ARRAY<STRING>) END, 'dom_words', CASE WHEN k % 41 = 0 THEN 50 ELSE 500 END,
    'main_words', CAST(k % 100 AS INT), 'aside_words', CAST(k * 7 % 150 AS INT), 'extractable_words', CAST(k * 3 % 120 AS INT), 'hidden_words', CAST(k * 11 % 130 AS INT)) AS facts
FROM (SELECT c_custkey AS k, concat('https://site.test/s', c_custkey % 7, '/i', c_custkey) AS url FROM {c})"""
NODES = """SELECT 's' AS site, concat('p', k) AS page_id, k AS page_ord, 0 AS node_ord, CASE WHEN k % 7 = 0 THEN concat('_:p', k) ELSE concat('https://site.test/#e', floor(k / 2)) END AS node_id,
  CASE WHEN k % 61 = 0 THEN '#n' END AS raw_id, k % 7 = 0 AS is_blank, array(concat('https://schema.org/', element_at(array('Offer', 'Organization', 'LocalBusiness', 'Product', 'WebPage'), CAST(k % 5 + 1 AS INT)))) AS types FROM (SELECT c_custkey AS k FROM {c})"""
VALUES = """SELECT n.site, n.page_id, n.page_ord, n.node_ord, n.node_id, concat('https://schema.org/', v.prop) AS prop, v.val_ord, v.kind, v.text FROM ({n}) n
LATERAL VIEW explode(filter(array(named_struct('prop', 'name', 'val_ord', 0, 'kind', 'literal', 'text', concat('n', page_ord % 50)),
  CASE WHEN page_ord % 8 = 0 THEN named_struct('prop', 'url', 'val_ord', 0, 'kind', 'id', 'text', concat('http://site.test/x', page_ord)) END,
  CASE WHEN page_ord % 10 = 0 THEN named_struct('prop', 'image', 'val_ord', 0, 'kind', 'id', 'text', concat('https://img', page_ord % 3, '.other.test/i')) WHEN page_ord % 10 = 1 THEN named_struct('prop', 'image', 'val_ord', 0, 'kind', 'id', 'text', 'https://i0.wp.com/z') END,
  CASE WHEN page_ord % 12 = 0 THEN named_struct('prop', 'telephone', 'val_ord', 0, 'kind', 'literal', 'text', 'a') END, CASE WHEN page_ord % 12 = 0 THEN named_struct('prop', 'telephone', 'val_ord', 1, 'kind', 'literal', 'text', 'b') END), x -> x IS NOT NULL)) t AS v"""
#: DuckDB's view of the same pages (those of the audited sample are ``p``) and nodes.
SQL = """WITH a AS (SELECT c_custkey AS k, 'p' || c_custkey AS page_id, 'https://site.test/s' || (c_custkey % 7) || '/i' || c_custkey AS url, c_custkey % 4 <> 0 AS mapped, c_custkey % 17 <> 0 AS ok, c_custkey * 3 % 120 AS words FROM customer),
p AS (SELECT * FROM a WHERE k % 9 <> 0), f AS (SELECT * FROM p WHERE ok),
n AS (SELECT k, page_id, CASE WHEN k % 7 = 0 THEN '_:p' || k ELSE 'https://site.test/#e' || (k // 2) END AS node_id, ['Offer', 'Organization', 'LocalBusiness', 'Product', 'WebPage'][k % 5 + 1] AS t FROM p),
l AS (SELECT node_id, max(k) AS k, arg_max(t, k) AS t FROM n GROUP BY node_id)
"""


def site(spark: SparkSession, sf_dir: str) -> Context:
    customer = prepare(spark).read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    made = lambda text, schema: spark.sql(text, c=customer).to(spark.createDataFrame([], schema).schema)
    nodes = made(NODES, NODE_SCHEMA)
    values = spark.sql(VALUES.replace("({n})", "{n}"), n=nodes).to(spark.createDataFrame([], VALUE_SCHEMA).schema)
    links = customer.where("c_custkey % 3 <> 0").select(F.lit("s").alias("site"), F.concat(F.lit("p"), "c_custkey").alias("from_page"), F.expr("concat('https://site.test/s', (c_custkey + 1) % 7, '/i', c_custkey + 1)").alias("to_url"), F.expr("c_custkey % 8 <> 0").alias("internal"))
    repeats = customer.where("c_custkey % 5 < 2").select(F.lit("s").alias("site"), F.expr("concat('u', c_custkey)").alias("url"), F.expr("if(c_custkey % 5 = 0, 'a', 'b')").alias("from_sitemap"), F.lit("a").alias("first_sitemap"))
    robots = customer.selectExpr("concat('s', c_custkey) AS site", "array(if(c_custkey % 2 = 0, 'gptbot', '*')) AS agents", "if(c_custkey % 6 < 2, array('/wp'), cast(array() AS array<string>)) AS allow", "if(c_custkey % 2 = 0, array('/', '/x'), array('/wp-includes/', '/theme/a.css$', '/x/')) AS disallow", "if(c_custkey % 5 = 0, cast(array() AS array<string>), array('m')) AS sitemaps", "1 AS sitemaps_found")
    return Context(spark, made(PAGES, PAGE_SCHEMA), nodes, values, links.to(spark.createDataFrame([], LINK_SCHEMA).schema), robots, repeats)


def check(name: str, sql: str, *columns: str) -> None:
    """Register the check's distinct observations, as ``columns`` (of an observation row), against ``sql`` over ``SQL``."""
    own = columns or ("page_id", "value")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return CHECKS[name][1](site(spark, sf_dir)).select(*own).distinct()

    key = "check_" + name.replace(".", "_").replace("-", "_")
    query.__name__ = key
    QUERIES[key], ORACLES[key] = query, f"{SQL} SELECT DISTINCT * FROM ({sql})"


def fact(name: str, where: str) -> None:
    check(name, f"SELECT page_id, url AS value FROM f WHERE {where}")


fact("page.title-missing", "k % 23 = 0")
fact("page.h1-missing", "k % 5 = 0")
fact("page.h1-multiple", "k % 5 = 1")
fact("page.lang-missing", "k % 29 = 0")
fact("page.image-alt-missing", "k % 31 = 0")
fact("content.not-extractable", "(k % 3 = 0 OR k % 10 = 0) AND words >= 50 AND k % 100 < 0.2 * words")
fact("content.javascript-only", "k % 41 = 0 AND k % 2 = 0")
fact("content.main-in-aside", "k * 7 % 150 >= 50 AND words >= 50 AND k * 7 % 150 > k % 100")
fact("content.hidden-text", "k * 11 % 130 >= 50 AND words >= 50 AND k * 11 % 130 > words")
fact("content.no-landmark", "words >= 50 AND k % 3 <> 0 AND k % 10 <> 0")
fact("coverage.no-structured-data", "k % 43 = 0")
fact("indexing.thin-sitemap-entry", "mapped AND k % 19 > 1 AND words < 25")
fact("link.orphan", "false) UNION ALL (SELECT page_id, url FROM p WHERE mapped AND NOT (k > 1 AND (k - 1) % 3 <> 0 AND (k - 1) % 8 <> 0)")
fact("link.noindex-only-inbound", "false) UNION ALL (SELECT page_id, url FROM p WHERE mapped AND k % 5 <> 0 AND k > 1 AND (k - 1) % 3 <> 0 AND (k - 1) % 8 <> 0 AND (k - 1) % 5 = 0")
check("page.image-alt-useless", "SELECT page_id, 'img' AS value FROM f WHERE k % 37 = 0")
check("page.title-duplicate", "SELECT page_id, 'T' || (k % 100) AS value FROM f WHERE k % 23 <> 0 AND k % 100 IN (SELECT k % 100 FROM f WHERE k % 23 <> 0 GROUP BY 1 HAVING count(*) > 1)")
check("coverage.competing-syntax", "SELECT page_id, 'https://schema.org/Person' AS value FROM p WHERE k % 47 = 0")
check("syntax.malformed-json", "SELECT page_id, 'the block is not JSON' AS value FROM p WHERE k % 53 = 0")
check("syntax.unresolvable-context", "SELECT page_id, 'https://ctx.test/c' AS value FROM p WHERE k % 59 = 0 AND k % 53 <> 0")
check("indexing.sitemap-dead-url", "SELECT page_id, url AS value FROM p WHERE mapped AND NOT ok")
check("indexing.sitemap-redirects", "SELECT page_id, url AS value FROM p WHERE mapped AND k % 19 <= 1")
check("indexing.redirect-chain", "SELECT page_id, url AS value FROM p WHERE k % 19 = 0")
check("indexing.sitemap-duplicate-url", "SELECT 'a' AS subject, 'u' || k AS value FROM a WHERE k % 5 = 0", "subject", "value")
check("indexing.canonical-to-redirect", "SELECT x.page_id, y.url AS value FROM p x JOIN p y ON y.k = x.k + 1 WHERE x.k % 11 = 0 AND y.k % 19 <= 1")
check("indexing.canonical-chain", "SELECT x.page_id, x.url || ' > ' || y.url || ' > https://other.test/x' AS value FROM p x JOIN p y ON y.k = x.k + 1 WHERE x.k % 11 = 0 AND y.k % 13 = 0")
check("url.canonical-mismatch", "SELECT page_id, CASE WHEN k % 11 = 0 THEN 'https://site.test/s' || ((k + 1) % 7) || '/i' || (k + 1) ELSE 'https://other.test/x' END AS value, CASE WHEN k % 11 = 0 THEN 'path' ELSE 'different host' END AS pattern FROM p WHERE k % 11 = 0 OR k % 13 = 0", "page_id", "value", "pattern")
check("url.insecure-self-reference", "SELECT 'http://site.test/x' || k AS subject, node_id AS value FROM l WHERE k % 8 = 0", "subject", "value")
check("url.foreign-media-host", "SELECT 'img' || (k % 3) || '.other.test' AS subject, 'https://img' || (k % 3) || '.other.test/i' AS value FROM l WHERE k % 10 = 0", "subject", "value")
check("graph.relative-id", "SELECT page_id, node_id AS value FROM n WHERE k % 61 = 0")
check("graph.orphan-node", "SELECT n.page_id, n.node_id AS value FROM n JOIN l USING (node_id) WHERE l.t = 'Offer' AND n.t <> 'WebPage'")
check("graph.blank-node-entity", "SELECT page_id, t AS subject, 'n' || (k % 50) AS value FROM n WHERE k % 7 = 0 AND t IN ('Organization', 'LocalBusiness', 'Product')", "page_id", "subject", "value")
check("entity.multi-value", "SELECT page_id, node_id AS subject FROM n WHERE k % 12 = 0", "page_id", "subject")
check("entity.contradiction", "SELECT x.node_id AS subject, 'https://schema.org/name' AS property FROM n x JOIN n y ON x.node_id = y.node_id AND x.k < y.k", "subject", "property")
check("entity.type-narrowing", "SELECT x.node_id AS subject FROM n x JOIN n y ON x.node_id = y.node_id AND x.k < y.k WHERE x.t = 'Organization' AND y.t = 'LocalBusiness'", "subject")
check("entity.type-conflict", "SELECT x.node_id AS subject FROM n x JOIN n y ON x.node_id = y.node_id AND x.k < y.k WHERE NOT (x.t = 'Organization' AND y.t = 'LocalBusiness')", "subject")
check("robots.ai-crawler-blocked", "SELECT 's' || k AS site, 'GPTBot' AS subject, 'training' AS value FROM a WHERE k % 2 = 0", "site", "subject", "value")
check("robots.resource-blocked", "SELECT 's' || k AS site, 'CSS' AS subject, '/theme/a.css$' AS value FROM a WHERE k % 2 = 1 UNION ALL SELECT 's' || k, 'core assets', '/wp-includes/' FROM a WHERE k % 2 = 1 AND k % 6 >= 2", "site", "subject", "value")
check("robots.sitemap-missing", "SELECT 's' || k AS site, '1' AS value FROM a WHERE k % 5 = 0", "site", "value")
