"""URL filters by redirect equivalence.

Pages, and the targets of their canonical links and immediate refreshes, are the
nodes of a graph; its distributed connected components are groups of aliases.
Every node is judged by the rules: the longest rule that fits host and path, of
equal lengths the one with the longer host. A page that no rule fits takes the
decision of its group: allow if any alias is explicitly allowed, else block if any
is blocked, else allow. A page's own rule always decides for itself.

Cases: null and malformed urls (no ``://``) have an empty host and path, fit no
rule, and are no nodes; a null html has no links; a node is a url with its scheme
and host in lower case, an empty path as ``/``, without a default port or fragment,
so spellings of one address are one node; null ids and repeated rows get a row each; an empty table gives an empty result;
other columns are ignored. Rules are a short list given with the call.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ascii_lower, broadcast_if_small, checkpointed, connected_components, map_arrow

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A tag ends at its first ``>``, or where the next ``<`` begins, so a search never looks at a character twice.
LINK = re.compile(r"<(link|meta)(?=[\s/])([^<>]*)", re.IGNORECASE)
ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HOST = re.compile(r"[^/?#]*")
PORTS = {"http": ":80", "https": ":443"}
REFRESH = re.compile(r"^\s*\d+(?:\.\d*)?\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"'\s]+)", re.IGNORECASE)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the rule that wins, or null. Rules are ``(verdict, host, path)``."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def node(url: str | None) -> str | None:
    """The graph's name for an address, or None for what has no ``://``."""
    if not url or "://" not in url:
        return None
    scheme, _, rest = url.partition("#")[0].partition("://")
    m = HOST.match(rest)
    scheme, host = scheme.lower(), m[0].lower()
    host = host.removesuffix(PORTS.get(scheme, ":"))
    tail = rest[m.end() :]
    return f"{scheme}://{host}{'' if tail.startswith('/') else '/'}{tail}"


def targets(page_url: str, html: str) -> list[str]:
    """The nodes where a page's canonical links and refreshes lead."""
    out = []
    for tag, inside in LINK.findall(html):
        attrs: dict[str, str] = {}
        for k, a, b, c in ATTR.findall(inside):
            attrs.setdefault(k.lower(), entities.unescape(a or b or c))
        to = None
        if tag.lower() == "link" and "canonical" in attrs.get("rel", "").lower().split():
            to = attrs.get("href", "").strip()
        elif tag.lower() == "meta" and attrs.get("http-equiv", "").strip().lower() == "refresh" and (m := REFRESH.match(attrs.get("content", ""))):
            to = m[1]
        if to:
            try:
                found = node(urljoin(page_url, to))
            except ValueError:
                continue
            if found:
                out.append(found)
    return out


def page_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: edges between nodes from the pages' own markup."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def run(batches):
        for b in batches:
            rows = [(node(u), t) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], schema=schema)

    likely = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    return map_arrow(likely.select("url", "html"), run, "a string, b string")


def with_nodes(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with columns of the nodes of its url columns, by the same function as the markup's edges."""
    names = list(columns)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches):
        for b in batches:
            extra = [pa.array([node(u) for u in b.column(b.schema.get_field_index(columns[n])).to_pylist()], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *names])

    return map_arrow(df, run, schema)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, group``. ``redirects(a, b)`` adds known redirect edges to those in the markup."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(with_nodes(redirects.select(F.col("a").alias("x"), F.col("b").alias("y")), a="x", b="y").select("a", "b"))
    groups = connected_components(edges)
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if not groups.isEmpty():
        nodes = groups.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
        spread = nodes.groupBy("component").agg(F.bool_or(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allowed"), F.bool_or(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"))
        taken = checkpointed(nodes.join(spread, "component").select(F.col("node"), "component", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("inherited")))
        judged = with_nodes(judged, node="url").join(broadcast_if_small(taken, 64, more=F.length("node") + F.length("component")), "node", "left")
    else:
        judged = judged.withColumns({"component": F.lit(None).cast("string"), "inherited": F.lit(None).cast("string")})
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"), F.col("component").alias("group"))
