"""The relations that checks read, and how observations become findings.

Every check is a function ``(Context) -> rows`` where a row is one observation ``(site, key, subject, property, value,
page_id, pattern)``. ``findings`` folds the observations of all checks alike: counts first, by key and value with partial
aggregation, then the ten commonest values per key by window, so no key's observations are ever gathered whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import rules
from ..functions.text import finding_id, https_schema, short_iri
from ..session import TASK_ROWS, dealt, tasks_for

ROWS = ("site", "key", "subject", "property", "value", "page_id", "pattern")
LISTED, AGGREGATE_FROM = 10, 3
PAGE_SCHEMA = (
    "site string, page_id string, ord long, url string, canonical_url string, declared_canonical string, source string, http_status int,"
    "redirect_chain array<struct<url: string, status: int, location: string>>, aliases array<struct<url: string, source: string, http_status: int, redirect_chain: array<struct<url: string, status: int, location: string>>>>,"
    "content_sha256 string, bytes long, nodes int, microdata_items int, microdata_types array<string>, errors array<string>,"
    "facts struct<title: string, meta_description: string, heading_levels: array<int>, noindex: boolean, html_lang: string, has_main: boolean, has_article: boolean, images: int, missing_alt: int, suspect_alt: array<string>, dom_words: int, main_words: int, aside_words: int, extractable_words: int, hidden_words: int>"
)
NODE_SCHEMA = "site string, page_id string, page_ord long, node_ord int, node_id string, raw_id string, is_blank boolean, types array<string>"
VALUE_SCHEMA = NODE_SCHEMA.replace("raw_id string, is_blank boolean, types array<string>", "prop string, val_ord int, kind string, text string")
LINK_SCHEMA = "site string, from_page string, to_url string, internal boolean"


@dataclass
class Context:
    """Input relations; ``None`` means not measured, which is not the same as empty."""

    spark: SparkSession
    pages_all: DataFrame
    nodes_all: DataFrame | None = None
    values_all: DataFrame | None = None
    links: DataFrame | None = None
    robots: DataFrame | None = None  # site, agents array, allow array, disallow array, sitemaps array, sitemaps_found int
    sitemap_repeats: DataFrame | None = None  # site, url, from_sitemap, first_sitemap
    partial: bool = False
    hop_complete: bool = True
    extra: dict = field(default_factory=dict)
    task_rows: int = TASK_ROWS

    @cached_property
    def tasks(self) -> int:
        """In how many partitions nodes and values are dealt; 0 for a site so small that it needs none."""
        return tasks_for(sum(x.count() for x in (self.nodes_all, self.values_all) if x is not None), self.spark, self.task_rows)

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        return dealt(df, self.tasks, *keys)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    @cached_property
    def pages(self) -> DataFrame:
        """The audited sample: pages found only by following links are left to the link checks."""
        return self.pages_all.where(~F.coalesce(F.col("source").startswith("link-hop:"), F.lit(False)))

    @cached_property
    def _audited(self) -> DataFrame:
        return self.pages.select("site", "page_id")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.dealt(self.nodes_all if self.nodes_all is not None else self._empty(NODE_SCHEMA), "site", "page_id").join(self._audited, ["site", "page_id"], "left_semi")

    @cached_property
    def raw_values(self) -> DataFrame:
        return self.dealt(self.values_all if self.values_all is not None else self._empty(VALUE_SCHEMA), "site", "page_id").join(self._audited, ["site", "page_id"], "left_semi")

    @cached_property
    def site_host(self) -> DataFrame:
        """Host of the first page of each site, hop pages included."""
        host = F.split_part("canonical_url", F.lit("/"), F.lit(3))
        return self.pages_all.where(host != "").groupBy("site").agg(F.min_by(host, "ord").alias("site_host"))

    @cached_property
    def index(self) -> DataFrame:
        """One row per node id: the last observation."""
        at = F.struct("page_ord", "node_ord", "page_id")
        return self.nodes.groupBy("site", "node_id").agg(F.max(at).alias("at"), F.max_by("page_id", at).alias("page_id"), F.max_by("types", at).alias("types"), F.bool_and("is_blank").alias("is_blank"))

    @cached_property
    def index_values(self) -> DataFrame:
        last = self.index.select("site", "node_id", "page_id", F.col("at.page_ord").alias("page_ord"), F.col("at.node_ord").alias("node_ord"))
        return self.raw_values.join(last, ["site", "node_id", "page_id", "page_ord", "node_ord"], "left_semi")

    @cached_property
    def values(self) -> DataFrame:
        """All values with what they denote: text, a named id, or the content of a blank node three references deep.

        Only texts that can name a blank node (``_:``) are dealt by text to find it: a common text would fill a task.
        """
        v = self.raw_values.where("prop IS NOT NULL")
        blank = self.nodes.where("is_blank").select("site", "node_id", F.to_json(F.array_sort("types")).alias("digest")).dropDuplicates(["site", "node_id"])
        plain = F.concat_ws("", "kind", F.lit(":"), F.coalesce("text", F.lit("")))
        own = v.join(self.nodes.where("is_blank").select("site", "node_id").distinct(), ["site", "node_id"], "left_semi")
        for _ in range(3):
            ref = blank.select("site", F.col("node_id").alias("text"), F.col("digest"))
            inner = own.join(ref, ["site", "text"], "left").withColumn("d", F.coalesce(F.concat(F.lit("node:"), "digest"), plain))
            props = inner.groupBy("site", "node_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("prop", "d")))), 256).alias("p"))
            types = self.nodes.where("is_blank").select("site", "node_id", F.to_json(F.array_sort("types")).alias("t")).dropDuplicates(["site", "node_id"])
            blank = types.join(props, ["site", "node_id"], "left").select("site", "node_id", F.concat_ws("|", "t", "p").alias("digest"))
        named = F.coalesce(F.col("text").startswith("_:"), F.lit(False))
        refs = v.where(named).join(blank.select("site", F.col("node_id").alias("text"), "digest"), ["site", "text"], "left").withColumn("denoted", F.coalesce(F.concat(F.lit("node:"), "digest"), plain))
        return refs.drop("digest").unionByName(v.where(~named).withColumn("denoted", plain))

    @cached_property
    def groups(self) -> DataFrame:
        """Observations of named entities that have a type and a property."""
        own = ["site", "page_id", "node_ord", "node_id"]
        return self.dealt(self._entities, *own).join(self.raw_values.where("prop IS NOT NULL").select(*own), own, "left_semi")

    @property
    def _entities(self) -> DataFrame:
        return self.nodes.where(~F.col("is_blank") & (F.size("types") > 0))

    @cached_property
    def closure(self) -> DataFrame:
        return F.broadcast(rules.closure(self.spark))

    @cached_property
    def typed(self) -> DataFrame:
        """``(site, node_id, ancestor)`` over the index; unknown classes are themselves."""
        t = self.index.select("site", "node_id", F.explode("types").alias("iri")).withColumn("type", short_iri(F.col("iri")))
        return t.join(self.closure, "type", "left").select("site", "node_id", F.coalesce("ancestor", "type").alias("ancestor")).distinct()

    @cached_property
    def facts(self) -> DataFrame:
        """Pages answered with 200 whose facts are known, the first record of each canonical URL."""
        w = Window.partitionBy("site", "canonical_url").orderBy("ord", "page_id")
        return self.pages.where("http_status = 200 AND facts IS NOT NULL").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")

    @cached_property
    def requests(self) -> DataFrame:
        """Every request: pages, and those folded into them."""
        own = self.pages.select("site", "page_id", "ord", F.lit(0).alias("n"), "url", "source", "http_status", "redirect_chain", "canonical_url")
        more = self.pages.select("site", "page_id", "ord", F.posexplode("aliases").alias("n", "a"), "canonical_url")
        more = more.select("site", "page_id", "ord", (F.col("n") + 1).alias("n"), "a.url", "a.source", "a.http_status", "a.redirect_chain", "canonical_url")
        return own.unionByName(more)


def rows(df: DataFrame, key: Column | str, subject: Column | str, value: Column | str, property: Column | str | None = None, pattern: Column | str | None = None) -> DataFrame:  # noqa: A002
    """Observation rows of a check."""
    col = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select("site", col(key).alias("key"), col(subject).alias("subject"), col(property).alias("property"), col(value).alias("value"), F.col("page_id").cast("string").alias("page_id"), col(pattern).alias("pattern"))


def findings(observed: DataFrame) -> DataFrame:
    """``observed(check, severity, *ROWS)`` to findings with at most ten listed values, and how many more there were."""
    who = ["site", "check", "severity", "key"]
    per_value = observed.groupBy(*who, "value").agg(F.count_distinct("page_id").alias("page_count"), F.min("subject").alias("subject"), F.min("property").alias("property"), F.min("pattern").alias("pattern"))
    ranked = per_value.withColumn("k", F.row_number().over(Window.partitionBy(*who).orderBy(F.desc("page_count"), F.asc_nulls_last("value"))))
    item = F.struct("k", "value", "page_count")
    listed = ranked.groupBy(*who).agg(F.array_sort(F.collect_list(F.when(F.col("k") <= LISTED, item))).alias("observed"), F.greatest(F.count("*") - LISTED, F.lit(0)).alias("omitted_count"), *[F.min(c).alias(c) for c in ("subject", "property", "pattern")])
    pages = observed.groupBy(*who).agg(F.count_distinct("page_id").alias("pages_affected"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in who]
    out = listed.alias("l").join(pages.alias("p"), same).select(*[f"l.{c}" for c in listed.columns], "p.pages_affected")
    return out.withColumn("finding_id", finding_id(F.col("check"), F.col("key")))


def aggregate(found: DataFrame, observed: DataFrame) -> DataFrame:
    """Three or more findings of one check and pattern become one whose rows are the largest of them; its pages are all of theirs, from ``observed``."""
    what = ["site", "check", "severity", "pattern"]
    sizes = found.where("pattern IS NOT NULL").groupBy(*what).agg(F.count("*").alias("instance_count")).where(F.col("instance_count") >= AGGREGATE_FROM)
    single = found.join(sizes, what, "left_anti").withColumn("instance_count", F.lit(1).cast("long"))
    many = found.join(sizes, what, "left_semi")
    ranked = many.withColumn("k", F.row_number().over(Window.partitionBy(*what).orderBy(F.desc("pages_affected"), "key")))
    item = F.struct("k", F.concat_ws(" ", "subject", "property").alias("value"), F.col("pages_affected").alias("page_count"))
    merged = ranked.groupBy(*what).agg(F.array_sort(F.collect_list(F.when(F.col("k") <= LISTED, item))).alias("observed"), F.greatest(F.count("*") - LISTED, F.lit(0)).alias("omitted_count"), F.count("*").alias("instance_count"))
    union = observed.select("site", "check", "severity", "key", "page_id").join(many.select("site", "check", "severity", "key", F.col("pattern").alias("shared")), ["site", "check", "severity", "key"])
    union = union.groupBy("site", "check", "severity", F.col("shared").alias("pattern")).agg(F.count_distinct("page_id").alias("pages_affected"))
    merged = merged.join(union, what)
    merged = merged.withColumns({"key": F.concat(F.lit("aggregate|"), "pattern"), "subject": F.lit(None).cast("string"), "property": F.lit(None).cast("string")})
    merged = merged.withColumn("finding_id", finding_id(F.col("check"), F.col("key")))
    return single.unionByName(merged.select(single.columns))


def order(found: DataFrame) -> DataFrame:
    """By severity, group, pages and check, with ties broken by key."""
    rank = lambda c, names: F.coalesce(*[F.when(c == n, i) for i, n in enumerate(names)], F.lit(len(names)))
    return found.orderBy(rank(F.col("severity"), rules.SEVERITIES), rank(F.split_part("check", F.lit("."), F.lit(1)), rules.GROUPS), F.desc("pages_affected"), "check", "key")


def full(prop: str) -> Column:
    """The property ``prop`` in either spelling of the vocabulary's address."""
    return https_schema(F.col("prop")) == f"https://schema.org/{prop}"
