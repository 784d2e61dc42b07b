"""From stored HTML to the relations that checks read: blocks, links, finalised facts, nodes and values.

Pages are parsed once, in Arrow batches, and the parts are written. What is site furniture is then counted over each site's
pages (partial aggregation by site and part), and the facts that depend on it are sums by page. No site is gathered in one
task; only the blocks of one page meet, for its fingerprint and its Markdown.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import simhash
from ..functions.url import canonicalise_col
from ..operators.context import NODE_SCHEMA, PAGE_SCHEMA, VALUE_SCHEMA, Context
from ..operators.crawl import chrome
from ..session import checkpointed
from ..sources.html import extract_pages
from ..sources.jsonld import node_values

BLOCK = "hash string, tag string, text string, words int, hidden boolean, structural_chrome boolean"
LINK = "to string, anchor string, internal boolean, rel string, block string"
FACTS = (
    "title string, meta_description string, heading_levels array<int>, robots struct<index: boolean, follow: boolean, raw: string>, html_lang string, has_main boolean, has_article boolean,"
    "images int, missing_alt int, suspect_alt array<string>, dom_words int, main_words int, aside_words int, canonical string, microdata int, rdfa int, microdata_types array<string>"
)
FAULT = r"^ld-block-\d+: "


def markdown(blocks: Column, title: Column) -> Column:
    """The visible content blocks ``(ord, tag, text)`` of a page in order: headings at their level, list items on a line each, the title where no ``h1`` stands."""
    head = F.when(title.isNotNull() & ~F.exists(blocks, lambda b: b["tag"] == "h1"), F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise("")
    level = lambda b: F.repeat(F.lit("#"), F.substring(b["tag"], 2, 1).cast("int"))
    line = lambda b: F.when(b["tag"].rlike("^h[1-6]$"), F.concat(level(b), F.lit(" "), b["text"], F.lit("\n\n"))).when(b["tag"] == "li", F.concat(F.lit("- "), b["text"], F.lit("\n"))).otherwise(F.concat(b["text"], F.lit("\n\n")))
    body = F.regexp_replace(F.concat(head, F.array_join(F.transform(blocks, line), "")), "\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"))


def _optional(pages: DataFrame, name: str, kind: str, default: Column | None = None) -> Column:
    """The column of that name, or ``default`` (null) where pages have none."""
    return (F.col(name) if name in pages.columns else default if default is not None else F.lit(None)).cast(kind).alias(name)


class Extraction:
    """``pages`` as checks read them, with ``content_simhash`` and ``content_md`` beside; ``links`` with ``in_chrome``; nodes and values.

    Each relation is made when it is first read: who asks for links alone pays for no fingerprint and no Markdown.
    """

    def __init__(self, pages: DataFrame) -> None:
        self._given = pages.withColumn("page_id", F.col("page_id").cast("string"))
        self._stored = self._given.where("html IS NOT NULL")
        self._spark = pages.sparkSession

    @cached_property
    def _parts(self) -> DataFrame:
        return checkpointed(extract_pages(self._stored.select("site", F.col("ord").cast("long").alias("page_ord"), "page_id", "url", "html"), "site string, page_ord long"))

    def _of(self, kind: str, ddl: str) -> DataFrame:
        own = ["site", "page_id", "page_ord", "ord"]
        return self._parts.where(F.col("kind") == kind).select(*own, F.from_json("payload", ddl).alias("x")).select(*own, "x.*")

    @cached_property
    def _measured(self) -> DataFrame:
        return self._of("facts", FACTS).drop("page_ord", "ord")

    @cached_property
    def _furniture(self) -> DataFrame:
        found = self._of("block", BLOCK).where("NOT structural_chrome AND NOT tag RLIKE '^h[1-6]$'").select("site", "page_id", F.col("hash").alias("part"))
        return checkpointed(chrome(found, pages=self._measured).select("site", F.col("part").alias("hash"), F.lit(True).alias("frequent")))

    @cached_property
    def blocks(self) -> DataFrame:
        found = self._of("block", BLOCK).join(self._furniture, ["site", "hash"], "left")
        return found.withColumn("chrome", F.col("structural_chrome") | F.coalesce("frequent", F.lit(False))).drop("frequent")

    @cached_property
    def links(self) -> DataFrame:
        edges = self._of("link", LINK)
        targets = chrome(edges.select("site", "page_id", F.col("to").alias("part")), pages=self._measured).select("site", F.col("part").alias("to"), F.lit(True).alias("everywhere"))
        links = edges.join(checkpointed(targets), ["site", "to"], "left").join(self._furniture.withColumnRenamed("hash", "block"), ["site", "block"], "left")
        return checkpointed(links.withColumn("in_chrome", F.coalesce("everywhere", "frequent", F.lit(False))).drop("everywhere", "frequent"))

    @property
    def _content(self) -> DataFrame:
        """Words by page, and the blocks that are shown."""
        shown = F.array_sort(F.collect_list(F.when(~F.col("chrome") & ~F.col("hidden"), F.struct("ord", "tag", "text"))))
        total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("words"))), F.lit(0)).cast("int")
        return self.blocks.groupBy("site", "page_id").agg(total(~F.col("chrome") & ~F.col("hidden")).alias("extractable_words"), total(~F.col("chrome") & F.col("hidden")).alias("hidden_words"), shown.alias("shown"))

    @cached_property
    def words(self) -> DataFrame:
        """``(site, page_id, extractable_words, hidden_words)`` of every page; null without content."""
        known = self._measured.select("site", "page_id", F.lit(0).alias("none"))
        out = self._given.select("site", "page_id").join(known, ["site", "page_id"], "left").join(self._content.drop("shown"), ["site", "page_id"], "left")
        return out.select("site", "page_id", *[F.when(F.col("none") == 0, F.coalesce(c, "none")).alias(c) for c in ("extractable_words", "hidden_words")])

    @cached_property
    def _long(self) -> DataFrame:
        ld = self._of("ld", "block int, body string").join(self._stored.select("site", "page_id", "url"), ["site", "page_id"])
        return checkpointed(node_values(ld.select("page_id", "page_ord", "url", "block", "body", "site"), "site string"))

    @cached_property
    def nodes(self) -> DataFrame:
        return checkpointed(self._long.where("node_id IS NOT NULL").select(*[c.split()[0] for c in NODE_SCHEMA.replace("array<string>", "a").split(", ")]).distinct())

    @cached_property
    def values(self) -> DataFrame:
        return checkpointed(self._long.where("prop IS NOT NULL").select(*[c.split()[0] for c in VALUE_SCHEMA.split(", ")]))

    @cached_property
    def _pages(self) -> DataFrame:
        """Not yet kept, so that what is not asked for is not computed."""
        pages, spark = self._given, self._spark
        schema = {f.name: f.dataType.simpleString() for f in Context(spark, pages)._empty(PAGE_SCHEMA).schema}
        faults = self._long.groupBy("site", "page_id").agg(F.array_sort(F.collect_set("error")).alias("faults"), F.count_distinct("node_ord").cast("int").alias("node_count"))
        content = self._content
        joined = pages.drop("nodes", "facts", "declared_canonical", "microdata_items", "microdata_types")
        joined = joined.join(self._measured.withColumn("extracted", F.lit(True)), ["site", "page_id"], "left").join(content, ["site", "page_id"], "left").join(faults, ["site", "page_id"], "left")
        kept = F.filter(F.coalesce(_optional(pages, "errors", "array<string>"), F.array().cast("array<string>")), lambda e: ~e.rlike(FAULT))
        none = F.array().cast("array<string>")
        here = F.coalesce("shown", F.array().cast(content.schema["shown"].dataType))
        derived = {
            "facts": F.when(F.col("extracted"), F.struct("title", "meta_description", "heading_levels", (~F.col("robots.index")).alias("noindex"), "html_lang", "has_main", "has_article", "images", "missing_alt", "suspect_alt", "dom_words", "main_words", "aside_words", F.coalesce("extractable_words", F.lit(0)).alias("extractable_words"), F.coalesce("hidden_words", F.lit(0)).alias("hidden_words"))),
            "declared_canonical": F.col("canonical"), "microdata_items": F.col("microdata"), "microdata_types": F.col("microdata_types"), "nodes": F.coalesce("node_count", F.lit(0)), "errors": F.concat(kept, F.coalesce("faults", none)),
            "canonical_url": canonicalise_col(F.col("url")) if "canonical_url" not in pages.columns else F.col("canonical_url"),
            "content_sha256": F.sha2("html", 256) if "content_sha256" not in pages.columns else F.col("content_sha256"), "bytes": F.octet_length("html") if "bytes" not in pages.columns else F.col("bytes"),
            "http_status": F.lit(200) if "http_status" not in pages.columns else F.col("http_status"), "source": F.lit("sitemap") if "source" not in pages.columns else F.col("source"),
        }
        return joined.select(
            *[(derived[n] if n in derived else _optional(pages, n, t)).cast(t).alias(n) for n, t in schema.items()],
            F.when(F.col("extracted"), simhash(F.array_join(F.transform(here, lambda b: b["text"]), " "))).alias("content_simhash"),
            F.when(F.col("extracted"), markdown(here, F.col("title"))).alias("content_md"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return checkpointed(self._pages)

    def context(self, **more) -> Context:
        """The input of ``run_checks``."""
        names = [c.name for c in Context(self._spark, self._given)._empty(PAGE_SCHEMA).schema]
        links = self.links.select("site", F.col("page_id").alias("from_page"), F.col("to").alias("to_url"), "internal", "in_chrome")
        return Context(self._spark, checkpointed(self._pages.select(names)), self.nodes, self.values, links, **more)


def extract_site(pages: DataFrame) -> Extraction:
    """``pages(site, page_id, ord, url, html)``, with any of the other page columns that a crawl has measured.

    A null ``html`` is a page without content: its facts stay null and it does not count towards site furniture. An empty table
    gives empty relations. Crawl errors of a page are kept, those of an earlier extraction are replaced.
    """
    return Extraction(pages)
