"""Crawl-side operators over tables: sampling, link hop, redirect folding, the replayed frontier, sitemap repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.url import could_be_page
from ..session import TASK_ROWS, dealt, tasks_for

MOST_PAGES, MOST_HOPS = 100, 50


def select_sample(candidates: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """``candidates(site, url, sitemap, ord)``: round-robin over sitemaps in order of first sight, the front page first."""
    front = F.col("url").rlike(r"^https?://[^/]+/?$")
    seen = candidates.groupBy("site", "sitemap").agg(F.min("ord").alias("first"))
    c = candidates.join(seen, ["site", "sitemap"]).withColumn("turn", F.row_number().over(Window.partitionBy("site", "sitemap").orderBy("ord")))
    place = F.row_number().over(Window.partitionBy("site").orderBy((~front).cast("int"), "turn", "first", "ord"))
    return c.where(F.col("turn") <= most).withColumn("place", place).where(F.col("place") <= most).select("site", "url", "sitemap", "place")


def link_hop(links: DataFrame, known: DataFrame, most: int = MOST_HOPS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Targets no sitemap lists, by the number of pages that link to them, then by URL.

    Links are made distinct in tasks of about ``task_rows`` of them, dealt by page and target, so that neither a large table nor a
    page that all others link to fills a task; the counts are then summed by target.
    """
    own = ("site", "to_url", "from_page")
    each = links.where("internal").where(could_be_page(F.col("to_url"))).select(*own)
    each = dealt(each, tasks_for(links.count(), links.sparkSession, task_rows), *own).distinct()
    t = each.groupBy("site", "to_url").agg(F.count("from_page").alias("pages"))
    t = t.join(known.select("site", F.col("url").alias("to_url")).distinct(), ["site", "to_url"], "left_anti")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("pages"), "to_url"))).where(F.col("rank") <= most)


def reconcile(fetched: DataFrame) -> DataFrame:
    """``fetched(site, final_url, url, ord)``: one page per final URL; the direct request is primary, the others are its aliases, in any order of arrival."""
    key = F.struct((F.col("url") == F.col("final_url")).alias("direct"), (-F.col("ord")).alias("o"), "url")
    return fetched.groupBy("site", "final_url").agg(F.max(key)["url"].alias("url"), (F.count("*") - 1).alias("n_aliases"))


def replay(journal: DataFrame, key: str, seq: str, *keep: str) -> DataFrame:
    """The last record of every key."""
    return journal.groupBy(key).agg(F.max_by(F.struct(*keep), seq).alias("r")).select(key, "r.*")


def sitemap_repeats(entries: DataFrame) -> DataFrame:
    """``entries(site, url, sitemap, ord)``: every repeat of a URL with the sitemap that named it first."""
    w = Window.partitionBy("site", "url").orderBy("ord")
    e = entries.withColumns({"k": F.row_number().over(w), "first_sitemap": F.first("sitemap").over(w)})
    return e.where("k > 1").select("site", "url", F.col("sitemap").alias("from_sitemap"), "first_sitemap")


def chrome(parts: DataFrame, least_pages: int = 5, share: float = 0.8, pages: DataFrame | None = None) -> DataFrame:
    """``parts(site, page_id, part)``: parts (block hashes or link targets) on at least four fifths of a site's pages.

    Pages are those with a part, or all of ``pages(site, page_id)`` where given.
    """
    pages = (parts if pages is None else pages).groupBy("site").agg(F.count_distinct("page_id").alias("n")).where(F.col("n") >= least_pages)
    return parts.groupBy("site", "part").agg(F.count_distinct("page_id").alias("k")).join(pages, "site").where(F.col("k") >= share * F.col("n")).select("site", "part", "k", "n")
