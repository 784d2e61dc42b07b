"""Running the catalogue: disabling, findings, aggregation, order, reports and their differences."""

from __future__ import annotations

from difflib import get_close_matches
from functools import reduce
from html import escape

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..operators.checks import CHECKS
from ..operators.context import Context, aggregate, findings, order
from ..session import checkpointed


def selected(disable: tuple[str, ...] = ()) -> list[str]:
    """Names of the checks to run; groups or single checks can be disabled, unknown names are refused with near ones."""
    for d in disable:
        if d not in CHECKS and d not in rules.GROUPS:
            near = get_close_matches(d, [*CHECKS, *rules.GROUPS], n=3)
            raise ValueError(f"unknown check or group {d!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return [n for n in CHECKS if n not in disable and n.partition(".")[0] not in disable]


def observations(ctx: Context, names: list[str]) -> DataFrame:
    parts = [CHECKS[n][1](ctx).select(F.lit(n).alias("check"), F.lit(CHECKS[n][0]).alias("severity"), "*") for n in names]
    return reduce(DataFrame.unionByName, parts)


def run_checks(ctx: Context, disable: tuple[str, ...] = ()) -> DataFrame:
    """Ordered findings of all selected checks."""
    # Read twice, for findings and for the pages of aggregates, so kept in the shared folder.
    seen = checkpointed(observations(ctx, selected(disable)))
    found = aggregate(findings(seen), seen)
    qualified = F.col("check").isin("graph.dangling-reference", "graph.orphan-node", "coverage.competing-syntax", "coverage.no-structured-data") & F.lit(ctx.partial)
    return order(found.withColumn("coverage_qualified", qualified))


def signature(found: DataFrame) -> DataFrame:
    """What a difference between runs compares: pages, instances and listed values with their counts."""
    listed = F.array_join(F.array_sort(F.transform("observed", lambda x: F.concat_ws("|", F.coalesce(x["value"], F.lit("")), x["page_count"].cast("string")))), ";")
    return found.select("site", "finding_id", "check", "pages_affected", F.concat_ws("#", F.col("pages_affected").cast("string"), F.col("instance_count").cast("string"), listed).alias("signature"))


def diff_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(site, finding_id, check, status)`` with status resolved, appeared, changed or unchanged."""
    a, b = signature(before).alias("a"), signature(after).alias("b")
    status = F.when(F.col("b.finding_id").isNull(), "resolved").when(F.col("a.finding_id").isNull(), "appeared").when(F.col("a.signature") != F.col("b.signature"), "changed").otherwise("unchanged")
    return a.join(b, (F.col("a.site") == F.col("b.site")) & (F.col("a.finding_id") == F.col("b.finding_id")), "full_outer").select(F.coalesce("a.site", "b.site").alias("site"), F.coalesce("a.finding_id", "b.finding_id").alias("finding_id"), F.coalesce("a.check", "b.check").alias("check"), status.alias("status"))


def build_report(ctx: Context, found: DataFrame, most: int = 5000) -> dict:
    """One document of the findings (a bounded list) and counts of all."""
    by = lambda c: {r[c]: r["count"] for r in found.groupBy(c).count().collect()}
    listed = [r.asDict(recursive=True) for r in found.limit(most).collect()]
    return {"report_schema": 1, "partial": ctx.partial, "pages": ctx.pages.count(), "by_severity": by("severity"), "by_check": by("check"), "findings": listed, "findings_left_out": max(0, sum(by("check").values()) - most)}


def to_markdown(report: dict) -> str:
    out = ["# Site report", "", f"{report['pages']} pages" + (" (partial)" if report["partial"] else ""), ""]
    for f in report["findings"]:
        out += [f"## {f['severity']}: {f['check']}", "", f"{f['subject'] or ''} {f['property'] or ''}".strip(), f"{f['pages_affected']} pages", ""]
        out += [f"- {o['value']} ({o['page_count']})" for o in f["observed"]] + ([f"- and {f['omitted_count']} more"] if f["omitted_count"] else []) + [""]
    return "\n".join(out)


def to_html(report: dict) -> str:
    """A page without scripts or outside resources; every value is escaped."""
    body = "".join(f"<section><h2>{escape(f['check'])}</h2><p>{escape(str(f['subject'] or ''))}</p><ul>" + "".join(f"<li>{escape(str(o['value']))} ({o['page_count']})</li>" for o in f["observed"]) + "</ul></section>" for f in report["findings"])
    return f"<!doctype html><meta charset=utf-8><title>Site report</title><h1>Site report</h1>{body}"
