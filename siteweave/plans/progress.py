"""What a difference between two runs can support: whether their samples are comparable, and which way a finding moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Shares of the earlier sample outside which runs are not comparable, and the pages a change has to move by.
FEWER, MORE, LEAST_PAGES = 0.9, 1.1, 1


def coverage_warning(before: Column, after: Column, strategy_before: Column, strategy_after: Column) -> Column:
    """Why a difference of runs of ``before`` and ``after`` pages is to be read with care; null where nothing speaks against it."""
    ratio = after / F.nullif(before, F.lit(0))
    sizes = F.concat(F.lit("The later run audited "), after.cast("string"), F.lit(" pages, the earlier "), before.cast("string"))
    percent = lambda share: F.concat(F.lit(": "), F.floor(share * 100 + 0.5).cast("string"), F.lit("% "))
    return (
        F.when((before == 0) | (after == 0), "A run without pages cannot be compared.")
        .when(ratio < FEWER, F.concat(sizes, percent(1 - ratio), F.lit("fewer. Findings may be gone because nobody looked.")))
        .when(ratio > MORE, F.concat(sizes, percent(ratio - 1), F.lit("more. Findings may be seen for the first time only.")))
        .when(~strategy_before.eqNullSafe(strategy_after), F.concat(F.lit("The runs chose their pages differently: "), F.coalesce(strategy_before, F.lit("unknown")), F.lit(", then "), F.coalesce(strategy_after, F.lit("unknown")), F.lit(".")))
    )


def direction(pages_before: Column, pages_after: Column, sample_before: Column, sample_after: Column) -> Column:
    """``improved`` or ``worsened`` if a finding's share of the sample moved by a page of the later sample or more, else ``shifted``."""
    # As a share: a finding on every page shrinks with the sample, though nothing got better.
    moved = pages_after - pages_before * sample_after / F.nullif(sample_before, F.lit(0))
    known = (sample_before > 0) & (sample_after > 0)
    return F.when(known & (moved <= -LEAST_PAGES), "improved").when(known & (moved >= LEAST_PAGES), "worsened").otherwise("shifted")


def directed(diff: DataFrame, before: DataFrame, after: DataFrame, samples: DataFrame) -> DataFrame:
    """``diff`` of two runs with ``direction`` of its changed rows; ``samples(site, sample_before, sample_after)`` counts their pages."""
    of = lambda df, name: df.select("site", "finding_id", F.col("pages_affected").alias(name))
    both = diff.join(of(before, "p0"), ["site", "finding_id"], "left").join(of(after, "p1"), ["site", "finding_id"], "left").join(samples, "site", "left")
    moved = direction(F.col("p0"), F.col("p1"), F.col("sample_before"), F.col("sample_after"))
    return both.select(*diff.columns, F.when(F.col("status") == "changed", moved).alias("direction"))
