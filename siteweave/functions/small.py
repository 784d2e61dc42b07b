"""Small functions of crawls and reports, as column expressions; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Sizes are named in steps of 1024.
UNITS = ("KB", "MB", "GB", "TB")


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Milliseconds that a ``Retry-After`` header asks for: seconds, or an HTTP date (a past one is 0); null if neither."""
    text = F.trim(value)
    date = F.concat(F.regexp_extract(text, r"^(?:[A-Za-z]+,\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit(" +0000"))
    until = F.unix_millis(F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss xx")))
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("long") * 1000).otherwise(F.when(until.isNotNull(), F.greatest(F.lit(0).cast("long"), until - now_ms)))


def format_bytes(n: Column) -> Column:
    """A size for people: whole bytes below 1024, then one decimal below ten of a unit and none from there on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for step, unit in enumerate(UNITS, 1):
        v = n / F.lit(float(1024**step))
        out = F.when(v >= 1, F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.floor(v + 0.5).cast("string")), F.lit(f" {unit}"))).otherwise(out)
    return out


def in_words(names: Column) -> Column:
    """``a, b and c``; an empty list is an empty text."""
    n = F.size(names)
    return F.when(n < 2, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(names, -1)))


def run_id(at: Column) -> Column:
    """The compact timestamp that names a run; the session's time zone is UTC."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def site_slug(origin: Column) -> Column:
    """The host (and port) of an address as a folder name."""
    host = F.lower(F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.regexp_replace(host, r"[^a-zA-Z0-9.-]+", "_")
