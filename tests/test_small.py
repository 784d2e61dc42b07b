from datetime import datetime, timezone

from pyspark.sql import functions as F

from siteweave.functions import small


def test_small_functions(spark):
    def values(make, rows, kind):
        d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
        return [r.v for r in d.select("i", make(d).alias("v")).orderBy("i").collect()]

    now = int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    got = values(lambda d: small.retry_after_ms(d.x, F.lit(now)), [("120",), (" 0 ",), ("Thu, 01 Jan 2026 00:01:00 GMT",), ("Wed, 31 Dec 2025 00:00:00 GMT",), ("soon",), ("",), (None,)], "x string")
    assert got == [120_000, 0, 60_000, 0, None, None, None]
    got = values(lambda d: small.format_bytes(d.x), [(0,), (1023,), (1024,), (10_239,), (10_240,), (1_048_576 * 250,), (1024**5,), (None,)], "x long")
    assert got == ["0 B", "1023 B", "1.0 KB", "10.0 KB", "10 KB", "250 MB", "1024 TB", None]
    assert values(lambda d: small.in_words(d.x), [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],), (None,)], "x array<string>") == ["", "a", "a and b", "a, b and c", None]
    assert values(lambda d: small.run_id(F.timestamp_millis(d.x)), [(now + 3_723_004,)], "x long") == ["20260101T010203Z"]
    assert values(lambda d: small.site_slug(d.x), [("https://Shop.example.com:8080/a?b",), ("http://u@h.test",)], "x string") == ["shop.example.com_8080", "h.test"]
