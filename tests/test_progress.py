"""Directions of changes and warnings about samples."""

import pytest
from pyspark.sql import functions as F

from siteweave.plans.progress import coverage_warning, directed, direction

MOVES = [((17, 16, 78, 76), "shifted"), ((78, 76, 78, 76), "shifted"), ((10, 5, 100, 100), "improved"), ((5, 6, 100, 100), "worsened"), ((5, 0, 0, 10), "shifted"), ((5, 0, 10, 0), "shifted")]


def test_direction(spark):
    d = spark.createDataFrame([m for m, _ in MOVES], "a long, b long, c long, d long").select(direction(*map(F.col, "abcd")).alias("x"))
    assert [r.x for r in d.collect()] == [w for _, w in MOVES]


@pytest.mark.parametrize(("sizes", "names", "want"), [((0, 5), "aa", "without"), ((5, 0), "aa", "without"), ((100, 89), "aa", "11% fewer"), ((100, 111), "aa", "11% more"), ((100, 90), "aa", None), ((100, 110), "aa", None), ((100, 100), "ab", "differently"), ((100, 50), "ab", "50% fewer")])
def test_coverage_warning(spark, sizes, names, want):
    row = spark.createDataFrame([(*sizes, *names)], "a long, b long, c string, d string").select(coverage_warning(*map(F.col, "abcd")).alias("x")).first()
    assert (row.x is None) if want is None else (want in row.x)


def test_only_changed_rows_have_a_direction(spark):
    runs = [spark.createDataFrame([("s", "f", n), ("s", "g", 1)], "site string, finding_id string, pages_affected long") for n in (9, 2)]
    diff = spark.createDataFrame([("s", "f", "c", "changed"), ("s", "g", "c", "unchanged")], "site string, finding_id string, check string, status string")
    samples = spark.createDataFrame([("s", 20, 20)], "site string, sample_before long, sample_after long")
    assert {(r.finding_id, r.direction) for r in directed(diff, *runs, samples).collect()} == {("f", "improved"), ("g", None)}
