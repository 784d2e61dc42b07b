"""Stored crawls: pages, nodes and links as JSON lines or Parquet, read with explicit schemas so that what was not measured is null."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.context import LINK_SCHEMA, PAGE_SCHEMA, VALUE_SCHEMA


def read_jsonl(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """Rows of a JSON lines file; a corrupt tail is dropped; an optional file that is missing is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        if optional:
            return spark.createDataFrame([], schema)
        raise


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"pages": read_jsonl(spark, f"{path}/pages.jsonl", PAGE_SCHEMA), "values": read_jsonl(spark, f"{path}/values.jsonl", VALUE_SCHEMA, True), "links": read_jsonl(spark, f"{path}/links.jsonl", LINK_SCHEMA, True)}


def write_store(df: DataFrame, path: str) -> None:
    """Overwrite a relation, partitioned by site, so a repeated run leaves one copy."""
    df.write.mode("overwrite").partitionBy("site").parquet(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last run of every site."""
    return runs.groupBy("site").agg(F.max("run_id").alias("run_id"))
