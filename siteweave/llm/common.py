"""Shared storage, size-checked broadcasts and distributed connected components."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpointed, prepare, shared_dir

__all__ = ["ID", "TEXT_HASH", "ascii_lower", "broadcast_if_small", "by_keys", "checkpointed", "connected_components", "delete", "fresh_path", "gathered", "map_arrow", "scratch", "shared_dir", "sifted", "stored", "with_keys"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only below this many bytes, counted beforehand.
BROADCAST_BYTES = 4 << 20


#: Rows of a counted intermediate that one partition holds; one partition alone needs no shuffles.
PART_ROWS = 200_000


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it lies."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _app_dir(spark: SparkSession) -> str:
    """One folder for the intermediates of this application, removed when the driver's process ends."""
    base = f"{shared_dir(spark).rstrip('/')}/siteweave-{spark.sparkContext.applicationId}"
    if base not in _KNOWN:
        _KNOWN.add(base)

        def end() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already; the folder's name tells whose it was
                delete(spark, base)

        atexit.register(end)
    return base


_KNOWN: set[str] = set()
_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediates made inside are deleted at the end, when what was made of them has been written elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{_app_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends, executors may be lost."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` whose workers can import this package."""
    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, more: Column | None = None) -> DataFrame:
    """Hint a broadcast when a count proves that ``df`` (already stored) fits; else leave the join to a shuffle.

    ``row_bytes`` is for columns of fixed size; ``more`` gives the bytes of the others in a row, which are then summed.
    """
    if more is None:
        most = limit // row_bytes
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    size = df.agg(F.sum(more + F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


#: A bitmap has 8 to 16 bits for each key, up to two to this power (32 MB); its rows have so many longs.
MOST_BITS, LONGS = 28, 1024


def sifted(df: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in that column of ``among`` (already stored), and few others: by a bitmap of hashes that is broadcast.

    The join that follows looks exactly; it only has less to shuffle. Beyond
    ``MOST_BITS`` more of the others pass, and nothing else changes.
    """
    bits = 1 << min(max((8 * among.count()).bit_length(), 16), MOST_BITS)
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    on = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    found = among.select(F.shiftright(at(key), 6).alias("long"), on(at(key)).alias("on"))
    every = found.unionByName(df.sparkSession.range(bits // 64).select(F.col("id").alias("long"), F.lit(0).cast("long").alias("on")))
    longs = every.groupBy("long").agg(F.bit_or("on").alias("on")).groupBy((F.col("long") / LONGS).cast("long").alias("__sw_row"))
    table = F.broadcast(checkpointed(longs.agg(F.array_sort(F.collect_list(F.struct("long", "on")))["on"].alias("__sw_longs"))))
    has = table["__sw_longs"][F.shiftright(at(df[key]), 6).bitwiseAND(F.lit(LONGS - 1)).cast("int")].bitwiseAND(on(at(df[key]))) != 0
    return df.join(table, (F.shiftright(at(df[key]), 6 + LONGS.bit_length() - 1) == table["__sw_row"]) & has).select(*[df[c] for c in df.columns])


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose rows were counted, in partitions of ``PART_ROWS``; what follows on a single one needs no shuffle."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also fold non-ASCII letters)."""
    return F.translate(col, UPPER, LOWER)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, the component being its smallest node.

    Random-priority hooking: in each round every node points to the neighbour of
    least priority (hash seeded by the round), then edges are contracted through
    these pointers. Rounds are logarithmic in expectation, also on long chains.
    Aggregations combine map-side, so a hub with many edges is no hot task; the
    joins on contracted ends can be split by the adaptive skew join. Each round
    ends in written tables (a checkpoint would keep the planner's size estimates,
    which multiply in every join until they alone take minutes); what has become
    small is held in few partitions. Its joins are merged: sides in one partition
    need no exchange then, while broadcasts, two or more a round, would each be built
    and held in the driver. Null ends and self-loops are ignored; nodes
    without an edge are not returned.
    """
    edges = stored(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    spark, steps, round_no = edges.sparkSession, [], 0
    kind = edges.schema["a"].dataType.simpleString()
    while n := edges.count():
        edges = gathered(edges, n)
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_no), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), rank("b").alias("to")), F.struct(F.col("b").alias("node"), rank("a").alias("to")))).alias("e")).select("e.node", "e.to")
        hook = stored(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(F.col("to"), rank("node"))["v"].alias("parent")), "hooks")
        # Every edge has at most two nodes, which bounds the hooks.
        hook = gathered(hook, 2 * n)
        steps.append(hook)
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("parent").alias("pa")).hint("merge"), "a").join(hook.select(F.col("node").alias("b"), F.col("parent").alias("pb")).hint("merge"), "b")
        edges = stored(left.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        round_no += 1
    if not steps:
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    # A node may hook to one that itself hooks on in the same round; the edge between the two lives on, so later rounds join them.
    roots = steps[0].select("node", F.col("parent").alias("root"))
    for hook in steps[1:]:
        roots = roots.join(hook.select(F.col("node").alias("root"), "parent").hint("merge"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    roots = checkpointed(roots)
    roots = gathered(roots, roots.count())
    return stored(roots.join(roots.groupBy("root").agg(F.min("node").alias("component")).hint("merge"), "root").select("node", "component"), "components")


#: Rows of ``documents`` are addressed by these two columns: the id, and a hash of the text that tells apart different rows with one id.
ID, TEXT_HASH = "__sw_id", "__sw_text_hash"


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with the two key columns; rows that are equal in id and text share a key, and so every decision."""
    return docs.withColumns({ID: F.col("doc_id"), TEXT_HASH: F.xxhash64("text")})


def by_keys(docs: DataFrame, keys: DataFrame, how: str, more: Column | None = None) -> DataFrame:
    """Semi, anti or left join of ``with_keys(docs)`` to stored ``keys(ID, TEXT_HASH, ...)``; null ids match each other. ``more``: bytes of the keys' columns of no fixed size."""
    # The other way shuffles all texts, so the checked bound is wider here than elsewhere.
    right = broadcast_if_small(keys.select(*[F.col(c).alias(f"{c}_r" if c in (ID, TEXT_HASH) else c) for c in keys.columns]), 64, 4 * BROADCAST_BYTES, more)
    out = with_keys(docs).join(right, F.expr(f"{ID} <=> {ID}_r AND {TEXT_HASH} = {TEXT_HASH}_r"), how)
    return out.drop(ID, TEXT_HASH, f"{ID}_r", f"{TEXT_HASH}_r")
