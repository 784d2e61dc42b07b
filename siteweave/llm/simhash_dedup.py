"""SimHash near-duplicates through BK-trees over shards.

Fingerprints are made in Arrow batches. Distinct ones are dealt into shards by
pigeonhole keys: of five bit blocks at least three are equal in any two
fingerprints that differ in two bits, so each goes to ten shards and every link
lies in one of them. Each shard grows a BK-tree, children keyed by their integer
Hamming distance to the parent, and a lookup follows only edges within the radius
of its own distance. A shard links a fingerprint to the groups it meets and emits
one edge per join, never all pairs. Shards travel by shuffle instead of
broadcast, as the trees of a whole corpus have no size bound.

Cases: null and empty texts have fingerprint zero and link like any other; null
ids never name a group (a group of null ids only has a null component); repeated
rows get a row each; an empty table gives an empty result; other columns are
ignored. Long texts are hashed in pieces of bounded size.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ID, TEXT_HASH, broadcast_if_small, by_keys, checkpointed, connected_components, map_arrow, stored

RADIUS, SHINGLE, SEED = 2, 3, 42
PIECE = 1 << 16
#: Bits of the five blocks, from the highest.
BLOCKS = (13, 13, 13, 13, 12)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the text's 3-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    last = ends[min(SHINGLE, len(words)) - 1 :]
    n, votes, hash64 = len(last), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        h = np.array([hash64(line[a : b - 1], SEED) for a, b in zip(starts[i : i + PIECE], last[i : i + PIECE], strict=False)], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(ID, TEXT_HASH, fp)`` for every row; fp is the fingerprint as a signed long."""
    schema = pa.schema([(ID, pa.int64()), (TEXT_HASH, pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(fps)], schema=schema)

    return map_arrow(docs.select("doc_id", F.xxhash64("text"), "text"), run, f"{ID} long, {TEXT_HASH} long, fp long")


def shard_keys(fp: str = "fp"):
    """The ten pigeonhole keys of a fingerprint: which three blocks, and their bits."""
    parts, low = [], 64
    for bits in BLOCKS:
        low -= bits
        parts.append(F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << bits) - 1)))
    keys = []
    for n, (a, b, c) in enumerate(combinations(range(5), 3)):
        key = F.shiftleft(parts[a], 26).bitwiseOR(F.shiftleft(parts[b], 13)).bitwiseOR(parts[c])
        keys.append(key.bitwiseOR(F.lit(n << 40)))
    return F.array(*keys)


class BKTree:
    """Burkhard-Keller tree of 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indexes of the nodes within ``radius``; only edges that can lead there are followed."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            i = todo.pop()
            own, children = self.nodes[i]
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(i)
            todo += [children[k] for k in range(max(d - radius, 0), d + radius + 1) if k in children]
        return found

    def add(self, value: int) -> int:
        self.nodes.append((value, {}))
        i, new = 0, len(self.nodes) - 1
        while new:
            own, children = self.nodes[i]
            d = (own ^ value).bit_count()
            if d not in children:
                children[d] = new
                break
            i = children[d]
        return new


def shard_edges(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join the groups of one shard's fingerprints: fewer than there are values."""
    tree, parent, edges = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for v in values:
        near = tree.near(v, radius)
        new = tree.add(v)
        parent.append(new)
        for i in near:
            if (a := root(i)) != (b := root(new)):
                parent[max(a, b)] = min(a, b)
                edges.append((tree.nodes[i][0], v))
    return edges


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: edges between distinct fingerprints that connect all within ``radius`` of each other."""
    if radius > 2:
        raise ValueError("five blocks give whole results for a radius of at most 2")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    mask = (1 << 64) - 1

    def run(batches):
        key, held, out = None, [], []

        def close():
            if len(held) > 1:
                out.extend(shard_edges(held, radius))

        def batch():
            u = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], schema=schema)

        for b in batches:
            keys, values = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j == i:
                    continue
                if keys[i] != key:
                    close()
                    key, held = keys[i], []
                held.extend(int(x) & mask for x in values[i:j])
            if len(out) > 1 << 16:
                yield batch()
        close()
        if out:
            yield batch()

    dealt = distinct.select(F.explode(shard_keys()).alias("key"), "fp")
    # All keys are sorted and handed to Python, also those met once, which give no edge.
    return map_arrow(dealt.repartition("key").sortWithinPartitions("key", "fp"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(ID, TEXT_HASH, fp, group, component_id)``: one row per row of ``docs``, with a fingerprint that stands for its group and the group's smallest id."""
    prints = stored(fingerprints(docs), "fingerprints")
    least = checkpointed(prints.groupBy("fp").agg(F.min(ID).alias("least")))
    groups = connected_components(links(least.select("fp"), radius))
    groups = groups.select(F.col("node").alias("fp"), F.col("component").alias("group"))
    named = least.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    best = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(best, "group").select("fp", "group", "component_id")
    return prints.join(named, "fp").select(ID, TEXT_HASH, "fp", "group", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id (null ids last, then the smallest text hash); columns as in ``docs``.

    Ids do not make a group: rows of one id, or of none, stay apart unless their texts are alike.
    """
    found = near_duplicates(docs)
    key = F.struct(F.col(ID).isNull().alias("n"), ID, TEXT_HASH)
    found = checkpointed(found.select("group", ID, TEXT_HASH))
    first = checkpointed(found.groupBy("group").agg(F.min(key).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"))
    # Those that go are fewer than those that stay, so they are what the texts are joined with.
    lost = found.join(broadcast_if_small(first, 64), "group").where(~key.eqNullSafe(F.col("first"))).select(ID, TEXT_HASH).distinct()
    kept = by_keys(docs, checkpointed(lost), "left_anti").select(docs.columns)
    # Rows equal in id and text share a key, so none of them was lost to the other.
    twice = checkpointed(found.groupBy(ID, TEXT_HASH).count().where("count > 1").select(ID, TEXT_HASH))
    if twice.isEmpty():
        return kept
    return by_keys(kept, twice, "left_anti").select(docs.columns).unionByName(by_keys(kept, twice, "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
