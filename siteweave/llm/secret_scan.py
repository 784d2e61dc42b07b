"""Secret scanning with corpus-wide ownership frequency.

Three base patterns find assignments, access keys and hexadecimal runs. Further
opaque strings are only candidates: every candidate's value is hashed, and its
distinct owners and repositories are counted over the whole corpus. A value seen
with few owners looks like a live credential of theirs and adds a span; one that
many owners carry is a copied example. Base spans always stay, and are counted as
live or copied by the same rule.

Cases: a null text is empty; a null repository counts as one unnamed repository;
null ids and repeated rows are kept, one row each; an empty table gives an empty
result; other columns are ignored; a named column that is not there is an error.
Texts are searched whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, checkpointed, map_arrow, stored

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Candidates of the method: long opaque strings with a digit and both cases.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
ENTROPY = 3.5
#: At most so many owners, and so many repositories, for a value to count as live.
OWNERS, REPOSITORIES = 2, 3


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the base patterns, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of opaque strings that overlap no base span. Both are in order, so each is passed once."""
    out, at, reach = [], 0, 0
    for m in OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][2]), at + 1
        v = m[0]
        if reach <= m.start() and re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v) and entropy(v) >= ENTROPY:
            out.append((m.start(), 3, m.end(), v))
    return out


def text_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(spans))


def scan(docs: DataFrame, repository: str | Column = "source", owner: str | Column | None = None) -> DataFrame:
    """Per row: base counts and digest, live and copied candidates, and all spans.

    ``repository`` and ``owner`` are columns, or their names; without ``owner`` it is the part of the repository before the first slash.
    """
    repo = (F.col(repository) if isinstance(repository, str) else repository).cast("string")
    own = F.substring_index(repo, "/", 1) if owner is None else (F.col(owner) if isinstance(owner, str) else owner).cast("string")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", repo.alias("repo"), own.alias("owner"), "text")
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string())])

    def run(batches):
        for b in batches:
            counts, sha, spans = ([], [], []), [], []
            for t in b.column(4):
                text = t.as_py() or ""
                own = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in own))
                sha.append(hashlib.sha256(text_spans(own).encode()).hexdigest())
                spans.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for s, k, e, v in [*own, *opaque_spans(text, own)]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.list_(span))], names=["rid", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(map_arrow(base, run, f"rid long, doc_id {kind}, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start: long, kind: int, end: long, hash: string>>"), "secrets")
    each = found.where(F.size("spans") > 0).select("rid", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"), F.explode("spans").alias("s"))
    seen = each.select(F.col("s.hash").alias("hash"), "repo", "owner").distinct()
    # Two counts of distinct values as two plain aggregations: each combines map-side, so a string that a third of all documents carry is no hot group.
    repos = seen.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    owners = seen.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    status = checkpointed(repos.join(owners, "hash").select("hash", ((F.col("n_owners") <= OWNERS) & (F.col("n_repos") <= REPOSITORIES)).alias("live")))
    judged = each.select("rid", "s", F.col("s.hash").alias("hash")).join(broadcast_if_small(status, 80), "hash")
    kept = (F.col("s.kind") < 3) | F.col("live")
    item = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    per_row = judged.groupBy("rid").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.array_sort(F.collect_list(F.when(kept, item))).alias("all"))
    name = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = found.drop("spans").join(per_row.select("rid", "n_live", "n_copied", text.alias("spans")), "rid", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
