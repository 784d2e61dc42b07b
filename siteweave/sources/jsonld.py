"""A bounded JSON-LD expander for schema.org contexts, and the flattening of blocks into nodes.

Supported: string, array and object contexts made of schema.org addresses, ``@vocab``, prefixes and simple terms;
``@graph``, ``@id``, ``@type``, ``@value``, ``@language``, ``@list``, ``@set``, nested nodes, relative references and
dropped nulls. Everything else fails the block with a reason; contexts are never fetched.
"""

from __future__ import annotations

import json
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import prepare
from .html import slices

# Spellings of the schema.org context.
CONTEXTS = frozenset(f"{scheme}://{host}schema.org{end}" for scheme in ("http", "https") for host in ("", "www.") for end in ("", "/")) | {"https://schema.org/docs/jsonldcontext.json", "http://schema.org/docs/jsonldcontext.json"}
VOCAB = "http://schema.org/"
#: Properties whose plain strings are references.
REFERENCES = frozenset("url image sameAs logo contentUrl thumbnailUrl embedUrl mainEntityOfPage item potentialAction target availability itemCondition eventStatus eventAttendanceMode license hasMap discussionUrl relatedLink significantLink codeRepository additionalType".split())


class ExpansionError(ValueError):
    pass


def diagnose(body: str) -> str:
    import re

    if body.startswith("<"):
        return "the block starts with markup"
    if re.search(r",\s*[}\]]", body):
        return "the block has a trailing comma"
    return "the block is not valid JSON"


class Expander:
    def __init__(self, base: str, page_id: str, block: int) -> None:
        self.base, self.prefix = base, f"_:{page_id}/json-ld/{block}"
        self.nodes: dict[str, dict] = {}
        self.block = block

    def context(self, value, active: dict) -> dict:
        out = dict(active)
        for c in value if isinstance(value, list) else [value]:
            if c is None:
                out = {"@vocab": None, "terms": {}}
            elif isinstance(c, str):
                if c.partition("#")[0] not in CONTEXTS:
                    raise ExpansionError(f"remote context refused: {c}")
                out["@vocab"] = VOCAB
            elif isinstance(c, dict):
                terms = dict(out["terms"])
                for k, v in c.items():
                    if k == "@vocab":
                        out["@vocab"] = v
                    elif k == "@language" or k == "@base" or k == "@version":
                        out[k] = v
                    elif isinstance(v, str):
                        terms[k] = {"@id": v}
                    elif isinstance(v, dict) and set(v) <= {"@id", "@type", "@container"}:
                        terms[k] = v
                    elif v is not None:
                        raise ExpansionError(f"unsupported term definition: {k}")
                out["terms"] = terms
            else:
                raise ExpansionError("unsupported context")
        return out

    def iri(self, term: str, ctx: dict) -> str | None:
        if term in ctx["terms"]:
            target = ctx["terms"][term].get("@id", term)
            return self.iri(target, ctx | {"terms": {k: v for k, v in ctx["terms"].items() if k != term}})
        prefix, colon, rest = term.partition(":")
        if colon:
            if prefix in ctx["terms"] and not rest.startswith("//"):
                return (self.iri(prefix, ctx) or "") + rest
            return term
        return ctx["@vocab"] + term if ctx["@vocab"] else None

    def node_id(self, raw: str) -> str:
        return f"{self.prefix}/{raw[2:]}" if raw.startswith("_:") else urljoin(self.base, raw)

    def value(self, v, key: str, ctx: dict, at: str) -> list:
        if v is None:
            return []
        if isinstance(v, list):
            return [x for i, y in enumerate(v) for x in self.value(y, key, ctx, f"{at}/{i}")]
        if isinstance(v, dict):
            if "@value" in v:
                return [] if v["@value"] is None else [{k: v[k] for k in ("@value", "@type", "@language") if v.get(k) is not None}]
            if "@list" in v:
                return [{"@list": self.value(v["@list"], key, ctx, at + "/@list")}]
            if "@set" in v:
                return self.value(v["@set"], key, ctx, at + "/@set")
            if set(v) == {"@id"}:
                return [{"@id": self.node_id(str(v["@id"]))}]
            return [{"@id": self.node(v, ctx, at)}]
        kind = ctx["terms"].get(key, {}).get("@type")
        if isinstance(v, str) and (kind in ("@id", "@vocab") or kind is None and key in REFERENCES):
            return [{"@id": self.node_id(v)}]
        return [{"@value": v}]

    def node(self, obj: dict, ctx: dict, at: str) -> str:
        if "@context" in obj:
            ctx = self.context(obj["@context"], ctx)
        alias = {k: ctx["terms"][k]["@id"] for k in obj if k in ctx["terms"] and str(ctx["terms"][k].get("@id", "")).startswith("@")}
        obj = {alias.get(k, k): v for k, v in obj.items()}
        if "@reverse" in obj:
            raise ExpansionError("@reverse is not supported")
        raw = obj.get("@id")
        own = self.node_id(raw) if isinstance(raw, str) else self.prefix + at
        entry = self.nodes.setdefault(own, {"raw_id": raw if isinstance(raw, str) and own != raw and not raw.startswith("_:") else None, "types": [], "props": {}, "pointer": at})
        types = obj.get("@type", [])
        for t in types if isinstance(types, list) else [types]:
            full = self.iri(str(t), ctx)
            if full and full not in entry["types"]:
                entry["types"].append(full)
        for k, v in obj.items():
            pointer = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
            if k == "@graph":
                for i, x in enumerate(v if isinstance(v, list) else [v]):
                    if isinstance(x, dict) and set(x) != {"@id"}:
                        self.node(x, ctx, f"{pointer}/{i}")
            elif not k.startswith("@") and (full := self.iri(k, ctx)):
                got = self.value(v, k, ctx, pointer)
                if got:
                    entry["props"].setdefault(full, []).extend(got)
        return own

    def run(self, data) -> None:
        for i, x in enumerate(data if isinstance(data, list) else [data]):
            if isinstance(x, dict) and set(x) - {"@context"} != {"@id"}:
                at = f"/{i}" if isinstance(data, list) else ""
                if "@graph" in x and not set(x) - {"@graph", "@context", "@id"}:
                    ctx = self.context(x["@context"], {"@vocab": None, "terms": {}}) if "@context" in x else {"@vocab": None, "terms": {}}
                    for j, y in enumerate(x["@graph"] if isinstance(x["@graph"], list) else [x["@graph"]]):
                        if isinstance(y, dict) and set(y) != {"@id"}:
                            self.node(y, ctx, f"{at}/@graph/{j}")
                else:
                    self.node(x, {"@vocab": None, "terms": {}}, at)


def expand(page_id: str, url: str, block: int, body: str) -> tuple[list[dict], str | None]:
    """Nodes of one block, or a fault; a bad block harms no other."""
    try:
        data = json.loads(body)
    except ValueError:
        return [], f"ld-block-{block}: {diagnose(body)}"
    e = Expander(url, page_id, block)
    try:
        e.run(data)
    except (ExpansionError, RecursionError) as x:
        return [], f"ld-block-{block}: {x}"
    return [{"node_id": k, "raw_id": n["raw_id"], "is_blank": k.startswith("_:"), "types": n["types"], "props": n["props"], "block": block, "pointer": n["pointer"]} for k, n in e.nodes.items()], None


NODE_VALUES = "page_id string, page_ord long, node_ord int, node_id string, raw_id string, is_blank boolean, types array<string>, prop string, val_ord int, kind string, text string, error string"


def node_values(blocks: DataFrame, keep: str = "") -> DataFrame:
    """The long form of nodes from ``blocks(page_id, page_ord, url, block, body)``: one row per value; nodes without values have one row with a null property; faults one row with an error. ``keep`` names one more column, with its type, that every row repeats."""
    prepare(blocks.sparkSession)
    names = [c.split()[0] for c in keep.split(", ") if c]

    def run(batches):
        for batch in batches:
            # The values of a few blocks at a time, so that a worker's memory does not grow with its batches.
            for piece in slices(batch, "body"):
                rows, f = [], piece.to_pydict()
                for *also, p, o, u, b, body in zip(*(f[n] for n in [*names, "page_id", "page_ord", "url", "block", "body"]), strict=True):
                    nodes, error = expand(p, u, int(b), body)
                    if error:
                        rows.append((*also, p, o, None, None, None, None, None, None, None, None, None, error))
                    for i, n in enumerate(nodes):
                        head, any_value = (*also, p, o, int(b) * 100_000 + i, n["node_id"], n["raw_id"], n["is_blank"], n["types"]), False
                        for prop, values in n["props"].items():
                            k = 0
                            for v in values:
                                for kind, text in ([("id", v["@id"])] if "@id" in v else [("list", x.get("@id", x.get("@value"))) for x in v["@list"]] if "@list" in v else [("literal", v["@value"])]):
                                    rows.append((*head, prop, k, kind if kind != "list" else "list", text if isinstance(text, str) else json.dumps(text), None))
                                    k, any_value = k + 1, True
                        if not any_value:
                            rows.append((*head, None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(columns)], [n for n, _ in columns])

    of = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.field("element", pa.string()))}
    shape = (f"{keep}, " if keep else "") + NODE_VALUES
    columns = [(c.split()[0], of[c.split()[1]]) for c in shape.split(", ")]
    return blocks.select(*names, "page_id", "page_ord", "url", "block", "body").mapInArrow(run, shape)
