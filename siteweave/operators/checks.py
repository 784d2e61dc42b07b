"""The catalogue of checks. Each returns observation rows; see ``context``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from .. import rules
from ..functions.text import https_schema, short_iri
from ..functions.url import canonicalise_col, path_of
from ..session import checkpointed
from .context import Context, full, rows

CHECKS: dict[str, tuple[str, Callable[[Context], DataFrame]]] = {}
ALL = "site"


def check(name: str, severity: str):
    def add(f):
        CHECKS[name] = (severity, f)
        return f

    return add


# ---- syntax
def _errors(c: Context) -> DataFrame:
    e = c.pages.select("site", "page_id", F.explode("errors").alias("e")).where(F.col("e").rlike(r"^ld-block-\d+: "))
    return e.withColumn("message", F.regexp_extract("e", r"(?s)^ld-block-\d+: (.*)$", 1))


@check("syntax.malformed-json", "error")
def malformed(c):
    e = _errors(c).where(~F.col("message").startswith("remote context refused"))
    kind = F.when(F.col("message").startswith("the block "), "parse").otherwise("expand")
    return rows(e, kind, kind, "message")


@check("syntax.unresolvable-context", "error")
def contexts(c):
    e = _errors(c).where(F.col("message").startswith("remote context refused"))
    to = F.regexp_extract("message", r"refused: (\S+?)\.*$", 1)
    return rows(e, to, to, to, pattern=F.lit("context"))


# ---- entity
def is_functional(prop):
    """A property of the vocabulary, by its whole address in either spelling, that has one value."""
    return https_schema(prop).isin(*["https://schema.org/" + p for p in rules.FUNCTIONAL])


def _value_keys(c: Context) -> DataFrame:
    """Every observation of an entity and property, with its values as one key."""
    own = ["site", "page_id", "node_ord", "node_id"]
    # A value's node need not be asked for a property: that value is one.
    v = c.dealt(c.values.select(*own, "prop", "denoted"), *own).join(c._entities.select(*own), own, "left_semi")
    return v.groupBy("site", "node_id", "page_id", "node_ord", "prop").agg(F.to_json(F.array_sort(F.collect_list("denoted"))).alias("value_key"))


def verdicts(c: Context, prop: str | None = None) -> DataFrame:
    """Per entity and property (or for ``prop`` alone): value buckets, carriers, observations and the verdict."""
    obs = c.groups.groupBy("site", "node_id").agg(F.count("*").alias("n_obs")).where("n_obs >= 2")
    per = _value_keys(c) if prop is None else _value_keys(c).where(F.col("prop") == prop)
    # Buckets first, with their carriers: what equal values share is added up before it is dealt.
    each = per.groupBy("site", "node_id", "prop", "value_key").agg(F.count("*").alias("n"))
    buckets = each.groupBy("site", "node_id", "prop").agg(F.count("*").alias("n_buckets"), F.sum("n").alias("n_carriers"))
    functional = is_functional(F.col("prop"))
    scoped = (F.col("n_buckets") >= 5) & (F.col("n_buckets") >= 0.9 * F.col("n_obs"))
    verdict = F.when((F.col("n_buckets") == 1) & (F.col("n_carriers") < F.col("n_obs")), "partiality").when(F.col("n_buckets") == 1, "consistent").when(~functional, "multi-valued").when(scoped, "page-scoped").otherwise("contradiction")
    return buckets.join(obs, ["site", "node_id"]).withColumn("verdict", verdict)


def contradictions(c: Context) -> DataFrame:
    """``verdicts`` with every observation. Divergence under one id is what matters; absence is not."""
    return _value_keys(c).join(verdicts(c), ["site", "node_id", "prop"])


def _divergent(c: Context, verdict: str, pattern=None) -> DataFrame:
    d = contradictions(c).where(F.col("verdict") == verdict)
    return rows(d, F.concat_ws("|", "node_id", "prop"), "node_id", "value_key", "prop", pattern)


@check("entity.contradiction", "error")
def contradiction(c):
    return _divergent(c, "contradiction", short_iri(F.col("prop")))


@check("entity.page-scoped-value", "error")
def page_scoped(c):
    return _divergent(c, "page-scoped")


def _type_sets(c: Context, conflict: bool) -> DataFrame:
    t = c.groups.select("site", "node_id", "page_id", F.array_sort("types").alias("types")).where(F.size("types") > 0).withColumn("set", F.array_join("types", " "))
    sets = t.select("site", "node_id", "set", F.explode("types").alias("iri")).distinct().withColumn("type", short_iri(F.col("iri"))).join(c.closure, "type", "left")
    sets = sets.groupBy("site", "node_id", "set").agg(F.collect_set(F.coalesce("ancestor", "type")).alias("up"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.site") == F.col("b.site")) & (F.col("a.node_id") == F.col("b.node_id")) & (F.col("a.set") < F.col("b.set")))
    clash = (F.size(F.array_except("a.up", "b.up")) > 0) & (F.size(F.array_except("b.up", "a.up")) > 0)
    bad = pairs.groupBy("a.site", "a.node_id").agg(F.bool_or(clash).alias("conflict")).where(F.col("conflict") == conflict)
    return rows(t.join(bad, ["site", "node_id"]), "node_id", "node_id", "set")


@check("entity.type-narrowing", "opportunity")
def narrowing(c):
    return _type_sets(c, False)


@check("entity.type-conflict", "error")
def type_conflict(c):
    return _type_sets(c, True)


@check("entity.multi-value", "warning")
def multi_value(c):
    v = c.values.where(is_functional(F.col("prop")))
    many = v.groupBy("site", "page_id", "node_ord", "node_id", "prop").agg(F.count_distinct("denoted").alias("k")).where("k >= 2").drop("k")
    return rows(v.join(many, many.columns, "left_semi"), F.concat_ws("|", "node_id", "prop"), "node_id", "denoted", "prop", short_iri(F.col("prop")))


# ---- graph
URL_VALUED = ("url", "image", "sameAs", "logo", "contentUrl", "thumbnailUrl", "embedUrl", "mainEntityOfPage", "target", "availability", "itemCondition", "license", "item", "additionalType")


def references(c: Context, any_position: bool = True) -> DataFrame:
    v = c.raw_values.where(F.col("kind").isin("id", "list") & F.col("text").rlike(r"^(?:_:|[A-Za-z][A-Za-z0-9+.-]*:)"))
    return (v if any_position else v.where(~short_iri(F.col("prop")).isin(*URL_VALUED))).select("site", "page_id", F.col("text").alias("node_id"))


@check("graph.dangling-reference", "warning")
def dangling(c):
    r = references(c, False).where(~F.col("node_id").startswith("_:") & F.col("node_id").contains("#"))
    return rows(r.join(c.index.select("site", "node_id"), ["site", "node_id"], "left_anti").withColumn("page_id", F.lit(None).cast("string")), "node_id", "node_id", F.lit(None).cast("string"))


#: Up to so many links of an entity are held beside each; of one name and link, so many entities are one task's.
FEW_LINKS, CELL = 64, 4096


def fracture_pairs(c: Context, few: int = FEW_LINKS, cell: int = CELL) -> DataFrame:
    """``(site, x, y, name)``: two entities ``x < y`` of one name and one link whose types do not clash; each pair and name once.

    There may be as many as the square of a group, so what judges a pair is joined to both sides before, and the pairs are made
    last and not shuffled: one that shares several links counts under the least of them. Only the pairs of entities with more
    than ``few`` links are made distinct. A group of more than ``cell`` entities is dealt to several tasks.
    """
    v = c.values.join(c.groups.select("site", "node_id").distinct(), ["site", "node_id"], "left_semi")
    name = v.where(full("name") & (F.col("kind") == "literal")).select("site", "node_id", F.lower(F.trim("text")).alias("name")).where("name <> ''").distinct()
    link = v.where((full("url") | full("sameAs")) & (F.col("kind") == "id")).select("site", "node_id", F.col("text").alias("to")).where("to IS NOT NULL").distinct()
    up = c.typed.groupBy("site", "node_id").agg(F.array_sort(F.collect_set("ancestor")).alias("up"))
    counted = link.groupBy("site", "node_id").agg(F.count("*").alias("k"))
    links = link.join(counted.where(F.col("k") <= few), ["site", "node_id"], "left_semi").groupBy("site", "node_id").agg(F.array_sort(F.collect_list("to")).alias("links"))
    # Both equalities key the self-join: a common name alone never brings two entities together.
    n = name.join(link, ["site", "node_id"]).join(up, ["site", "node_id"]).join(links, ["site", "node_id"], "left")
    large = n.groupBy("site", "name", "to").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells")).where("cells > 1")
    n = n.join(large, ["site", "name", "to"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    at = n.withColumn("cell", F.pmod(F.xxhash64("node_id"), F.col("cells")).cast("int"))
    by = n.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("site", "name", "to", "cell")]
    clash = (F.col("a.up") != F.col("b.up")) & (F.size(F.array_except("a.up", "b.up")) > 0) & (F.size(F.array_except("b.up", "a.up")) > 0)
    least = (F.size("a.links") == 1) | (F.size("b.links") == 1) | (F.col("a.to") == F.array_min(F.array_intersect("a.links", "b.links")))
    shape = [F.col("a.site").alias("site"), F.least("a.node_id", "b.node_id").alias("x"), F.greatest("a.node_id", "b.node_id").alias("y"), F.col("a.name").alias("name")]
    once = at.where("links IS NOT NULL").alias("a").join(by.where("links IS NOT NULL").alias("b"), same).where(F.col("a.node_id") < F.col("b.node_id")).where(~clash & least).select(*shape)
    repeated = at.alias("a").join(by.where("links IS NULL").alias("b"), same).where(F.col("a.node_id") != F.col("b.node_id")).where(~clash).select(*shape).distinct()
    return once.unionByName(repeated)


@check("graph.identity-fracture", "error")
def fracture(c):
    obs = fracture_pairs(c).select("site", "x", "y", "name", F.explode(F.array("x", "y")).alias("node_id")).join(c.groups.select("site", "node_id", "page_id"), ["site", "node_id"])
    tail = lambda k: F.regexp_extract(k, "#(.*)$", 1)
    return rows(obs, F.concat_ws("|", "x", "y"), "name", "node_id", pattern=F.array_join(F.array_sort(F.array(tail("x"), tail("y"))), " vs "))


@check("graph.relative-id", "warning")
def relative_id(c):
    return rows(c.nodes.where(F.col("raw_id").startswith("#")), "raw_id", "raw_id", "node_id")


def _named_types(df: DataFrame, c: Context) -> DataFrame:
    return df.join(c.index.select("site", "node_id", F.array_join(F.array_sort(F.transform("types", short_iri)), ", ").alias("kind_names")), ["site", "node_id"])


def _with(c: Context, *ancestors: str) -> DataFrame:
    return c.typed.where(F.col("ancestor").isin(*ancestors)).select("site", "node_id").distinct()


@check("graph.orphan-node", "opportunity")
def orphan(c):
    has = c.raw_values.where("prop IS NOT NULL").select("site", "node_id").distinct()
    n = c.nodes.where(F.size("types") > 0).join(has, ["site", "node_id"], "left_semi").join(references(c).select("site", "node_id"), ["site", "node_id"], "left_anti")
    n = n.where(~F.arrays_overlap(F.transform("types", short_iri), F.array(*map(F.lit, ("WebPage", "WebSite", "BreadcrumbList"))))).join(_with(c, "StructuredValue", "Offer", "Rating"), ["site", "node_id"], "left_semi")
    return rows(_named_types(n, c), "kind_names", "kind_names", "node_id", pattern=F.lit("orphan"))


@check("graph.blank-node-entity", "opportunity")
def blank_entity(c):
    n = c.nodes.where("is_blank").join(_with(c, "Organization", "Person", "Product"), ["site", "node_id"], "left_semi")
    named = c.raw_values.where(full("name") & (F.trim("text") != "")).select("site", "node_id", F.col("text").alias("name"))
    has = c.raw_values.where("prop IS NOT NULL").select("site", "node_id").distinct()
    return rows(_named_types(n.join(has, ["site", "node_id"], "left_semi").join(named, ["site", "node_id"], "left"), c), "kind_names", "kind_names", "name", pattern=F.lit("blank"))


# ---- value
def placeholder_class(text):
    """The first class whose rule fits the trimmed text, or null."""
    out, t = None, F.trim(text)
    for label, p in rules.PLACEHOLDERS:
        hit = t.rlike("(?i)" + p)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(t != "", out)


@check("value.placeholder", "error")
def placeholder(c):
    v = c.index_values.where(F.col("kind").isin("literal", "id")).withColumn("label", placeholder_class(F.col("text"))).where("label IS NOT NULL")
    return rows(v, F.concat_ws("|", "prop", F.lower(F.trim("text"))), "label", "text", "prop", F.lit("placeholder"))


@check("value.empty", "error")
def empty(c):
    return rows(c.index_values.where((F.col("kind") == "literal") & (F.trim("text") == "")), "prop", "prop", "node_id", "prop", F.lit("empty"))


# ---- url
@check("url.canonical-mismatch", "warning")
def canonical_mismatch(c):
    p = c.pages.where("declared_canonical IS NOT NULL").withColumns({"own": canonicalise_col("canonical_url"), "said": canonicalise_col("declared_canonical")}).where("own <> said")
    host = lambda k: F.split_part(k, F.lit("/"), F.lit(3))
    kind = F.when(host("own") != host("said"), "different host").when(F.split_part("own", F.lit("?"), F.lit(1)) == F.split_part("said", F.lit("?"), F.lit(1)), "query string").otherwise("path")
    return rows(p, "own", "own", "said", pattern=kind)


def _on_site(host, site_host):
    bare = F.regexp_replace(site_host, r"^www\.", "")
    return (host == bare) | (host == F.concat(F.lit("www."), bare)) | host.endswith(F.concat(F.lit("."), bare))


@check("url.insecure-self-reference", "warning")
def insecure(c):
    secure = c.pages.where(F.col("canonical_url").startswith("https://")).select("site").distinct()
    v = c.index_values.where((F.col("kind") == "id") & F.col("text").startswith("http://")).join(secure, "site", "left_semi").join(c.site_host, "site")
    return rows(v.where(_on_site(F.lower(F.split_part("text", F.lit("/"), F.lit(3))), F.col("site_host"))), "text", "text", "node_id", "prop", F.lit("insecure"))


@check("url.foreign-media-host", "warning")
def foreign_media(c):
    v = c.index_values.where((F.col("kind") == "id") & short_iri(F.col("prop")).isin(*rules.MEDIA_PROPERTIES)).withColumn("host", F.lower(F.regexp_extract("text", r"^https?://([^/?#:]+)", 1))).where("host <> ''").join(c.site_host, "site")
    known = F.lit(False)
    for h in rules.MEDIA_HOSTS:
        known = known | (F.col("host") == h) | F.col("host").endswith("." + h)
    return rows(v.where(~_on_site(F.col("host"), F.col("site_host")) & ~known), "host", "host", "text", "prop")


@check("url.trailing-slash-drift", "opportunity")
def slash_drift(c):
    ids = c.nodes.where("NOT is_blank").select("site", F.col("node_id").alias("u")).union(c.raw_values.where("kind = 'id'").select("site", F.col("text").alias("u"))).distinct()
    u = ids.withColumn("u", canonicalise_col("u")).where(F.col("u").isNotNull() & ~F.col("u").rlike(r"^https?://[^/]+/$")).distinct()
    u = u.withColumn("base", F.regexp_replace("u", r"/+(\?|$)", "$1"))
    drift = u.groupBy("site", "base").agg(F.count("*").alias("k")).where("k > 1")
    return rows(u.join(drift, ["site", "base"], "left_semi").withColumn("page_id", F.lit(None).cast("string")), F.lit(ALL), F.lit(ALL), "base")


# ---- breadcrumb
def trails(c: Context) -> DataFrame:
    """Crumbs ``(site, page_id, trail, pos, url)`` in order, without those that have no URL."""
    b = c.nodes.where(F.exists("types", lambda t: short_iri(t) == "BreadcrumbList")).select("site", "page_id", "page_ord", "node_ord", "node_id")
    e = b.join(c.raw_values.where(full("itemListElement")).select("site", "page_id", "node_ord", "val_ord", F.col("text").alias("item_node")), ["site", "page_id", "node_ord"])
    iv = c.index_values
    pick = lambda p, name: iv.where(full(p)).groupBy("site", F.col("node_id").alias("item_node")).agg(F.min_by("text", "val_ord").alias(name))
    e = e.join(pick("position", "position"), ["site", "item_node"], "left").join(pick("item", "item"), ["site", "item_node"], "left")
    e = e.join(pick("url", "inner").withColumnRenamed("item_node", "item"), ["site", "item"], "left")
    at = Window.partitionBy("site", "page_id", "node_ord").orderBy(F.asc_nulls_last(F.expr("try_cast(position AS double)")), "val_ord")
    last = Window.partitionBy("site", "page_id", "node_ord")
    e = e.withColumns({"pos": F.row_number().over(at), "n": F.count("*").over(last)}).join(c.pages.select("site", "page_id", "canonical_url"), ["site", "page_id"])
    raw = F.when(F.col("item").startswith("_:"), F.col("inner")).otherwise(F.col("item"))
    e = e.withColumn("url", canonicalise_col(F.when(raw.isNull() & (F.col("pos") == F.col("n")), F.col("canonical_url")).otherwise(raw)))
    return e.where("url IS NOT NULL").select("site", "page_id", "page_ord", F.concat_ws("/", "page_id", "node_ord").alias("trail"), "pos", "url")


def parent_edges(crumbs: DataFrame) -> DataFrame:
    """Each crumb with the one before it in its trail."""
    w = Window.partitionBy("site", "trail").orderBy("pos")
    return crumbs.withColumns({"parent": F.lag("url").over(w), "depth": F.row_number().over(w)})


@check("breadcrumb.cycle", "error")
def cycle(c):
    t = trails(c)
    own = t.groupBy("site", "trail", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))
    own = own.where(F.size(F.array_distinct("urls")) < F.size("urls")).withColumn("path", F.array_join("urls", " > "))
    inside = rows(own, "path", "path", "path", pattern=F.lit("cycle"))
    e = parent_edges(t).where("parent IS NOT NULL AND parent <> url")
    first = e.groupBy("site", F.col("url").alias("child")).agg(F.min_by("parent", F.struct("page_ord", "trail", "pos")).alias("up"), F.min("page_id").alias("page_id"))
    # Each child has one parent: after 2^k >= n steps by pointer doubling, who still has an ancestor is led to a loop, and these ancestors are the loops.
    most = first.groupBy("site").count().agg(F.max("count")).first()[0] or 0
    walk = checkpointed(first.select("site", F.col("child").alias("start"), F.col("up").alias("at"), F.col("child").alias("least")))
    for _ in range(max(most - 1, 0).bit_length()):
        step = walk.select("site", F.col("start").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        walk = checkpointed(walk.join(step, ["site", "at"]).select("site", "start", F.col("next").alias("at"), F.least("least", "other").alias("least")))
    on = walk.join(walk.select("site", F.col("at").alias("start")).distinct(), ["site", "start"], "left_semi").select("site", "start", "least")
    named = on.groupBy("site", "least").agg(F.array_join(F.array_sort(F.collect_set("start")), " > ").alias("loop"))
    loops = on.join(named, ["site", "least"]).join(first.select("site", F.col("child").alias("start"), "page_id"), ["site", "start"])
    return inside.unionByName(rows(loops, "loop", "loop", "start"))


@check("breadcrumb.multiple-parents", "warning")
def multiple_parents(c):
    t = trails(c)
    e = parent_edges(t).where("parent IS NOT NULL AND parent <> url")
    many = e.groupBy("site", "url").agg(F.count_distinct("parent").alias("k")).where("k >= 2")
    crowded = t.groupBy("site", "page_id").agg(F.count_distinct("trail").alias("n_trails"))
    e = e.join(many, ["site", "url"]).join(crowded, ["site", "page_id"])
    rival = e.groupBy("site", "url").agg(F.bool_or(F.col("n_trails") > 1).alias("rival"))
    return rows(e.join(rival, ["site", "url"]), "url", "url", "parent", pattern=F.when(F.col("rival"), "competing").otherwise("across pages"))


@check("breadcrumb.broken-trail-item", "warning")
def broken_item(c):
    p = c.pages.select("site", F.col("canonical_url").alias("url"), "http_status").where("http_status IS NOT NULL AND http_status <> 200").distinct()
    return rows(trails(c).join(p, ["site", "url"]), "url", "url", "http_status", pattern=F.col("http_status"))


@check("breadcrumb.inconsistent-depth", "opportunity")
def depth(c):
    e = parent_edges(trails(c))
    per = e.groupBy("site", "url").agg(F.count_distinct("depth").alias("d"), F.count_distinct(F.when(F.col("parent") != F.col("url"), F.col("parent"))).alias("p"))
    twice = e.groupBy("site", "trail", "url").agg(F.count("*").alias("k")).where("k > 1").select("site", "url").distinct()
    return rows(e.join(per.where("d >= 2 AND p <= 1"), ["site", "url"], "left_semi").join(twice, ["site", "url"], "left_anti"), "url", "url", "depth", pattern=F.lit("depth"))


@check("breadcrumb.missing", "opportunity")
def breadcrumb_missing(c):
    t = trails(c)
    ok = c.pages.where("http_status = 200").select("site", "page_id", F.col("canonical_url").alias("url"))
    with_trail = t.select("site", "page_id").distinct()
    placed = parent_edges(t).where("parent IS NOT NULL").groupBy("site", "url").agg(F.max_by("parent", F.struct("page_ord", "trail", "pos")).alias("parent"))
    bare = ok.join(placed, ["site", "url"]).join(with_trail, ["site", "page_id"], "left_anti")
    above = ok.join(with_trail, ["site", "page_id"], "left_semi").select("site", F.col("url").alias("parent"))
    found = bare.join(above, ["site", "parent"], "left_semi")
    return rows(found.where(F.lit(not c.partial)), F.lit(ALL), F.lit(ALL), "url")


# ---- rich results
def gaps(c: Context) -> DataFrame:
    """``(site, page_id, node_id, type, level, field)``: clauses that a visited observation does not meet, depth four at most."""
    clause = [(t, level, "|".join(fields)) for t, (_, req, one, unless, rec, rec_one, _) in rules.RICH.items() for level, group in (("required", [[f] for f in req]), ("one-of", [one] if one else []), ("unless-referenced", [[f] for f in unless]), ("recommended", [[f] for f in rec]), ("recommended", [rec_one] if rec_one else [])) for fields in group]
    clauses = F.broadcast(c.spark.createDataFrame(clause, "rule string, level string, fields string"))
    follow = F.broadcast(c.spark.createDataFrame([(t, f) for t, r in rules.RICH.items() for f in r[6]] or [("", "")], "rule string, f string"))
    size = {t: len(rules.ancestors(t)) for t in rules.RICH}
    kinds = F.broadcast(c.spark.createDataFrame([(t, r[0] == 1, size[t]) for t, r in rules.RICH.items()], "rule string, entry boolean, size int"))
    best = c.typed.join(kinds, c.typed["ancestor"] == kinds["rule"]).groupBy("site", "node_id").agg(F.max_by(F.struct("rule", "entry"), F.struct("size", "rule")).alias("r")).select("site", "node_id", "r.rule", "r.entry")
    visit = c.nodes.select("site", "page_id", "node_id").join(best.where("entry").select("site", "node_id", "rule"), ["site", "node_id"])
    visit = visit.select("site", "page_id", "node_id", "rule", F.array("node_id").alias("path"))
    edges = c.index_values.where(F.col("kind").isin("id", "list")).select("site", "node_id", short_iri(F.col("prop")).alias("f"), F.col("text").alias("to"))
    seen, level = visit, visit
    for _ in range(4):
        nxt = level.join(follow, "rule").join(edges, ["site", "node_id", "f"]).where(~F.array_contains("path", F.col("to"))).select("site", "page_id", F.col("to").alias("node_id"), "path")
        level = nxt.join(best.select("site", "node_id", "rule"), ["site", "node_id"]).select("site", "page_id", "node_id", "rule", F.concat("path", F.array("node_id")).alias("path"))
        seen = seen.unionByName(level)
    own = c.index_values.where("prop IS NOT NULL").select("site", "node_id", short_iri(F.col("prop")).alias("f"), "text")
    nested = own.join(own.select("site", F.col("node_id").alias("text"), F.col("f").alias("g")), ["site", "text"]).select("site", "node_id", F.concat_ws(".", "f", "g").alias("f"))
    present = own.select("site", "node_id", "f").union(nested).groupBy("site", "node_id").agg(F.collect_set("f").alias("has"))
    referenced = references(c).select("site", "node_id").distinct().withColumn("referenced", F.lit(True))
    g = seen.join(clauses, "rule").join(present, ["site", "node_id"], "left").join(referenced, ["site", "node_id"], "left")
    met = F.coalesce(F.arrays_overlap("has", F.split("fields", r"\|")), F.lit(False)) | ((F.col("level") == "unless-referenced") & F.coalesce("referenced", F.lit(False)))
    return g.where(~met).select("site", "page_id", "node_id", F.col("rule").alias("type"), "level", "fields")


def _gap(c: Context, *levels: str) -> DataFrame:
    g = gaps(c).where(F.col("level").isin(*levels))
    return rows(g, F.concat_ws("|", "type", "fields"), "type", "node_id", "fields", F.col("type"))


@check("google.missing-required", "error")
def missing_required(c):
    return _gap(c, "required", "unless-referenced")


@check("google.incomplete-alternative", "error")
def incomplete_alternative(c):
    return _gap(c, "one-of")


@check("google.missing-recommended", "opportunity")
def missing_recommended(c):
    return _gap(c, "recommended")


# ---- robots
def _robots(c: Context) -> DataFrame:
    empty = "site string, agents array<string>, allow array<string>, disallow array<string>, sitemaps array<string>, sitemaps_found int"
    return (c.robots if c.robots is not None else c.spark.createDataFrame([], empty)).withColumn("page_id", F.lit(None).cast("string"))


@check("robots.ai-crawler-blocked", "warning")
def ai_blocked(c):
    crawlers = F.broadcast(c.spark.createDataFrame([(t.lower(), t, o, p) for t, o, p in rules.AI_CRAWLERS], "agent string, token string, operator string, purpose string"))
    g = _robots(c).where(F.array_contains("disallow", "/") & ~F.array_contains("allow", "/")).select("site", "page_id", F.explode("agents").alias("agent")).join(crawlers, "agent")
    return rows(g, "token", "token", "purpose")


@check("robots.resource-blocked", "warning")
def resource_blocked(c):
    g = _robots(c).where(F.array_contains("agents", "*")).select("site", "page_id", "allow", F.explode("disallow").alias("rule"))
    g = g.where(~F.exists("allow", lambda a: F.col("rule").startswith(a)))
    hits = F.array(*[F.when(F.col("rule").rlike(p), label) for label, p in rules.RESOURCES])
    return rows(g.withColumn("label", F.explode(hits)).where("label IS NOT NULL"), F.concat_ws("|", "label", "rule"), "label", "rule")


@check("robots.sitemap-missing", "opportunity")
def sitemap_missing(c):
    named = _robots(c).groupBy("site").agg(F.max(F.size("sitemaps")).alias("named"), F.max("sitemaps_found").alias("found")).where("named = 0 AND found >= 1").withColumn("page_id", F.lit(None).cast("string"))
    return rows(named, F.lit(ALL), F.lit(ALL), "found")


# ---- indexing
SITEMAP = "source = 'sitemap' OR source LIKE 'sitemap:%'"


@check("indexing.sitemap-dead-url", "error")
def dead(c):
    return rows(c.pages.where(SITEMAP).where("http_status >= 400 OR http_status < 200"), "http_status", "http_status", "url", pattern=F.col("http_status"))


@check("indexing.sitemap-redirects", "warning")
def redirects(c):
    return rows(c.requests.where(SITEMAP).where(F.size("redirect_chain") >= 1), F.lit(ALL), F.lit(ALL), "url")


@check("indexing.redirect-chain", "opportunity")
def chain(c):
    return rows(c.requests.where(F.size("redirect_chain") >= 2), F.lit(ALL), F.lit(ALL), "url")


def _canonicals(c: Context) -> DataFrame:
    return c.pages.where("declared_canonical IS NOT NULL").select("site", "page_id", "ord", "canonical_url", canonicalise_col("declared_canonical").alias("to")).where("to IS NOT NULL")


@check("indexing.canonical-to-redirect", "warning")
def canonical_redirect(c):
    r = c.requests.withColumn("to", canonicalise_col("url")).groupBy("site", "to").agg(F.max_by(F.struct("page_id", "redirect_chain"), F.struct("ord", "n")).alias("r"))
    return rows(_canonicals(c).join(r, ["site", "to"]).where((F.col("r.page_id") != F.col("page_id")) & (F.size("r.redirect_chain") >= 1)), F.lit(ALL), F.lit(ALL), "to")


@check("indexing.canonical-chain", "warning")
def canonical_chain(c):
    k = _canonicals(c).where("to <> canonical_url")
    return rows(k.join(k.select("site", F.col("canonical_url").alias("to"), F.col("to").alias("on")).distinct(), ["site", "to"]), F.lit(ALL), F.lit(ALL), F.concat_ws(" > ", "canonical_url", "to", "on"))


@check("indexing.duplicate-content", "warning")
def duplicate_content(c):
    p = c.pages.where("http_status = 200 AND content_sha256 IS NOT NULL AND coalesce(size(redirect_chain), 0) <= 0")
    d = p.groupBy("site", "content_sha256").agg(F.count_distinct("canonical_url").alias("k")).where("k > 1")
    return rows(p.join(d, ["site", "content_sha256"], "left_semi"), "content_sha256", "content_sha256", "canonical_url")


@check("indexing.thin-sitemap-entry", "opportunity")
def thin(c):
    return rows(c.pages.where(SITEMAP).where("http_status = 200 AND coalesce(size(redirect_chain), 0) <= 0 AND facts.extractable_words < 25"), F.lit(ALL), F.lit(ALL), "canonical_url")


def _repeats(c: Context) -> DataFrame:
    r = c.sitemap_repeats if c.sitemap_repeats is not None else c.spark.createDataFrame([], "site string, url string, from_sitemap string, first_sitemap string")
    return r.withColumn("page_id", F.lit(None).cast("string"))


@check("indexing.sitemap-duplicate-url", "opportunity")
def sitemap_duplicate(c):
    return rows(_repeats(c).where("from_sitemap = first_sitemap"), "from_sitemap", "from_sitemap", "url")


@check("indexing.sitemap-overlap", "opportunity")
def sitemap_overlap(c):
    r = _repeats(c).where("from_sitemap <> first_sitemap")
    return rows(r, F.concat_ws("|", F.least("from_sitemap", "first_sitemap"), F.greatest("from_sitemap", "first_sitemap")), F.least("from_sitemap", "first_sitemap"), "url")


# ---- link
def inbound(c: Context) -> DataFrame:
    """``(site, page_id, source_page, noindex)``: distinct pages that link to a page from elsewhere on the site."""
    links = c.links if c.links is not None else c.spark.createDataFrame([], "site string, from_page string, to_url string, internal boolean")
    p = c.pages_all
    names = p.select("site", "page_id", F.col("canonical_url").alias("to_url")).union(p.select("site", "page_id", "url")).union(p.select("site", "page_id", F.explode("aliases.url").alias("to_url"))).where("to_url IS NOT NULL").distinct()
    meta = p.select("site", F.col("page_id").alias("source_page"), F.coalesce("facts.noindex", F.lit(False)).alias("noindex"))
    e = links.where("internal").select("site", F.col("from_page").alias("source_page"), "to_url").distinct().join(names, ["site", "to_url"]).where("source_page <> page_id")
    return e.select("site", "page_id", "source_page").distinct().join(meta, ["site", "source_page"])


def _gated(c: Context) -> DataFrame:
    return c.pages.where(SITEMAP).where(F.lit(c.hop_complete and not c.partial and c.links is not None))


@check("link.orphan", "warning")
def link_orphan(c):
    return rows(_gated(c).join(inbound(c), ["site", "page_id"], "left_anti"), F.lit(ALL), F.lit(ALL), "canonical_url")


@check("link.noindex-only-inbound", "warning")
def noindex_inbound(c):
    only = inbound(c).groupBy("site", "page_id").agg(F.bool_and("noindex").alias("only")).where("only")
    return rows(_gated(c).where("NOT coalesce(facts.noindex, false)").join(only, ["site", "page_id"], "left_semi"), "canonical_url", "canonical_url", "canonical_url", pattern=F.lit("noindex"))


# ---- content and page: one filter each over known facts
def _fact(name: str, severity: str, where: str, value: str = "canonical_url", frame: str = "facts") -> None:
    check(name, severity)(lambda c: rows(getattr(c, frame).where(where), F.lit(ALL), F.lit(ALL), F.expr(value)))


_fact("content.not-extractable", "error", "(facts.has_main OR facts.has_article) AND facts.extractable_words >= 50 AND facts.main_words < 0.2 * facts.extractable_words")
_fact("content.javascript-only", "error", "facts.dom_words < 100 AND bytes >= 50000")
_fact("content.main-in-aside", "warning", "facts.aside_words >= 50 AND facts.extractable_words >= 50 AND facts.aside_words > facts.main_words")
_fact("content.hidden-text", "warning", "facts.hidden_words >= 50 AND facts.extractable_words >= 50 AND facts.hidden_words > facts.extractable_words")
_fact("content.no-landmark", "opportunity", "facts.extractable_words >= 50 AND NOT facts.has_main AND NOT facts.has_article")
_fact("page.title-missing", "error", "facts.title IS NULL")
_fact("page.h1-missing", "warning", "size(filter(facts.heading_levels, x -> x = 1)) = 0")
_fact("page.h1-multiple", "opportunity", "size(filter(facts.heading_levels, x -> x = 1)) > 1")
_fact("page.image-alt-missing", "warning", "facts.missing_alt > 0")
_fact("page.lang-missing", "opportunity", "facts.html_lang IS NULL")
_fact("coverage.no-structured-data", "opportunity", "http_status = 200 AND nodes = 0", frame="pages")


@check("page.image-alt-useless", "warning")
def alt_useless(c):
    return rows(c.facts.select("site", "page_id", F.explode("facts.suspect_alt").alias("alt")), F.lit(ALL), F.lit(ALL), "alt")


@check("page.title-duplicate", "warning")
def title_duplicate(c):
    p = c.facts.withColumn("title", F.col("facts.title")).where("title <> ''")
    d = p.groupBy("site", "title").agg(F.count("*").alias("k")).where("k > 1")
    return rows(p.join(d, ["site", "title"], "left_semi"), F.lit(ALL), F.lit(ALL), "title")


# ---- coverage
@check("coverage.competing-syntax", "opportunity")
def competing(c):
    p = c.pages.where("microdata_items > 0")
    return rows(p.select("site", "page_id", F.explode_outer("microdata_types").alias("t")), F.lit(ALL), F.lit(ALL), "t")


@check("coverage.type-gap", "opportunity")
def type_gap(c):
    parts = F.filter(F.split(path_of(F.col("canonical_url")), "/"), lambda x: x != "")
    # The index page of a section, of one part, is no member of it.
    p = c.pages.where("http_status = 200").withColumn("parts", parts).where(F.size("parts") >= 2).withColumn("segment", F.col("parts")[0]).drop("parts")
    sizes = p.groupBy("site", "segment").agg(F.count_distinct("page_id").alias("n")).where("n >= 10")
    up = c.closure.groupBy("type").agg(F.collect_set("ancestor").alias("up"))
    own = F.array(*map(F.lit, rules.SUBJECT))
    subject = up.where(F.arrays_overlap("up", own) & ~F.array_contains("up", "Action") & ~F.col("type").isin(*rules.NON_SUBJECT)).select("type")
    bare = F.regexp_replace("iri", "^https?://schema\\.org/", "")
    has = c.nodes.select("site", "page_id", F.explode("types").alias("iri")).select("site", "page_id", bare.alias("type")).distinct().join(subject, "type", "left_semi")
    member = p.join(sizes, ["site", "segment"])
    share = member.join(has, ["site", "page_id"]).groupBy("site", "segment", "type", "n").agg(F.count_distinct("page_id").alias("k")).where("k >= 0.8 * n AND k < n")
    lacking = member.drop("n").join(share, ["site", "segment"]).join(has, ["site", "page_id", "type"], "left_anti")
    return rows(lacking.where(F.lit(not c.partial)), F.concat_ws("|", "segment", "type"), "segment", "canonical_url", "type", F.col("type"))


@check("coverage.missing-expected-entity", "opportunity")
def missing_entity(c):
    ok = c.pages.where("http_status = 200").select("site").distinct()
    org = _with(c, "Organization").select("site", F.lit(True).alias("org")).distinct()
    logo = c.index_values.where(full("logo")).join(_with(c, "Organization"), ["site", "node_id"], "left_semi").select("site", F.lit(True).alias("logo")).distinct()
    same = c.index_values.where(full("sameAs")).select("site", F.lit(True).alias("same")).distinct()
    s = ok.join(org, "site", "left").join(logo, "site", "left").join(same, "site", "left")
    lack = F.array_compact(F.array(F.when(F.col("org").isNull(), "Organization"), F.when(F.col("org").isNotNull() & F.col("logo").isNull(), "logo"), F.when(F.col("same").isNull(), "sameAs")))
    return rows(s.select("site", F.lit(None).cast("string").alias("page_id"), F.explode(lack).alias("what")).where(F.lit(not c.partial)), F.lit(ALL), F.lit(ALL), "what")
