"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

The index holds one posting ``(rid, tid, pos)`` for every corpus token that is a
term of the test set, sharded by document, as Parquet in the shared folder. Each
phrase is looked up from its rarest terms on: the offset-adjusted lists of the
two rarest are intersected first, then those of all other terms, read only for
the documents that are left. A posting with term -1 holds a document's length.

Cases: null and empty texts have no words and a row of zeros; repeated rows get a
row each; null ids are kept; empty tables give empty results, an empty test set
gives zeros; test items with a null id mark words but are never named; columns
other than those named are ignored. Words are compared exactly, whatever the
length of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ID, TEXT_HASH, ascii_lower, broadcast_if_small, by_keys, checkpointed, stored

#: What lies between words, with A-Z counted as word characters (they are lower-cased later, word by word).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, ITEMS = 8, 2
LENGTH = -1


def words(text: Column) -> Column:
    """The words of a text as they are written; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, terms)``: every run of ``window`` words, or the whole item where it is shorter."""
    w = items.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("terms"))


def vocabulary(terms: DataFrame) -> DataFrame:
    """``(term, tid, fold)`` of a column ``term``; the empty term stands for the length posting."""
    found = terms.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid"), F.lower("term").alias("fold"))
    return checkpointed(found.unionByName(terms.sparkSession.createDataFrame([("", LENGTH, "")], "term string, tid long, fold string")))


def build_index(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Postings of the vocabulary's terms: ``(rid, tid, pos)``; length postings also carry the row's id and text hash."""
    tokens = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias(ID), F.xxhash64("text").alias(TEXT_HASH), words(F.col("text")).alias("w"))
    tokens = tokens.select("rid", ID, TEXT_HASH, F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    hit = tokens.withColumn("fold", F.lower("word")).join(broadcast_if_small(vocab, 120), "fold").where((F.col("word") == F.col("term")) | (ascii_lower(F.col("word")) == F.col("term")))
    end = F.col("tid") == LENGTH
    return stored(hit.select("rid", "tid", "pos", F.when(end, F.col(ID)).alias(ID), F.when(end, F.col(TEXT_HASH)).alias(TEXT_HASH)), "postings")


def query_plans(index: DataFrame, queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """``queries(wid, terms)`` to ``(wid, plan)``, the plan listing ``(n, off, tid)`` from the rarest term on; phrases with a term the corpus lacks go."""
    n = index.where(F.col("tid") != LENGTH).groupBy("tid").agg(F.count("*").alias("n"))
    each = queries.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term")).join(vocab.select("term", "tid"), "term").join(n, "tid")
    plans = each.groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("n", "off", "tid"))).alias("plan"))
    return checkpointed(plans.where(F.size("plan") == F.col("size")).select("wid", "plan"))


def exact_matches(index: DataFrame, plans: DataFrame) -> DataFrame:
    """Every occurrence ``(rid, wid, start, len)`` of a phrase, by intersecting offset-adjusted posting lists from the rarest terms on."""
    first, second = F.col("plan")[0], F.col("plan")[1]
    anchors = plans.select("wid", "plan", first["tid"].alias("tid"), first["off"].alias("off"))
    found = index.where(F.col("tid") != LENGTH).select("rid", "tid", "pos").join(broadcast_if_small(anchors, 400), "tid").select("rid", "wid", (F.col("pos") - F.col("off")).alias("start"), "plan").where("start >= 0")
    alone = found.where(F.size("plan") == 1).select("rid", "wid", "start", F.lit(1).alias("len"))
    pairs = found.where(F.size("plan") > 1).withColumns({"tid": second["tid"], "pos": F.col("start") + second["off"]}).drop("plan")
    wanted = checkpointed(plans.where(F.size("plan") > 1).select(second["tid"].alias("tid")).distinct())
    seconds = index.select("rid", "tid", "pos").join(broadcast_if_small(wanted, 16), "tid", "left_semi")
    pairs = checkpointed(pairs.join(seconds, ["rid", "tid", "pos"], "left_semi").select("rid", "wid", "start"))
    near = checkpointed(pairs.select("rid").distinct())
    lists = index.where(F.col("tid") != LENGTH).select("rid", "tid", "pos").join(broadcast_if_small(near, 16), "rid", "left_semi")
    full = pairs.join(broadcast_if_small(plans, 400), "wid")
    rest = full.where(F.size("plan") > 2).select("rid", "wid", "start", F.size("plan").alias("len"), F.explode(F.slice("plan", 3, 1 << 20)).alias("t"))
    rest = rest.select("rid", "wid", "start", "len", F.col("t.tid").alias("tid"), (F.col("start") + F.col("t.off")).alias("pos"))
    rest = rest.join(lists, ["rid", "tid", "pos"], "left_semi").groupBy("rid", "wid", "start", "len").agg(F.count("*").alias("k")).where("k = len - 2").drop("k")
    both = full.where(F.size("plan") == 2).select("rid", "wid", "start", F.lit(2).alias("len"))
    return alone.unionByName(both).unionByName(rest)


def proximity_matches(index: DataFrame, plans: DataFrame, slop: int) -> DataFrame:
    """``(rid, wid, pos)``: occurrences of a phrase's rarest term that have every other term, in any order, at most ``slop`` words away.

    Postings are joined on position blocks of ``slop`` words, each anchor looking into its own and the two blocks beside it, so no document's postings meet as pairs.
    """
    post = index.where(F.col("tid") != LENGTH).select("rid", "tid", "pos")
    anchors = plans.select("wid", F.size(F.array_distinct(F.col("plan")["tid"])).alias("need"), F.col("plan")[0]["tid"].alias("tid"), F.array_distinct(F.col("plan")["tid"]).alias("tids"))
    found = post.join(broadcast_if_small(anchors, 400), "tid").select("rid", "wid", "need", F.col("pos").alias("at"), F.explode("tids").alias("tid"))
    block = lambda c: F.floor(F.col(c) / F.lit(slop + 1))
    probes = found.withColumn("block", F.explode(F.array(block("at") - 1, block("at"), block("at") + 1)))
    near = probes.join(post.withColumn("block", block("pos")), ["rid", "tid", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    met = near.select("rid", "wid", "need", "at", "tid").distinct().groupBy("rid", "wid", "need", "at").agg(F.count("*").alias("k"))
    return met.where("k = need").select("rid", "wid", F.col("at").alias("pos"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = ITEMS) -> DataFrame:
    """Per row of ``docs``: its keys, words, words hit, and the items with an occurring window."""
    runs = checkpointed(phrases(items, window))
    queries = checkpointed(runs.select("terms").distinct().select(F.monotonically_increasing_id().alias("wid"), "terms"))
    vocab = vocabulary(queries.select(F.explode("terms").alias("term")))
    index = build_index(docs, vocab)
    found = stored(exact_matches(index, query_plans(index, queries, vocab)).distinct(), "matches")

    # Words hit: spans in order of start; each adds what lies beyond the end of those before it.
    span = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grow = lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"))
    hits = found.groupBy("rid").agg(F.aggregate(F.array_sort(F.collect_set(span)), none, grow)["n"].alias("n_hit"))
    named = checkpointed(runs.join(queries, "terms").select("wid", F.col("item_id").cast("string").alias("item")).distinct())
    ids = found.select("rid", "wid").distinct().join(broadcast_if_small(named, 64), "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    rows = index.where(F.col("tid") == LENGTH).select("rid", ID, TEXT_HASH, F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hits, "rid", "left").join(ids, "rid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    n_items = F.size("ids").cast("long")
    return out.select(ID, TEXT_HASH, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, least_items: int = ITEMS) -> DataFrame:
    """The rows of ``docs`` without windows of ``least_items`` items or more, with their columns."""
    bad = checkpointed(decontaminate(docs, items, least_items=least_items).where("contaminated").select(ID, TEXT_HASH).distinct())
    return by_keys(docs, bad, "left_anti").select(docs.columns)
