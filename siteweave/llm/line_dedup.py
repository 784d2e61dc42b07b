"""Fuzzy line deduplication (DataFrame operations only).

Lines with a character that is no white space are normalised (lower case, white
space runs to one space, trimmed) and get a SimHash of eight blocks of 16 bits.
Each word (a run of letters or digits; the whole line where it has none) votes in
one block only, chosen by its hash, so a replaced word changes two blocks at most
and the others stay equal. Blocks form two groups of three and one of two; lines
meet on each pair of blocks within a group, so three equal blocks always give a
common key. Keys that rest on too few words are left out, but every line has one.

Lines that share a key and have a like number of characters and at most ``RADIUS``
of 128 bits different are verified: their edit similarity, 1 - distance / longer
length, has to be 0.8 or more. Of each connected group the first occurrence stays,
by document id, then text hash, then line number; the others are cut out.

Large keys: in a key of more than ``SMALL`` lines only lines of like lengths meet,
in cells of about ``CELL`` by ``CELL`` lines, so that every pair is looked at and no
task holds a whole key. Of the candidate pairs of small keys each line's first is
verified, and in large keys each line with the first of its key and length; then
all those whose ends are still unconnected. For large keys these are only then
looked for, without pairs within the component most of the key's lines are in and
without short lines whose letters alone need more edits than are allowed.
So the groups are those of all candidate pairs, whatever a key's size.
Texts are only shuffled for lines in question and, to be verified, for lines in a
pair: a bitmap of hashes leaves out nearly all others before the exact join.

Votes are packed into sixteen longs of eight 8-bit counters, one for each block;
the parts of lines of more than ``PART`` words are added up in 32-bit counters.

Cases: null or empty texts and blank lines are never touched; repeated rows are
one document and get the same answer; null ids come first in the order; an empty
table gives an empty result; extra columns are carried along. A text that loses
all lines becomes empty, its row stays.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ID, TEXT_HASH, broadcast_if_small, by_keys, checkpointed, connected_components, sifted, stored, with_keys

SIMILARITY, RADIUS, SMALL, CELL, PAIRS_A_TASK = 0.8, 20, 64, 8192, 4000
BLOCKS, BITS, PART = 8, 16, 127
#: In every second byte: its lowest bit, and its seven low bits.
LOW, SEVEN = 0x0001000100010001, 0x007F007F007F007F
#: In every fourth byte: its lowest bit, all of it, and 30 bits from it on.
LOW4, BYTE4, MANY4 = 0x0000000100000001, 0x000000FF000000FF, 0x3FFFFFFF3FFFFFFF
PAIRS = [p for group in ((0, 1, 2), (3, 4, 5), (6, 7)) for p in combinations(group, 2)]
#: Sides that grow with the corpus are broadcast only where tiny, so that the plan is the same from small to large tables.
SIDE_BYTES = 256 << 10
#: Words that a key rests on, at least; short lines need fewer.
KEY_WORDS = 3
#: Words that are looked through for the next match behind a difference.
AHEAD = 16
#: Lines of up to so many characters are compared at once: matching their words would take longer.
SHORT = 128
#: Characters that are counted in short lines, up to ``COUNTED`` times each, in two longs.
LETTERS, COUNTED = ("etaonirshdlucmpg", "fbvwky0123456789"), 4
#: What is cut off at both ends of a word.
MARKS = ".,;:!?()[]{}\"'"


def normalised(line: Column) -> Column:
    """Lower case, white space runs to one space, trimmed; the pattern runs only over lines that need it."""
    low, odd = F.lower(line), line.contains("  ")
    for c in "\t\r\f\x0b":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(low, r"\s\s+|[^\S ]", " ")).otherwise(low))


def lines_of(docs: DataFrame) -> DataFrame:
    """Every line that counts: ``ID, TEXT_HASH, line, norm``."""
    each = docs.where("text IS NOT NULL").select(ID, TEXT_HASH, F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    # Filtered by the raw line: a filter on the normal form would compute that twice.
    return each.where(F.ltrim("raw", F.lit(" \t\r\f\x0b")) != "").select(ID, TEXT_HASH, "line", normalised(F.col("raw")).alias("norm"))


def line_hash(norm: Column) -> tuple[Column, Column]:
    """128 bits in two longs."""
    return F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit("second"), norm).alias("h2")


def _halves(on: list[Column]) -> tuple[Column, Column]:
    """``sim1, sim2`` of sixteen columns, of which the k-th has bit k of block b at the foot of byte b."""
    halves = []
    for part in (on[:8], on[8:]):
        out = part[0]
        for k, bits in enumerate(part[1:], 1):
            out = out.bitwiseOR(F.shiftleft(bits, k))
        halves.append(out)
    return halves[0].alias("sim1"), halves[1].alias("sim2")


def majority(votes: list[Column], n: Column) -> tuple[Column, Column]:
    """``sim1, sim2``: in byte b of the first the low eight bits of block b, in the second the high ones; a bit is set in more than half of its block's words.

    Adding 127 - n / 2 to a counter of at most 127 sets its highest bit if it is above n / 2.
    """
    side = lambda c, at: F.shiftrightunsigned(c, at).bitwiseAND(F.lit(SEVEN))  # noqa: E731  every second byte, so that none runs over into the next
    lift = [F.lit(SEVEN) - side(n, at + 1).bitwiseAND(F.lit(SEVEN >> 1 & 0x003F003F003F003F)) for at in (0, 8)]
    over = lambda v, at: F.shiftrightunsigned(side(v, at) + lift[at // 8], 7).bitwiseAND(F.lit(LOW))
    return _halves([over(v, 0).bitwiseOR(F.shiftleft(over(v, 8), 8)) for v in votes])


def simhashed(docs: DataFrame) -> DataFrame:
    """``(ID, TEXT_HASH, line, h1, h2, size, n, sim1, sim2)``, one row per line occurrence; byte b of ``n`` counts the words of block b, up to 127."""
    kept = [ID, TEXT_HASH, "line", "h1", "h2", "size"]
    each = lines_of(docs).select(F.monotonically_increasing_id().alias("lid"), ID, TEXT_HASH, "line", *line_hash(F.col("norm")), F.length("norm").alias("size"), F.split("norm", " ").alias("w"))
    words = each.select("lid", *kept, F.posexplode("w").alias("at", "w")).withColumn("h", F.xxhash64(F.btrim("w", F.lit(MARKS))))
    words = words.select("lid", *kept, "at", "h", F.expr("shiftleft(1L, 8 * cast(shiftrightunsigned(h, 61) as int))").alias("one"))
    votes = [f"v{k}" for k in range(BITS)]
    sums = [F.sum(F.col("one") * F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))).alias(v) for k, v in enumerate(votes)]
    summed = words.groupBy("lid", F.floor(F.col("at") / PART).alias("part")).agg(F.sum("one").alias("n"), F.count("*").alias("words"), *[F.max(c).alias(c) for c in kept], *sums)
    parts = F.when(F.col("words") == PART, F.array(*votes)).when(F.col("part") > 0, F.array(*votes))
    tables = stored(summed.select("lid", "part", *kept, "n", *majority([F.col(v) for v in votes], F.col("n")), parts.alias("votes")), "lines")
    out = [*kept, "n", "sim1", "sim2"]
    long = checkpointed(tables.where("part > 0").select("lid").distinct())
    if long.isEmpty():
        return tables.select(*out)
    side = broadcast_if_small(long, 16)
    several = tables.where("votes IS NOT NULL").join(side, "lid", "left_semi")
    return tables.join(side, "lid", "left_anti").select(*out).unionByName(_long_lines(several, kept).select(*out))


def _long_lines(several: DataFrame, kept: list[str]) -> DataFrame:
    """Fingerprints of lines of several parts, from their votes: 32-bit counters, of blocks i and i + 4 in one long."""
    lanes = lambda c, i: F.sum(F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(BYTE4)))
    sums = [lanes(F.col("votes")[k], i).alias(f"v{k}_{i}") for k in range(BITS) for i in range(4)] + [lanes(F.col("n"), i).alias(f"n_{i}") for i in range(4)]
    # Dealt out as they are: summed up before that, a part would have four times as many counters.
    each = several.repartition("lid").groupBy("lid").agg(*[F.max(c).alias(c) for c in kept], *sums)
    half = [F.shiftrightunsigned(f"n_{i}", 1).bitwiseAND(F.lit(MANY4)) for i in range(4)]
    over = lambda k, i: F.shiftleft(F.shiftrightunsigned(F.col(f"v{k}_{i}") + F.lit(MANY4) - half[i], 30).bitwiseAND(F.lit(LOW4)), 8 * i)
    on = [over(k, 0).bitwiseOR(over(k, 1)).bitwiseOR(over(k, 2)).bitwiseOR(over(k, 3)) for k in range(BITS)]
    n = F.lit(0).cast("long")
    for i in range(4):
        for at in (0, 32):
            count = F.shiftrightunsigned(f"n_{i}", at).bitwiseAND(F.lit(0xFFFFFFFF))
            n = n.bitwiseOR(F.shiftleft(F.least(count, F.lit(127)), 8 * i + at))
    return checkpointed(each.select(*kept, n.alias("n"), *_halves(on)))


def block(b: int) -> Column:
    """The 16 bits of block ``b``."""
    part = lambda c: F.shiftrightunsigned(c, 8 * b).bitwiseAND(F.lit(0xFF))
    return part("sim1").bitwiseOR(F.shiftleft(part("sim2"), 8))


def _words(b: int) -> Column:
    """The words of block ``b``."""
    return F.shiftrightunsigned("n", 8 * b).bitwiseAND(F.lit(0xFF))


def least_words() -> Column:
    """The words that a key of the line has to rest on."""
    return F.least(F.lit(KEY_WORDS), F.greatest(F.lit(1), F.floor(sum((_words(b) for b in range(1, BLOCKS)), _words(0)) / 3)))


def _all_keys(least: Column) -> Column:
    """Pairs of blocks, each with its number; null for those that rest on too few words."""
    keys = [F.when(_words(a) + _words(b) >= least, F.shiftleft(block(a), 16).bitwiseOR(block(b)).bitwiseOR(F.lit(i << 32))) for i, (a, b) in enumerate(PAIRS)]
    return F.array(*keys)


def block_keys() -> Column:
    """The keys of a line: pairs of blocks, each with its number, that rest on enough words."""
    return F.array_compact(_all_keys(least_words()))


def alike(a: str, b: str) -> Column:
    """Lines ``a`` and ``b`` (prefixes of ``size``, ``sim1`` and ``sim2``) may be similar: like lengths, and few bits different."""
    sizes = [F.col(f"{x}size") for x in (a, b)]
    bits = [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in ("sim1", "sim2")]
    return (bits[0] + bits[1] <= RADIUS) & (F.least(*sizes) >= F.greatest(*sizes) * F.lit(SIMILARITY) - F.lit(1e-9))


def letter_counts(norm: Column) -> list[Column]:
    """``g0, g1``: of every character of ``LETTERS`` as many low bits in its four as the line has it, up to ``COUNTED``; null for lines that are not short."""
    found = []
    for j, letters in enumerate(LETTERS):
        bits = F.lit(0).cast("long")
        for i, c in enumerate(letters):
            n = F.least(F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit(""))), F.lit(COUNTED))
            bits = bits.bitwiseOR(F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("long"), n) - F.lit(1), COUNTED * i))
        found.append(F.when(F.length(norm) <= SHORT, bits).alias(f"g{j}"))
    return found


def letters_alike(a: str, b: str) -> Column:
    """Letters do not rule out that lines ``a`` and ``b`` (prefixes of ``size``, ``g0`` and ``g1``) are similar: an edit takes away one at most and adds one at most."""
    more = lambda x, y: sum((F.bit_count(F.col(f"{x}g{j}").bitwiseAND(F.bitwise_not(F.col(f"{y}g{j}")))) for j in range(len(LETTERS))), F.lit(0))
    most = F.floor(F.greatest(f"{a}size", f"{b}size") * F.lit(1 - SIMILARITY) + F.lit(1e-9))
    return F.coalesce((more(a, b) <= most) & (more(b, a) <= most), F.lit(True))


def bound(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with ``cols``, computed once a row: filters are not moved below a generator, so they are not written out again in each use."""
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("cols")).select(*kept, "cols.*")


def trimmed(pairs: DataFrame) -> DataFrame:
    """``pairs(x, y, ...)`` of unlike lines with ``most``, the edits allowed, and in ``wx, wy`` the words between those that both begin with and those that both end with; null for short lines."""
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * F.lit(1 - SIMILARITY) + F.lit(1e-9)).cast("int")
    pairs = pairs.where(F.abs(F.length("x") - F.length("y")) <= most)
    words = lambda c: F.when(F.greatest(F.length("x"), F.length("y")) > SHORT, F.split(c, " "))
    pairs = bound(pairs, most=most, wx=words("x"), wy=words("y"))
    equal = lambda a, b: F.array_position(F.zip_with(a, b, lambda v, w: v.eqNullSafe(w)), False).cast("int") - 1
    pairs = bound(pairs, head=equal("wx", "wy"), tail=equal(F.reverse("wx"), F.reverse("wy")))
    tail = F.least(F.col("tail"), F.least(F.size("wx"), F.size("wy")) - F.col("head"))
    middle = lambda w: F.slice(w, F.col("head") + 1, F.size(w) - F.col("head") - tail)
    return bound(pairs, wx=middle("wx"), wy=middle("wy")).drop("head", "tail")


def edits_by_words(a: str, b: str) -> Column:
    """Edits that are enough to turn words ``a`` into words ``b``; not always the fewest.

    From left to right equal words are matched. Behind a difference the next match is
    the first word that is found again, with its successor, at most ``AHEAD`` words on.
    What lies between two matches is replaced as a whole: as many edits as its longer
    side has characters, a space for each word included.
    """
    two = lambda c: F.transform(c, lambda w, i: F.concat_ws(" ", w, F.get(c, i + 1)))
    chars = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w) + 1)
    state = lambda j, k, left, cost: F.struct(j.alias("j"), k.alias("k"), left.alias("left"), cost.alias("cost"))
    none = F.lit(0)

    def aligned(s: Column) -> Column:
        x, y = s["x"], s["y"]

        def step(t: Column, i: Column) -> Column:
            j, k, left, cost = (t[c] for c in ("j", "k", "left", "cost"))

            def found(p: Column) -> Column:
                between = chars(F.slice(y, j + 1, p - 1))
                return F.when(p > 0, state(j + p, none, none, cost + F.greatest(left, between))).otherwise(state(j, k + 1, left + F.length(F.get(x, i)) + 1, cost))

            # In an array, so that the place is looked for once.
            again = F.array(F.array_position(F.slice(s["yy"], j + 1, k + AHEAD), F.get(s["xx"], i)).cast("int"))
            return F.when((k == 0) & F.get(x, i).eqNullSafe(F.get(y, j)), state(j + 1, none, none, cost)).otherwise(F.transform(again, found)[0])

        last = lambda t: t["cost"] + F.greatest(t["left"], chars(F.slice(y, t["j"] + 1, F.size(y))))
        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), state(none, none, none, none), step, last)

    # Structs in arrays: what a lambda refers to is then computed once, not for each word.
    words = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")))
    words = F.transform(words, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), two(s["x"]).alias("xx"), two(s["y"]).alias("yy")))
    return F.transform(words, aligned)[0]


def similar(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs(x, y, ...)``, of unlike lines, whose edit similarity is 0.8 or more.

    Words that both begin or end with change nothing in the distance, so it is that
    of the rest. No distance is larger than the longer side or than the edits that
    words matched one by one leave to do. That is much cheaper to see than the
    distance itself, which is only computed for pairs that may be above the bound.
    """
    most, n = F.col("most"), F.length
    pairs = trimmed(pairs)
    pairs = bound(pairs, mx=F.array_join("wx", " "), my=F.array_join("wy", " "))
    # Where one side is empty, the other line has words more and the distance is the difference in length.
    longer = F.greatest(n("mx"), n("my"))
    near = (n("mx") == 0) | (n("my") == 0) | (longer <= most)
    within = lambda a, b: F.call_function("levenshtein", F.col(a), F.col(b), most) >= 0
    kept = F.when(F.col("wx").isNull(), within("x", "y")).when(near, F.lit(True)).when(longer <= SHORT, within("mx", "my")).when(edits_by_words("wx", "wy") <= most, F.lit(True))
    return pairs.where(kept.otherwise(within("mx", "my"))).drop("most", "wx", "wy", "mx", "my")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Stored ``(lid, h1, h2, size, n, sim1, sim2, k, ID)``: every different line with a number, its occurrences ``k``, and the least id of a document with it."""
    own = ["size", "n", "sim1", "sim2"]
    found = lines.groupBy("h1", "h2").agg(F.count("*").alias("k"), F.min(ID).alias(ID), *[F.max(c).alias(c) for c in own])
    return stored(found.select(F.monotonically_increasing_id().alias("lid"), "h1", "h2", *own, "k", ID), "distinct-lines")


OWN = ("lid", "size", "sim1", "sim2")


def shared_keys(distinct: DataFrame) -> DataFrame:
    """Stored ``(key, k, *OWN)``: the lines of every key that several lines have, and their number ``k``."""
    # Most keys are met once; the few others are written, so the large table is dealt out and sorted one time only.
    # ``least`` is a column of its own: written out in each key it makes a method that is too long to be compiled.
    dealt = distinct.select("n", *OWN, least_words().alias("least")).select(F.explode(_all_keys(F.col("least"))).alias("key"), *OWN).where("key IS NOT NULL")
    return stored(dealt.withColumn("k", F.count("*").over(Window.partitionBy("key"))).where("k > 1").select("key", "k", *OWN), "keys")


def candidates(rows: DataFrame) -> DataFrame:
    """Rows of small keys to candidate pairs ``(a, b)``, the smaller number first."""
    side = lambda p: rows.where(F.col("k") <= SMALL).select("key", *[F.col(c).alias(f"{p}_{c}") for c in OWN])
    return side("x").join(side("y"), "key").where((F.col("x_lid") < F.col("y_lid")) & alike("x_", "y_")).select(F.col("x_lid").alias("a"), F.col("y_lid").alias("b"))


def _step() -> Column:
    """The step of length that a line is in; alike lines are in the same or adjacent ones, as each is a little more than the ratio allowed."""
    return F.floor(F.log(F.col("size").cast("double")) / math.log(1.001 / SIMILARITY))


def firsts(large: DataFrame) -> DataFrame:
    """Candidate pairs ``(a, b)`` of the first line of each large key and step of length with the others there."""
    rows = large.select("key", _step().alias("step"), *OWN)
    first = rows.groupBy("key", "step").agg(F.min(F.struct(*OWN)).alias("h")).select("key", "step", *[F.col(f"h.{c}").alias(f"h_{c}") for c in OWN])
    return rows.join(first, ["key", "step"]).where((F.col("lid") != F.col("h_lid")) & alike("", "h_")).select(F.col("h_lid").alias("a"), F.col("lid").alias("b"))


def meetings(some: DataFrame, rows: DataFrame) -> DataFrame:
    """Every candidate pair of a line of ``some(key, k, *OWN, ...)`` and one of ``rows``, of the same columns, that share a large key: ``x_`` and ``y_`` columns.

    A key's lines are dealt to parts, and a cell is a step of length, a part of the
    one side and a part of the other.
    """
    parts = F.ceil(F.col("k") / CELL).cast("long")
    own, every = F.pmod(F.xxhash64("lid"), parts), F.sequence(F.lit(0).cast("long"), parts - 1)
    name = lambda p, cols: [F.col(c).alias(f"{p}_{c}") for c in cols if c not in ("key", "k")]
    x = some.select("*", own.alias("i"), F.explode(every).alias("j"), _step().alias("at")).select("*", F.explode(F.array(*[F.col("at") + d for d in (-1, 0, 1)])).alias("step"))
    y = rows.select("*", own.alias("j"), F.explode(every).alias("i"), _step().alias("step"))
    cell = ["key", "step", "i", "j"]
    both = x.select(*cell, *name("x", some.columns)).join(y.select(*cell, *name("y", rows.columns)), cell)
    return both.where((F.col("x_lid") != F.col("y_lid")) & alike("x_", "y_"))


def line_links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(node, component)`` of the lines, by number, that are linked to others."""
    rows = shared_keys(distinct)
    pairs = stored(candidates(rows).distinct(), "pairs")
    large = rows.where(F.col("k") > SMALL)
    each = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(firsts(large))
    wanted = checkpointed(each.distinct())
    lids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("lid")).unionByName(large.select("lid")).distinct())
    if lids.isEmpty():
        return connected_components(wanted)
    # Texts are read again for the lines in question only: first their documents, then the lines by hash.
    where = checkpointed(distinct.join(broadcast_if_small(lids, 16, SIDE_BYTES), "lid", "left_semi").select("lid", "h1", "h2", ID))
    ids = checkpointed(where.select(ID).distinct())
    near = sifted(docs, ID, ids)
    texts = sifted(lines_of(near).select(*line_hash(F.col("norm")), "norm"), "h1", where)
    # By the columns that the rows are dealt and sorted by already.
    texts = texts.join(broadcast_if_small(where.select("lid", "h1", "h2"), 32, SIDE_BYTES), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    texts = stored(texts.select("lid", "norm", *letter_counts(F.col("norm"))), "line-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        # Verifying costs much more than its bytes tell, so the pairs are spread by their number.
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // PAIRS_A_TASK)
        side = lambda c, norm: sifted(texts.select(F.col("lid").alias(c), F.col("norm").alias(norm)), c, pairs)
        both = pairs.join(side("a", "x"), "a").repartition(parts, "b").join(side("b", "y").repartition(parts, "b"), "b")
        return checkpointed(similar(both).select("a", "b"))

    good = verified(wanted)
    groups = connected_components(good)
    name = groups.select("node", "component")
    of = lambda c: name.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")
    more = verified(checkpointed(apart.unionByName(_apart(large, of("lid"), texts.drop("norm"))).join(wanted, ["a", "b"], "left_anti").distinct()))
    return groups if more.isEmpty() else connected_components(good.unionByName(more))


def _apart(large: DataFrame, of: DataFrame, letters: DataFrame) -> DataFrame:
    """The candidate pairs ``(a, b)`` of large keys whose ends are in different components, by ``of(lid, lidc)``; lines that it has not are their own. Pairs that ``letters(lid, g0, g1)`` rule out are left out."""
    named = large.join(of, "lid", "left").join(letters, "lid", "left")
    named = stored(named.select("key", "k", *OWN, "g0", "g1", F.coalesce("lidc", "lid").alias("c")), "named")
    most = named.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", "n").alias("most"))
    others = named.join(most, "key").where("c <> most").select(*named.columns)
    found = meetings(others, named).where("x_c <> y_c").where(letters_alike("x_", "y_"))
    return found.select(F.least("x_lid", "y_lid").alias("a"), F.greatest("x_lid", "y_lid").alias("b"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``(ID, TEXT_HASH, lines)``: the numbers, from 0, of the lines that each row loses."""
    keyed = with_keys(docs).select(ID, TEXT_HASH, "text")
    lines = simhashed(keyed)
    distinct = distinct_lines(lines)
    groups = line_links(keyed, distinct)
    # Only lines that occur again or are linked matter from here on; the order of places is then found for these few.
    named = distinct.select("lid", "h1", "h2", "k").join(broadcast_if_small(groups, 24, SIDE_BYTES), F.col("lid") == F.col("node"), "left").where("k > 1 OR node IS NOT NULL")
    again = checkpointed(named.select("h1", "h2", F.coalesce("component", "lid").alias("c")))
    place = F.struct(ID, TEXT_HASH, "line")
    occ = lines.select(ID, TEXT_HASH, "line", "h1", "h2").join(broadcast_if_small(again, 32, SIDE_BYTES), ["h1", "h2"]).drop("h1", "h2")
    first = checkpointed(occ.groupBy("c").agg(F.min(place).alias("keep")))
    lost = occ.join(broadcast_if_small(first, 48, SIDE_BYTES), "c").where(~place.eqNullSafe(F.col("keep")))
    return checkpointed(lost.groupBy(ID, TEXT_HASH).agg(F.array_sort(F.collect_set("line")).alias("lines")))


def _without(gone: Column) -> Column:
    return F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")


def _joined(docs: DataFrame) -> DataFrame:
    """``docs`` with the numbers of its duplicate lines, or null, in a column of our own."""
    gone = duplicate_lines(docs).withColumnRenamed("lines", GONE)
    return by_keys(docs, gone, "left", 8 * F.size(GONE))


GONE = "__sw_lines"


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with duplicate lines cut out of ``text`` (and ``n_chars`` counted anew, where it is a column)."""
    name = F.col(GONE)
    out = _joined(docs).withColumn("text", F.when(name.isNull(), F.col("text")).otherwise(_without(name)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(name.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_lost, text_sha256`` of the text that is left."""
    out, name = _joined(docs.select("doc_id", "text")), F.col(GONE)
    text = F.when(name.isNull(), F.coalesce("text", F.lit(""))).otherwise(_without(name))
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return out.select("doc_id", n.alias("n_lines"), F.coalesce(F.size(name), F.lit(0)).cast("long").alias("n_lost"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
