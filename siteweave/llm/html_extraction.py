"""Main-text extraction by wrappers inferred from the pages of a host.

Every page becomes a stream of block-level tags and text slots, written as a
union-free regular expression: neighbours of one kind fold into a repeated group,
as do repeated runs of two to four kinds. The distinct expressions of a host are
aligned one after another: what only one of two streams has becomes an optional
group, runs become repeated groups, text becomes a slot. A level of more than
``LEVEL`` items is written ``(a? b? c?)*``, which has one item for each kind, and
digits in class names are one kind, so an expression does not grow with the pages.

Then every page is matched against its host's expression, which deals its text to
the slots, and the slots are counted over all pages: characters, characters in
links, whether the text is always the same. The expression's content slots are
chosen by that: those below its ``article`` items, else its ``main`` items, else
the smallest item with nearly all varying text; never those below items whose tag,
role or class says menu, advert, comments and the like, nor fixed texts of three
or more pages in an item that a class or id marks. The text of a page is what
its match puts into content slots; where that is nothing (a page unlike all
others, by an order of items that the expression does not have), the wrapper is
the page's own expression.

Expressions of equal pages are counted before they are shuffled, folded in
buckets, then by host, streaming; slots are summed map-side. So a host with a third of all pages
is no single task. Elements nested deeper than ``DEEP`` count as part of their
ancestor at that depth; an implied end tag is looked for among the innermost
``SCAN`` elements; after 64 tags with a quote that never ends, tags end at their
first ``>``. None of these drops text.

Cases: a null or empty html gives an empty text; null urls and hosts share one
wrapper; null ids and repeated rows get a row each; a tag cut off at the end
of the page is no text, what is before it is read; an empty table gives an
empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_BYTES, map_arrow, stored

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element closes open ones of these names, up to a container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
BOILER = frozenset("head nav footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu search title audio video map math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Class or id names, as a whole or with one of the words of ``AROUND`` before or behind, that mark a container as no article text.
WORDS = (
    "ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|footer|masthead|topbar|toolbar|cookie|cookies|"
    "consent|gdpr|notice|notification|popup|modal|overlay|comment|comments|commentlist|disqus|replies|respond|share|sharing|social|newsletter|subscribe|signup|login|pager|pagination|"
    "werbung|anzeige|kommentar|kommentare|seitenleiste|hinweis|publicite|publicidad|commentaire|commentaires|comentario|comentarios|anuncio|anuncios"
)
AROUND = "site|page|main|top|bottom|left|right|post|user|users|reader|readers|box|bar|block|list|section|wrapper|container|area|link|links|form|slot|unit|banner|menu|nav|thread"
NAMES = re.compile(rf"(?:(?:{AROUND})[-_]?)?(?:{WORDS})(?:[-_]?(?:{AROUND}))?", re.IGNORECASE)
#: These hold the text itself; what their class says is no reason to drop it.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption caption html body article main".split())
NEARLY, FIXED_PAGES, BUCKETS = 0.95, 3, 16
LEVEL, KINDS, DEEP, SCAN = 64, 256, 48, 64
ANY, SLOT = "(*)", "#"


def _tags(html: str):
    """``(text, closing, name, attributes)`` in order; the last has no name. Linear: a search that fails ends the page or is not tried again."""
    at, start, end, low, loose = 0, 0, len(html), None, 0
    while True:
        i = html.find("<", at)
        if i < 0:
            break
        closing, name, attrs = False, "", ""
        if html.startswith("<!--", i):
            stop, size = html.find("-->", i + 2), 3
        elif html.startswith("<![CDATA[", i):
            stop, size = html.find("]]>", i), 3
        elif html[i + 1 : i + 2] in ("!", "?"):
            stop, size = html.find(">", i), 1
        else:
            m = NAME.match(html, i)
            if not m:  # a plain <
                at = i + 1
                continue
            closing, name, size = html[i + 1] == "/", m[1].lower(), 1
            whole = ATTRS.match(html, m.end()) if loose < 64 else None
            loose += whole is None
            stop = whole.end() - 1 if whole else html.find(">", m.end())
            attrs = html[m.end() : max(stop, m.end())]
        if stop < 0:
            yield html[start:i], False, "", ""
            return
        yield html[start:i], closing, name, attrs
        at = stop + size
        if name in RAW and not closing:
            if low is None:
                low = html.lower()
                if len(low) != end:  # a few letters change length when lowered
                    low = "".join(c.lower() if c < "\x80" else c for c in html)
            stop = low.find(f"</{name}", at)
            at = end if stop < 0 else stop
        start = at
    yield html[start:], False, "", ""


def _marks(attrs: str) -> tuple[str, bool]:
    """The key that class and id give an element, and whether another attribute hides it or gives it a role beside the text."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return "", False
    names, bad = set(), False
    for m in ATTR.finditer(attrs):
        k, v = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").strip()
        if m.start() and (attrs[m.start() - 1].isalnum() or attrs[m.start() - 1] in "-_"):
            continue
        if k in ("class", "id") and v:
            names.update(re.sub(r"[^\w-]+", "_", re.sub(r"\d+", "0", x))[:40] for x in v.split()[:8])
        elif k == "role":
            bad |= v.lower() in ROLES
        elif k == "hidden":
            bad = True
        elif k == "aria-hidden":
            bad |= v.lower() == "true"
        elif k == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.IGNORECASE))
    return "".join(f".{x}" for x in sorted(names)), bad


def _key(name: str, attrs: str) -> str:
    """The kind of an element: its tag, ``!`` where it is hidden or beside the text, and its class and id names."""
    marks, bad = _marks(attrs)
    return f"{name[:40]}{'!' if bad else ''}{marks}"


def parse(html: str) -> tuple[list[tuple[str, int]], list]:
    """Blocks ``(text, characters in links)`` in page order, and the page's expression, whose slots list their blocks."""
    blocks: list[tuple[str, int]] = []
    root: list = []
    # Open elements: name, whether inline, where its children go in the expression.
    stack: list[tuple[str, bool, list]] = [("", False, root)]
    opened: dict[str, int] = {}
    buffer: list[str] = []
    linked, in_link, depth = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                children = stack[-1][2]
                if not children or children[-1][0] != SLOT:
                    children.append([SLOT, 0, 0, []])
                children[-1][3].append(len(blocks))
                blocks.append((text, min(linked, len(text))))
            linked = 0

    def pop(to: int) -> None:
        nonlocal in_link, depth
        while len(stack) > to:
            name, inline, _ = stack[-1]
            if not inline:
                flush()
                depth -= 1
            in_link -= name == "a"
            opened[name] -= 1
            stack.pop()

    for text, closing, name, attrs in _tags(html):
        if text:
            data = unescape(text)
            buffer.append(data)
            linked += len(data) if in_link else 0
        if not name:
            continue
        if closing:
            if name in BLOCK:
                flush()
            if not opened.get(name):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if not stack[i][1] and name not in BLOCK:  # an inline end tag ends nothing outside its block
                    break
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in CLOSES_P:
            if opened.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if not stack[i][1]:
                        break
            if name in HEADINGS and stack[-1][0] in HEADINGS:
                pop(len(stack) - 1)
        if name in IMPLIED and any(opened.get(x) for x in IMPLIED[name][0]):
            shut, within = IMPLIED[name]
            low = len(stack)
            for i in range(len(stack) - 1, max(0, len(stack) - 1 - SCAN), -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in shut:
                    low = i
            pop(low)
        block = name in BLOCK or name in BOILER
        if block:
            flush()
        if name in VOID:
            continue
        children = stack[-1][2]
        opened[name] = opened.get(name, 0) + 1
        if block:
            if depth < DEEP:
                item = [_key(name, attrs), 0, 0, []]
                children.append(item)
                children = item[3]
            depth += 1
            stack.append((name, False, children))
        else:
            stack.append((name, True, children))
            in_link += name == "a"
    pop(1)
    flush()
    return blocks, fold(root)


def fold(items: list) -> list:
    """Fold neighbours of one kind, and repeated runs of two to four kinds, into repeated groups. Items are ``[key, optional, repeated, children]``, slots have their blocks instead of children."""
    out: list = []
    for key, opt, rep, children in items:
        item = [key, opt, rep, children if key == SLOT else fold(children)]
        if out and out[-1][0] == key:
            out[-1] = merge(out[-1], item, 1)
        else:
            out.append(item)
    for size in (2, 3, 4) if len(out) <= 16 * LEVEL else ():
        i = 0
        while i + 2 * size <= len(out):
            keys = [x[0] for x in out[i : i + size]]
            if keys == [x[0] for x in out[i + size : i + 2 * size]]:
                group, stop = out[i : i + size], i + size
                while [x[0] for x in out[stop : stop + size]] == keys:
                    group = align(group, out[stop : stop + size])
                    stop += size
                out[i:stop] = [["(" + " ".join(keys) + ")", 0, 1, group]]
            i += 1
    return collapse(out) if len(out) > LEVEL else out


def merge(x: list, y: list, rep: int = 0) -> list:
    """One item for two of one kind; both are used up."""
    if x[0] == SLOT:
        x[3].extend(y[3])
    children = x[3] if x[0] == SLOT else align(x[3], y[3])
    return [x[0], x[1] | y[1] if not rep else x[1] & y[1], x[2] | y[2] | rep, children]


def collapse(items: list) -> list:
    """A level as one repeated group of optional items, one for each kind; of too many kinds, those of a tag are one."""
    if items and items[0][0] == ANY and len(items) == 1:
        return items
    kinds: dict[str, list] = {}
    for x in items:
        kinds[x[0]] = merge(kinds[x[0]], x, 1) if x[0] in kinds else x
    if len(kinds) > KINDS:
        bare: dict[str, list] = {}
        for x in kinds.values():
            for y in x[3] if x[0][0] == "(" else [x]:
                k = _bare(y[0])
                bare[k] = merge(bare[k], [k, *y[1:]], 1) if k in bare else [k, *y[1:]]
        kinds = bare
    return [[ANY, 0, 1, [[k, 1, rep, children] for k, _, rep, children in kinds.values()]]]


def _bare(key: str) -> str:
    """A kind without its class and id names, but for what they mean; of tags that are not HTML's own, one kind."""
    tag, _, rest = key.partition(".")
    plain = tag.rstrip("!")
    known = plain if plain in BLOCK or plain in BOILER or plain == SLOT else "div"
    return known + ("!" if tag != plain or plain not in PLAIN and any(NAMES.fullmatch(x) for x in rest.split(".")) else "")


def align(a: list, b: list) -> list:
    """One expression that fits both: common items are aligned inside, the others become optional."""
    if a == b and not any(x[0] == SLOT and x[3] for x in a):
        return a
    if (a and a[0][0] == ANY) or (b and b[0][0] == ANY):
        flat = [y for x in (a, b) for y in (x[0][3] if x and x[0][0] == ANY else x)]
        return collapse(flat)
    out: list = []
    maybe = lambda items: [[k, 1, r, c] for k, _, r, c in items]
    for op, i, j, k, m in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += maybe(a[i:j]) + maybe(b[k:m])
    joined: list = []
    for x in out:
        if joined and joined[-1][0] == x[0]:
            joined[-1] = merge(joined[-1], x, 1)
        else:
            joined.append(x)
    return collapse(joined) if len(joined) > LEVEL else joined


def empty(items: list) -> list:
    """An expression without the blocks of its page."""
    return [[k, o, r, [] if k == SLOT else empty(c)] for k, o, r, c in items]


def numbered(items: list, at: list | None = None) -> list:
    """An expression whose slots have a number, in its order, in the place of blocks."""
    at = [0] if at is None else at
    out = []
    for k, o, r, c in items:
        if k == SLOT:
            out.append([k, o, r, at[0]])
            at[0] += 1
        else:
            out.append([k, o, r, numbered(c, at)])
    return out


def match(page: list, wrapper: list) -> dict[int, int]:
    """Slot of every block of a page's expression that fits the (numbered) wrapper's: items in order, repeated and optional ones as often as they come."""
    found: dict[int, int] = {}

    def visit(items: list, within: list) -> None:
        if within and within[0][0] == ANY:
            kinds = {x[0]: x for x in within[0][3]}
            for x in items[0][3] if items and items[0][0] == ANY else items:
                if x[0][0] == "(" and x[0] not in kinds:
                    visit(x[3], within)
                elif (y := kinds.get(x[0]) or kinds.get(_bare(x[0]))) is not None:
                    take(x, y)
            return
        at = 0
        for x in items[0][3] if items and items[0][0] == ANY else items:
            j = next((j for j in range(at, len(within)) if within[j][0] == x[0]), None)
            if j is not None:
                at = j
                take(x, within[j])
            elif x[0][0] == "(":
                visit(x[3], within)

    def take(x: list, y: list) -> None:
        if x[0] == SLOT:
            found.update(dict.fromkeys(x[3], y[3]))
        else:
            visit(x[3], y[3])

    visit(page, wrapper)
    return found


def content_slots(wrapper: list, stats: dict[int, tuple[int, int, int, bool]]) -> set[int]:
    """Slots of the main text, from ``(pages, chars, chars in links, fixed)`` of each slot."""
    tags: list[str] = []
    own: list[tuple[int, tuple[int, ...], str]] = []

    def walk(items: list, bad: bool, inside: bool, chain: tuple[int, ...], above: str) -> None:
        for key, _, _, children in items:
            if key == SLOT:
                if not bad and children in stats:
                    own.append((children, chain, above))
            elif key[0] == "(":
                walk(children, bad, inside, chain, above)
            else:
                tag, _, names = key.partition(".")
                hidden, tag = tag.endswith("!"), tag.rstrip("!")
                keep = tag in ("html", "body", "article", "main")
                marked = tag not in PLAIN and any(NAMES.fullmatch(x) for x in names.split("."))
                tags.append(tag)
                walk(children, bad or tag in BOILER or marked or hidden and not keep or tag == "header" and not inside, inside or tag in ("article", "main"), (*chain, len(tags) - 1), key)

    walk(wrapper, False, False, (), "")
    region: list = []
    for tag in ("article", "main"):
        region = [s for s in own if any(tags[n] == tag for n in s[1])]
        if region:
            break
    else:
        vary = {s: max(stats[s][1] - 2 * stats[s][2], 0) for s, _, _ in own if not (stats[s][3] and stats[s][0] > 1)}
        weight: dict[int, int] = {}
        for s, chain, _ in own:
            for n in chain:
                weight[n] = weight.get(n, 0) + vary.get(s, 0)
        total = sum(vary.values())
        good = [n for n, v in weight.items() if total and v >= NEARLY * total and tags[n] in ("div", "section", "body", "td", "center")]
        top = max(good, default=None)  # the last one in page order lies innermost, as all hold most of the text
        region = [s for s in own if top in s[1]] if top is not None else own
    if any(not stats[s[0]][3] for s in region):
        region = [s for s in region if not (stats[s[0]][3] and stats[s[0]][0] >= FIXED_PAGES and "." in s[2] and s[2].partition(".")[0] not in HEADINGS)]
    return {s[0] for s in region}


def main_text(html: str, wrapper: list, content: set[int]) -> str:
    """The text that a page has in the content slots of a wrapper, or of its own expression if it has none there."""
    blocks, form = parse(html)
    slots = match(form, wrapper)
    kept = [b[0] for i, b in enumerate(blocks) if slots.get(i) in content]
    if not kept and blocks:
        own = numbered(empty(form))
        slots = match(form, own)
        content = content_slots(own, _page_stats(blocks, slots))
        kept = [b[0] for i, b in enumerate(blocks) if slots.get(i) in content]
    return "\n\n".join(kept)


def _page_stats(blocks: list[tuple[str, int]], slots: dict[int, int]) -> dict[int, tuple[int, int, int, bool]]:
    out: dict[int, tuple[int, int, int, bool]] = {}
    for i, s in slots.items():
        _, chars, linked, _ = out.get(s, (1, 0, 0, False))
        out[s] = (1, chars + len(blocks[i][0]), linked + blocks[i][1], False)
    return out


def _batch(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _forms(batches):
    """The different expressions of a batch's pages, without texts."""
    for b in batches:
        rows = {(host, json.dumps(empty(parse(html or "")[1]), separators=(",", ":"))) for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        yield _batch(["host", "what"], [pa.string(), pa.string()], sorted(rows, key=str))


def _fold_forms(batches):
    """Rows sorted by host and bucket: one folded expression for each, one row held at a time."""
    key, form, out = None, None, []
    names, kinds = ["host", "bucket", "what"], [pa.string(), pa.int32(), pa.string()]
    for b in batches:
        for host, bucket, what in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (host, bucket) != key:
                if key is not None:
                    out.append((*key, json.dumps(form, separators=(",", ":"))))
                key, form = (host, bucket), json.loads(what)
            else:
                form = align(form, json.loads(what))
        if len(out) > 1000:
            yield _batch(names, kinds, out)
            out = []
    if key is not None:
        out.append((*key, json.dumps(form, separators=(",", ":"))))
    if out:
        yield _batch(names, kinds, out)


def _loader(load, most: int = 64):
    """``load`` of a host's text, the last ``most`` results kept."""
    known: dict = {}

    def get(*texts):
        if texts not in known:
            if len(known) >= most:
                known.pop(next(iter(known)))
            known[texts] = load(*texts)
        return known[texts]

    return get


def _slots(batches):
    """Every page matched against its host's expression: slots of a batch, summed."""
    get = _loader(lambda w: numbered(json.loads(w)))
    for b in batches:
        slots: dict[tuple, list] = {}
        for host, html, wrapper in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            blocks, form = parse(html or "")
            page: dict[int, list] = {}
            for i, slot in sorted(match(form, get(wrapper)).items()):
                s = page.setdefault(slot, [blake2b(digest_size=8), 0, 0])
                s[0].update(blocks[i][0].encode("utf-8", "surrogatepass") + b"\n")
                s[1] += len(blocks[i][0])
                s[2] += blocks[i][1]
            for slot, (digest, chars, linked) in page.items():
                d = int.from_bytes(digest.digest(), "big", signed=True)
                s = slots.setdefault((host, slot), [0, 0, 0, d, d])
                s[:] = s[0] + 1, s[1] + chars, s[2] + linked, min(s[3], d), max(s[4], d)
        yield _batch(["host", "slot", "pages", "chars", "linked", "lo", "hi"], [pa.string(), pa.int32(), *[pa.int64()] * 5], [(*k, *s) for k, s in slots.items()])


def _contents(batches):
    """The content slots of each host's expression."""
    for b in batches:
        rows = []
        for host, wrapper, slots in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            stats = {s["slot"]: (s["pages"], s["chars"], s["linked"], s["fixed"]) for s in slots or []}
            rows.append((host, wrapper, json.dumps(sorted(content_slots(numbered(json.loads(wrapper)), stats)))))
        yield _batch(["host", "expression", "content"], [pa.string()] * 3, rows)


def _sized(side: DataFrame, *columns: str) -> DataFrame:
    """``side`` with a broadcast hint if its real lengths prove that it is small."""
    size = side.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(64)))).first()[0] or 0
    return F.broadcast(side) if 2 * size <= BROADCAST_BYTES else side


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, expression, content)`` for every host, from all its pages; ``pages(host, html)``, hosts not null. ``content`` lists the numbers of the expression's content slots."""
    forms = map_arrow(pages.select("host", "html"), _forms, "host string, what string").distinct()
    forms = forms.select("host", F.pmod(F.xxhash64("what"), F.lit(BUCKETS)).cast("int").alias("bucket"), "what")
    shape = "host string, bucket int, what string"
    forms = map_arrow(forms.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "what"), _fold_forms, shape)
    forms = map_arrow(forms.select("host", F.lit(0).alias("bucket"), "what").repartition("host").sortWithinPartitions("host", "what"), _fold_forms, shape)
    wrappers = stored(forms.select("host", F.col("what").alias("expression")), "expressions")
    matched = pages.select("host", "html").join(_sized(wrappers, "host", "expression"), "host").select("host", "html", "expression")
    slots = map_arrow(matched, _slots, "host string, slot int, pages long, chars long, linked long, lo long, hi long")
    slots = slots.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.min("lo") == F.max("hi")).alias("fixed"))
    # A host has as many rows here as its expression has slots.
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "linked", "fixed")).alias("slots"))
    return stored(map_arrow(wrappers.join(slots, "host", "left").select("host", "expression", "slots"), _contents, "host string, expression string, content string"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    side = _sized(infer_wrappers(own), "host", "expression", "content")

    def run(batches):
        get = _loader(lambda w, c: (numbered(json.loads(w)), set(json.loads(c))))
        for b in batches:
            text = [main_text(html or "", *get(w, c)) for html, w, c in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(own.join(side, "host").select("page_id", "url", "html", "expression", "content"), run, f"page_id {kind}, url string, text string, n_chars long")
