"""Stored HTML to facts, blocks, links and JSON-LD blocks, in one parse of each page inside Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.url import resolve
from ..session import prepare

BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote figcaption dd dt th td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer".split())
CHROME_ROLES = frozenset("navigation banner contentinfo".split())
NEVER = frozenset("script style noscript template svg iframe".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = BLOCKS - {"dd", "dt", "th", "td", "figcaption"} | frozenset("address article aside div dl fieldset figure footer form header hr main nav ol pre section table ul dd dt".split())
ANCHOR_CHARS, ANCHOR_WORDS, SUSPECTS = 200, 4, 5
KINDS = frozenset(("block", "link", "ld", "facts"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
P_STOPS, LIST_STOPS, CELL_STOPS = frozenset("table td th li div section article body".split()), frozenset("ul ol dl table".split()), frozenset(("tr", "table"))
HOST = re.compile(r"^[^:]+://([^/?#]*).*$", re.DOTALL)
USELESS = re.compile(r"^(?:(?:image|img|photo|picture|pic|graphic|icon|logo|untitled|placeholder|banner|thumbnail)[\s_-]*\d*|(?:img|dsc|dscn|dscf|pict|p|screenshot)[\s_-]*\d{2,}[\w-]*)$")
ENDING = re.compile(r"\.(?:jpe?g|png|gif|webp|svg|avif|bmp|tiff?)$")
ENCODE = json.JSONEncoder(ensure_ascii=False).encode
GUARD = re.compile(r"^\s*(?:<!--|<!\[CDATA\[|/\*<!\[CDATA\[\*/|//\s*<!\[CDATA\[)|(?:-->|\]\]>|/\*\]\]>\*/|//\s*\]\]>)\s*$")


STYLED_AWAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class Node:
    """An element, with what it inherits, and its place among the page's text pieces: no reference leads down, so a tree is freed without the garbage collector."""

    __slots__ = ("attrs", "chrome", "end", "forced", "holds", "name", "never", "ord", "parent", "start", "unseen")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None, ord_: int, start: int) -> None:
        self.name, self.attrs, self.parent, self.ord, self.start, self.end = name, attrs, parent, ord_, start, start
        #: A block is inside.
        self.holds = False
        # Hidden by an attribute here or above; by the nearest style; in chrome; in which element whose text never counts.
        self.forced = (parent is not None and parent.forced) or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        self.unseen = STYLED_AWAY.search(attrs["style"]) is not None if "style" in attrs else parent is not None and parent.unseen
        self.chrome = (parent is not None and parent.chrome) or name in CHROME or attrs.get("role", "").lower() in CHROME_ROLES
        self.never = ord_ if name in NEVER else parent.never if parent is not None else -1

    @property
    def hidden(self) -> bool:
        return self.forced or self.unseen


class Tree(HTMLParser):
    """A forgiving tree: implied end tags for paragraphs, list items, definitions and table cells.

    ``nodes`` has the elements in document order; ``texts`` has the pieces of text, and ``never`` for each the innermost element
    around it whose text never counts.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0, 0)
        self.nodes, self.texts, self.never = [self.root], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, P_STOPS)
        if tag in CLOSES:
            self._close(CLOSES[tag], LIST_STOPS if tag not in ("td", "th") else CELL_STOPS)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {}, self.at, len(self.nodes), len(self.texts))
        self.nodes.append(node)
        if tag in BLOCKS:
            n = self.at
            while n is not None and not n.holds:
                n.holds, n = True, n.parent
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self._leave(n.parent)

    def handle_data(self, data):
        self.texts.append(data)
        self.never.append(self.at.never)

    def close(self):
        super().close()
        self._leave(None)

    def text(self, n: Node) -> str:
        return "".join(self.texts[n.start : n.end])

    def counted(self, n: Node) -> str:
        """The text of an element without what is in elements inside whose text never counts; nothing of such an element itself."""
        return "".join([x for x, o in zip(self.texts[n.start : n.end], self.never[n.start : n.end], strict=True) if o < n.ord])

    def _leave(self, to):
        n, end = self.at, len(self.texts)
        while n is not to:
            n.end, n = end, n.parent
        self.at = to

    def _close(self, names, stop):
        n = self.at
        while n.parent is not None and n.name not in stop:
            if n.name in names:
                self._leave(n.parent)
                return
            n = n.parent


def parse(html: str) -> Tree:
    t = Tree()
    t.feed(html)
    t.close()
    return t


def norm(text: str) -> str:
    return " ".join(text.replace("﻿", " ").split())


def words(text: str) -> int:
    return len(text.replace("﻿", " ").split())


def block_hash(text: str) -> str:
    """Of a text that is ``norm``alised."""
    return hashlib.sha256(text.lower().encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _nearest(node: Node, hashes: dict[int, str]) -> Node | None:
    while node is not None and node.ord not in hashes:
        node = node.parent
    return node


def extract(page_id: str, url: str, html: str | None, site_host: str | None = None, kinds: frozenset[str] = KINDS) -> list[dict]:
    """Rows of the ``kinds`` asked for (``facts``, ``block``, ``link``, ``ld``), in this order; each has a JSON payload."""
    return [{"page_id": page_id, "ord": i, "kind": kind, "payload": payload} for i, (kind, payload) in enumerate(_parts(url, html, site_host, kinds))]


def _parts(url: str, html: str | None, site_host: str | None, kinds: frozenset[str]) -> list[tuple[str, str]]:
    tree, out = parse(html or ""), []
    by: dict[str, list[Node]] = {}
    for n in tree.nodes:
        by.setdefault(n.name, []).append(n)
    find = lambda name: by.get(name, [])
    hashes: dict[int, str] = {}
    if "block" in kinds or "link" in kinds:
        for n in tree.nodes:
            if n.name in BLOCKS and not n.holds:
                text = norm(tree.counted(n))
                if text:
                    hashes[n.ord] = block_hash(text)
                    if "block" in kinds:
                        out.append(("block", {"hash": hashes[n.ord], "tag": n.name, "text": text, "words": text.count(" ") + 1, "hidden": n.hidden, "structural_chrome": n.chrome}))
    if "link" in kinds:
        host, named = site_host or HOST.sub(r"\1", url or "").lower(), {}
        for n in find("a"):
            to = resolve(n.attrs.get("href"), url or "")
            if to:
                block = _nearest(n, hashes)
                if block is not None and block.ord not in named:
                    named[block.ord] = hashes[block.ord] if words(tree.text(block)) >= ANCHOR_WORDS else None
                out.append(("link", {"to": to, "anchor": norm(tree.text(n))[:ANCHOR_CHARS], "internal": HOST.sub(r"\1", to).lower() == host, "rel": n.attrs.get("rel", ""), "block": named[block.ord] if block is not None else None}))
    if "ld" in kinds:
        scripts = ((x, tree.text(x)) for x in find("script") if x.attrs.get("type", "").partition(";")[0].strip().lower() == "application/ld+json")
        for k, raw in enumerate(raw for _, raw in scripts if raw.strip()):
            body = raw.lstrip("﻿")
            while (cut := GUARD.sub("", body)) != body:
                body = cut
            out.append(("ld", {"block": k, "raw": raw, "body": body.strip()}))
    if "facts" in kinds:
        out.append(("facts", _facts(tree, find, url)))
    return [(kind, ENCODE(x)) for kind, x in out]


def _facts(tree: Tree, find, url: str) -> dict:
    everything = tree.nodes
    metas = {m.attrs.get("name", "").lower(): m.attrs.get("content") for m in reversed(find("meta"))}
    title = next((norm(tree.text(t)) for t in find("title")), "")
    body = next(iter(find("body")), tree.root)
    scopes = find("main") + find("article")
    robots = metas.get("robots")
    images = find("img")
    canonical = next((x.attrs["href"] for x in find("link") if "canonical" in x.attrs.get("rel", "").lower().split() and x.attrs.get("href")), None)
    stem = lambda a: ENDING.sub("", a.strip().lower())
    return {
        "title": title or None, "meta_description": metas.get("description"), "heading_levels": [int(n.name[1]) for n in everything if n.name in HEADINGS],
        "robots": {"index": "noindex" not in (robots or "").lower(), "follow": "nofollow" not in (robots or "").lower(), "raw": robots},
        "hreflang": [{"lang": x.attrs["hreflang"], "href": x.attrs.get("href", "")} for x in find("link") if x.attrs.get("hreflang") and "alternate" in x.attrs.get("rel", "").lower().split()],
        "html_lang": next((n.attrs.get("lang") for n in find("html")), None), "has_main": bool(find("main")), "has_article": bool(find("article")),
        "images": len(images), "missing_alt": sum("alt" not in i.attrs for i in images), "suspect_alt": [i.attrs["alt"] for i in images if USELESS.match(stem(i.attrs.get("alt", "")))][:SUSPECTS],
        "dom_words": words(tree.counted(body)), "main_words": sum(words(tree.counted(s)) for s in scopes), "aside_words": sum(words(tree.counted(n)) for n in find("aside")),
        "canonical": (resolve(canonical, url or "") or canonical) if canonical else None,
        "microdata": sum("itemscope" in n.attrs for n in everything), "rdfa": sum("typeof" in n.attrs for n in everything), "microdata_types": sorted({t for n in everything for t in n.attrs.get("itemtype", "").split()}),
    }


#: A worker holds the parts of so many bytes of HTML at a time, or of one page that has more.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Successive pieces of ``batch`` (views of it) of at most ``most`` bytes in a string column, or of one row."""
    begin = held = 0
    for at, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if at > begin and held + (n or 0) > most:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def extract_pages(pages: DataFrame, keep: str = "", kinds: frozenset[str] = KINDS) -> DataFrame:
    """``(page_id string, ord, kind, payload)`` of ``pages(page_id, url, html)``; read the payloads with ``from_json``.

    ``keep`` names further columns, with their types, that every row repeats (``"site string"``); ``kinds`` what is to be made.
    """
    prepare(pages.sparkSession)
    names = [*(c.split()[0] for c in keep.split(", ") if c), "page_id"]

    def run(batches):
        for batch in batches:
            for b in slices(batch, "html"):
                of, rows = [], []
                for i, (u, h) in enumerate(zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True)):
                    parts = _parts(u or "", h or "", None, kinds)
                    of += [i] * len(parts)
                    rows += [(k, *x) for k, x in enumerate(parts)]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(of, pa.int32())) for n in names), *made], [*names, "ord", "kind", "payload"])

    own = pages.selectExpr(*names[:-1], "cast(page_id as string) page_id", "url", "html")
    return own.mapInArrow(run, (f"{keep}, " if keep else "") + "page_id string, ord int, kind string, payload string")
