"""robots.txt and sitemap files to rows; lenient, and silent about nothing."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET

GZIP_MOST = 50 << 20


def parse_robots(text: str | None) -> dict | None:
    """Groups of agents with their rules, and the sitemaps named; None stays None (not measured)."""
    if text is None:
        return None
    groups, sitemaps, agents_open = [], [], False
    for line in text.lstrip("﻿").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            sitemaps.append(value)
        elif key == "user-agent":
            if not agents_open:
                groups.append({"agents": [], "allow": [], "disallow": []})
            groups[-1]["agents"].append(value.lower())
            agents_open = True
        elif key in ("allow", "disallow"):
            agents_open = False
            if groups and value:
                groups[-1][key].append(value)
        else:
            agents_open = agents_open and key == "crawl-delay"
    return {"groups": groups, "sitemaps": sitemaps}


def allowed(robots: dict | None, agent: str, path: str) -> bool:
    """Longest match of the agent's groups, or of ``*``; ties allow; no rule allows."""
    if robots is None:
        return True
    own = [g for g in robots["groups"] if any(a != "*" and a in agent.lower() for a in g["agents"])] or [g for g in robots["groups"] if "*" in g["agents"]]
    best = (-1, True)
    for g in own:
        for kind in ("disallow", "allow"):
            for rule in g[kind]:
                pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.rstrip("$")) + ("$" if rule.endswith("$") else "")
                if re.match(pattern, path):
                    best = max(best, (len(rule), kind == "allow"))
    return best[1]


def parse_sitemap(data: bytes) -> dict:
    """``format, urls, children, error`` of a urlset, index, RSS or Atom feed, or plain list, gzipped or not."""
    out = {"format": None, "urls": [], "children": [], "error": None}
    if data[:2] == b"\x1f\x8b":
        try:
            with gzip.GzipFile(fileobj=__import__("io").BytesIO(data)) as f:
                data = f.read(GZIP_MOST + 1)
        except (OSError, EOFError) as e:
            return out | {"error": f"gzip: {e}"}
        if len(data) > GZIP_MOST:
            return out | {"error": "larger than allowed"}
    text = data.decode("utf-8-sig", "replace").strip()
    if not text:
        return out | {"error": "empty"}
    if re.match(r"(?i)<!doctype html|<html", text):
        return out | {"error": "an HTML page"}
    if not text.startswith("<"):
        urls = [u for u in text.split() if re.match(r"https?://", u)]
        return out | ({"format": "text", "urls": urls} if urls else {"error": "no urls"})
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        return out | {"error": f"malformed: {e}"}
    local = lambda e: e.tag.rpartition("}")[2].lower()
    under = lambda e, name: [(c.text or "").strip() for c in e if local(c) == name and "}image" not in c.tag.lower()]
    kind = local(root)
    if kind in ("urlset", "sitemapindex"):
        locs = [u for e in root if local(e) in ("url", "sitemap") for u in under(e, "loc")[:1] if u]
        return out | {"format": kind, "urls" if kind == "urlset" else "children": locs}
    if kind in ("rss", "rdf"):
        return out | {"format": "rss", "urls": [u for e in root.iter() if local(e) == "item" for u in under(e, "link")[:1] if u]}
    if kind == "feed":
        return out | {"format": "atom", "urls": [c.get("href") for e in root if local(e) == "entry" for c in e if local(c) == "link" and c.get("rel", "alternate") == "alternate" and c.get("href")]}
    return out | {"error": f"unknown root: {kind}"}
