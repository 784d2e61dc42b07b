"""URL identity. Python functions hold the rules; ``*_col`` wrap them as Arrow UDFs or plain expressions."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..rules import ASSETS

# Parameters that only track, and the prefix of a family of them.
TRACKING = ("_ga", "_gl", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ttclid", "twclid")
TRACKING_PREFIX = "utm_"
PORTS = {"http": 80, "https": 443}
_ESCAPE = re.compile(r"%([0-9a-fA-F]{2})")
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _escapes(text: str) -> str:
    """Decode escapes of unreserved characters; write the others in upper case; leave malformed ones."""
    return _ESCAPE.sub(lambda m: c if (c := chr(int(m[1], 16))) in _UNRESERVED else m[0].upper(), text)


def _quoted(text: str) -> str:
    """Percent-encode what a URL cannot hold as it is."""
    return "".join(c if "!" <= c <= "~" and c not in "\"<>`{}" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            out[-1:] = []
        elif low != ".":
            out.append(p)
        if low in (".", "..") and i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def canonicalise(url: str | None) -> str | None:
    """The canonical form of an http(s) URL, or None if it is not one."""
    if url is None:
        return None
    text = re.sub(r"[\t\r\n]", "", url.strip()).replace("\\", "/")
    m = re.match(r"(?i)(https?):/*([^/?#]*)([^?#]*)(?:\?([^#]*))?", text)
    if not m or not m[2]:
        return None
    scheme, authority, path, query = m[1].lower(), m[2].rpartition("@")[2], m[3] or "/", m[4]
    host, _, port = authority.partition(":") if not authority.startswith("[") else (authority, "", "")
    try:
        host = unquote(host).lower().encode("idna").decode() if not host.startswith("[") else host.lower()
    except UnicodeError:
        return None
    if not host or re.search(r"[\s<>^|%]", host) or port and (not port.isdigit() or int(port) > 65535):
        return None
    port = f":{int(port)}" if port and int(port) != PORTS[scheme] else ""
    pairs = []
    for item in (query or "").split("&"):
        if item:
            key = unquote(item.partition("=")[0], errors="replace")
            if key.lower() not in TRACKING and not key.lower().startswith(TRACKING_PREFIX):
                pairs.append((key, _escapes(_quoted(item))))
    pairs.sort(key=lambda p: p[0])
    return f"{scheme}://{host}{port}{_escapes(_dots(_quoted(path)))}" + ("?" + "&".join(p[1] for p in pairs) if pairs else "")


def resolve(href: str | None, base: str) -> str | None:
    """An absolute http(s) URL without fragment, or None for what leads to no other page."""
    href = (href or "").strip()
    if not href or href.startswith("#"):
        return None
    try:
        to = urljoin(base, href).partition("#")[0]
        return to if urlsplit(to).scheme in PORTS and urlsplit(to).netloc else None
    except ValueError:
        return None


def host_of(url: str | None) -> str | None:
    """Host with a port that is not the default one."""
    c = canonicalise(url)
    return c.split("/")[2] if c else None


def page_id(url: str) -> str:
    """A slug of the path and eight digits of the URL's hash."""
    path = re.match(r"[^:]+://[^/?#]*([^?#]*)", url)
    slug = re.sub(r"[^a-z0-9]+", "-", (path[1] if path else "").lower()).strip("-")[:80] or "_root"
    return f"{slug}-{hashlib.sha256(url.encode()).hexdigest()[:8]}"


@F.pandas_udf(T.StringType())
def canonicalise_col(urls: pd.Series) -> pd.Series:
    return urls.map(canonicalise, na_action="ignore")


def host_key(canonical: Column) -> Column:
    """Host of a canonical URL."""
    return F.nullif(F.split_part(canonical, F.lit("/"), F.lit(3)), F.lit(""))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Hosts are equal after one leading ``www.`` is dropped."""
    return bare_host(a) == bare_host(b)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)


def could_be_page(url: Column) -> Column:
    """The last path segment has no ending of a known asset."""
    ending = F.lower(F.regexp_extract(path_of(url), r"/[^/]+\.([A-Za-z0-9]+)$", 1))
    return ~ending.isin(*sorted(ASSETS))


def page_id_col(url: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(path_of(url)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(slug, 1, 80), F.lit("")), F.lit("_root")), F.lit("-"), F.substring(F.sha2(url, 256), 1, 8))
