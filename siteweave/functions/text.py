"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as browsers and scripts see it, with no-break spaces and the byte order mark.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
SCHEMA = ("http://schema.org/", "https://schema.org/")


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def count_words(text: Column) -> Column:
    n = normalise(text)
    return F.when(n == "", 0).otherwise(F.size(F.split(n, " ")))


def block_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.lower(normalise(text)), 256), 1, 16)


def finding_id(check: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", check, key), 256), 1, 12)


def short_iri(iri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(iri, r"^https?://schema\.org/", ""), r"^.*[/#]", "")


def https_schema(iri: Column) -> Column:
    return F.regexp_replace(iri, r"^http://schema\.org/", "https://schema.org/")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit fingerprints held as longs."""
    return F.bit_count(a.bitwiseXOR(b))


def simhash(text: Column, size: int = 3) -> Column:
    """64-bit SimHash over word shingles, repeats voting again; 16 hexadecimal digits, zeros for no words.

    Each shingle's first 64 bits of SHA-256 vote; votes are counted bit by bit over the array, without leaving the JVM.
    """
    # One struct in an array: what a lambda refers to is computed once, not for each of the 64 bits.
    let = lambda value, then: F.transform(F.array(value), then)[0]
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    half = lambda s, at: F.conv(F.substring(s, at, 8), 16, 10).cast("long")
    digest = lambda w, i: F.sha2(F.array_join(F.slice(w, i, size), " "), 256)
    halves = lambda w: F.transform(starts(w), lambda i: let(digest(w, i), lambda s: F.struct(half(s, 1).alias("high"), half(s, 9).alias("low"))))

    def digits(v: Column, part: str) -> Column:
        on = lambda at: 2 * F.size(F.filter(v, lambda x: F.call_function("shiftright", x[part], at).bitwiseAND(1) != 0)) > F.size(v)
        bits = F.transform(F.sequence(F.lit(31), F.lit(0)), lambda at: F.when(on(at), "1").otherwise("0"))
        return F.lpad(F.lower(F.conv(F.array_join(bits, ""), 2, 16)), 8, "0")

    words = F.filter(F.split(normalise(F.lower(text)), " "), lambda w: w != "")
    voted = let(words, lambda w: F.when(F.size(w) == 0, F.lit("0" * 16)).otherwise(let(halves(w), lambda v: F.concat(digits(v, "high"), digits(v, "low")))))
    return F.when(text.isNotNull(), voted)


def useless_alt(alt: Column) -> Column:
    """Alt text that is an image's file name or says only that there is an image."""
    stem = F.regexp_replace(F.lower(F.trim(alt)), r"\.(?:jpe?g|png|gif|webp|svg|avif|bmp|tiff?)$", "")
    return (F.trim(alt) != "") & (stem.rlike(r"^(?:image|img|photo|picture|pic|graphic|icon|logo|untitled|placeholder|banner|thumbnail)[\s_-]*\d*$") | stem.rlike(r"^(?:img|dsc|dscn|dscf|pict|p|screenshot)[\s_-]*\d{2,}[\w-]*$"))
