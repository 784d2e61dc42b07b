"""Quality rules: a hashed n-gram log-likelihood ratio between trusted text and the whole corpus.

Words and word pairs are hashed into buckets, whose number grows with the corpus.
One pass counts the buckets of every document, and apart from that those of the
trusted documents. Words and pairs are a multinomial each; that of the trusted
text is mixed with the corpus' own (``MIX``), so an n-gram that the trusted sample
merely missed costs no more than the log of its share. The score of a document is
its mean log ratio per word plus that per pair; below the threshold it is
rejected. The threshold is not chosen by the data at hand: it is the fixed
parameter ``THRESHOLD`` in nats.

Trusted documents are rows labelled of good quality and not toxic, at most
``TRUSTED`` of them, those of least hash; everything else covers all rows.

Base rules, besides: fewer than ten words, or more than a fifth of the words in
five-word windows that occur twice or more in the text.

Cases: a null text has no words (and fails the base rule); without trusted
documents the base rules decide alone; null ids are judged but never trusted;
repeated rows get a row each; an empty table gives an empty result; extra columns
are ignored, or carried along by ``keep_good``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ID, TEXT_HASH, by_keys, checkpointed, map_arrow, stored

#: Buckets of words, and a quarter as many of pairs: 2 to the power of these bits at least, and at most (a bound on the memory of a worker; more n-grams then share a bucket).
LEAST_BITS, MOST_BITS = 16, 25
#: Buckets grow as this power of the corpus' characters, like the number of different words does.
GROWTH, PER, PAIR_BITS = 0.6, 4, 2
TRUSTED = 20_000
#: Share of the corpus' distribution in that of the trusted text, for words and for pairs.
MIX = (0.5, 0.9)
THRESHOLD = -0.25
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
# Fixed values of the base counts.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
PIECE = 1 << 18
#: N-grams that a worker holds before it counts them.
FLUSH = 1 << 21


def bucket_bits(chars: int) -> int:
    """Bits of a bucket number for a corpus of so many characters."""
    return min(MOST_BITS, max(LEAST_BITS, round(math.log2(PER * max(chars, 1) ** GROWTH))))


def buckets(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words, and of all pairs of neighbours (behind those of words)."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mult, drop = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    one = h * mult >> drop
    two = ((h[:-1] * mult ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) * mult >> drop + np.uint64(PAIR_BITS)) + np.uint64(1 << bits)
    return one.astype(np.int64), two.astype(np.int64)


def pieces(text: str | None, bits: int):
    """Bucket numbers of a text, in parts of bounded size; parts share a word, so no pair is missed."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    for i in range(0, len(words), PIECE):
        one, two = buckets(words[i : i + PIECE + 1], bits)
        yield one[: min(PIECE, len(words) - i)], two


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur at least twice, the first occurrence included.

    Words are numbered, then windows are numbered by extending them word by word; each step is exact.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    at = ids
    for size in range(2, WINDOW + 1):
        _, at = np.unique(at[: n - size + 1] * np.int64(len(number)) + ids[size - 1 :], return_inverse=True)
        if at.max() + 1 == len(at):
            return 0
    twice = np.bincount(at)[at] > 1
    inside = np.zeros(n, bool)
    for k in range(WINDOW):
        inside[k : n - WINDOW + 1 + k] |= twice
    return int(inside.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    spaces = sum(data.count(c) for c in SPACES)
    return len(words), len(text) - spaces, sum(data.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """Ids of trusted documents, at most ``most``: a bounded sample of labelled rows, by least hash."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.array(sorted(r[0] for r in rows), dtype=np.int64)


def count_ngrams(docs: DataFrame, trusted: np.ndarray, bits: int) -> DataFrame:
    """``(bucket, raw, target)``: counts in all documents and in the trusted ones, stored."""
    shared = docs.sparkSession.sparkContext.broadcast(trusted)
    schema = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches):
        own = shared.value
        held, good_held, n = [], [], 0

        def batch():
            k, raw = np.unique(np.concatenate(held), return_counts=True)
            target = np.zeros(len(k), np.int64)
            if good_held:
                at, c = np.unique(np.concatenate(good_held), return_counts=True)
                target[np.searchsorted(k, at)] = c
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw.astype(np.int64)), pa.array(target)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                doc_id = doc_id.as_py()
                at = int(np.searchsorted(own, doc_id)) if doc_id is not None else len(own)
                good = at < len(own) and own[at] == doc_id
                for k in pieces(text.as_py(), bits):
                    held += k
                    if good:
                        good_held += k
                    n += len(k[0]) + len(k[1])
                if n > FLUSH:
                    yield batch()
                    held, good_held, n = [], [], 0
        if n:
            yield batch()

    parts = map_arrow(docs.select("doc_id", "text"), run, "bucket long, raw long, target long")
    return stored(parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "ngrams")


def log_ratios(counts: DataFrame, bits: int) -> np.ndarray:
    """Log of target over raw probability for every bucket, words first; zeros where nothing is trusted. What reaches the driver is bounded by the buckets."""
    pair = (F.col("bucket") >= 1 << bits).cast("int")
    totals = {r[0]: (r[1], r[2]) for r in counts.groupBy(pair.alias("p")).agg(F.sum("raw"), F.sum("target")).collect()}
    out = np.zeros((1 << bits) + (1 << bits - PAIR_BITS), np.float32)
    if not totals.get(0, (0, 0))[1]:
        return out
    table = counts.select("bucket", F.col("raw").cast("double"), F.col("target").cast("double")).toArrow()
    at, raw, target = (table.column(i).to_numpy() for i in range(3))
    for p, mix in enumerate(MIX):
        if not totals.get(p, (0, 0))[1]:
            continue
        own = (at >> bits) == p
        out[at[own]] = np.log((1 - mix) * (target[own] / totals[p][1]) / (raw[own] / totals[p][0]) + mix)
    return out


def text_score(text: str | None, weights: np.ndarray, bits: int) -> float | None:
    """Mean log ratio per word plus that per pair; None without words."""
    sums, n = [0.0, 0.0], [0, 0]
    for k in pieces(text, bits):
        for p in (0, 1):
            sums[p], n[p] = sums[p] + float(weights[k[p]].sum(dtype=np.float64)), n[p] + len(k[p])
    return sums[0] / n[0] + (sums[1] / n[1] if n[1] else 0.0) if n[0] else None


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: its keys, the base counts, ``base_failed``, ``score`` (null without words or a model) and ``kept``."""
    trusted = trusted_ids(labels)
    bits, weights = LEAST_BITS, np.zeros(0, np.float32)
    if len(trusted):
        bits = bucket_bits(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
        found = log_ratios(count_ngrams(docs, trusted, bits), bits)
        weights = found if found.any() else weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for t in b.column(2):
                text = t.as_py() or ""
                counts = base_counts(text)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
                score = text_score(text, w, bits) if len(w) else None
                for c, v in zip(cols, (*counts, failed, score, not failed and (score is None or score >= threshold)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[ID, TEXT_HASH, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(F.col("doc_id").alias(ID), F.xxhash64("text").alias(TEXT_HASH), "text"), run, f"{ID} {kind}, {TEXT_HASH} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    bad = checkpointed(judge(docs, labels).where("NOT kept").select(ID, TEXT_HASH).distinct())
    return by_keys(docs, bad, "left_anti").select(docs.columns)
