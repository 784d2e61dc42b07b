"""Byte-level BPE with tiktoken and a local rank file: encoding, and decoding of raw bytes.

Long texts are cut before a single space that stands between two characters which
are not white space. The splitting pattern can have no match across such a place
and starts afresh there, so the ids are those of the whole text while memory
stays bounded; texts without such a place are encoded whole.

Cases: a null text counts as empty (no ids); null ids and repeated rows are kept;
an empty table gives an empty result; other columns are ignored. A lone surrogate
cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import map_arrow

#: Texts above this many characters are cut.
LONG = 1 << 16
SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG):
    """Cut at the first safe boundary at or after every ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers; special tokens are ordinary text."""
    if len(text) <= LONG:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text)])


def decode(ids: np.ndarray, enc: tiktoken.Encoding) -> bytes:
    """The raw bytes; they need not be valid UTF-8 for any ids."""
    return enc.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` as bytes."""
    extra = ", ids binary" if with_ids else ""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            n, ids_sha, text_sha, raw = [], [], [], []
            for text in b.column(1):
                ids = encode(text.as_py() or "", enc)
                data = ids.tobytes()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids, enc)).hexdigest())
                if with_ids:
                    raw.append(data)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
