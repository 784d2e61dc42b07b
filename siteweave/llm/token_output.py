"""Binary token output: one zstandard frame per document, a shared dictionary, and an offset index.

Documents are dealt into ranges of ascending id, encoded with the tokenizers
library, and written as blocks. A block is

    magic "SWT1", u8 bytes per id, 3 zero bytes, 32 bytes SHA-256 of the dictionary,
    u32 number of documents, u64 offsets (one more than documents), frames

all little-endian. Each frame is one document's ids, compressed on its own with
the dictionary, so a short document is read by its two offsets alone. Blocks lie
in a Parquet table ``blocks`` with the ids of their documents, beside a table
``dictionary``; any store that Spark can write to will do.

The dictionary is trained on the serialized ids of a bounded sample: at most
``2 * SAMPLE`` rows of at most ``SAMPLE_CHARS`` characters, of the ``SAMPLE`` ids of least hash.
It affects sizes only, never contents.

Text is cut for encoding before single spaces between two characters that are not
white space. Byte-level pre-splitting has a boundary at each such place, so every
part is encoded once and its ids are kept in a bounded cache.

Cases: a null text is empty and has the end id only; null document ids come first;
rows with one id are ordered by a hash of the text; repeated rows are written each;
an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer, models

from .common import fresh_path, map_arrow, shared_dir

MAGIC = b"SWT1"
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 32_768, 65_536
BLOCK_IDS, LEVEL = 1 << 21, 3
CACHE, CACHED_CHARS = 1_000_000, 48
SAFE = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Whole texts to ids, part by part, with a cache of parts that follow a space."""

    def __init__(self, path: str) -> None:
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        # The same model without its own cache, which parts that are all different only slow down.
        model = json.loads(self.tok.to_str())["model"]
        self.tok.model = models.BPE(vocab=model["vocab"], merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], cache_capacity=0)
        vocab = self.tok.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        # In a byte-level vocabulary each character of a token stands for one byte.
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.spaced: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Encode parts without inner spaces, many at once: each behind its space is cut off from its neighbours anyway."""
        groups = [parts[j : j + 2048] for j in range(0, len(parts), 2048)]
        for i in range(0, len(groups), 16):
            some = groups[i : i + 16]
            lines = [" " + " ".join(g) for g in some]
            for group, line, e in zip(some, lines, self.tok.encode_batch_fast(lines, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.kind)
                ends = np.cumsum(np.fromiter(map(len, line.encode("utf-8", "surrogatepass").split(b" ")[1:]), np.int64, len(group)) + 1)
                cuts = ((np.searchsorted(np.cumsum(self.size[ids]), ends) + 1) * self.width).tolist()
                data, a = ids.tobytes(), 0
                for p, b in zip(group, cuts, strict=True):
                    self.spaced[p] = data[a:b]
                    a = b

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, serialized."""
        if len(self.spaced) > CACHE:
            self.spaced.clear()
        get = self.spaced.get
        rows: list[tuple[str, list[str], list[bytes | None]]] = []
        new: set[str] = set()
        odd: set[str] = set()  # parts with spaces inside
        for t in texts:
            parts = t.split(" ")
            head = parts.pop(0)
            found = list(map(get, parts))
            if None in found or parts and (not head or head[-1].isspace()):
                fresh = {p for p, ids in zip(parts, found, strict=True) if ids is None}
                # Known parts have no white space at either end. If a fresh one has, or is empty, or the head ends in it, some cut was not safe.
                listed = list(fresh)
                if "" in fresh or list(map(str.strip, listed)) != listed or parts and (not head or head[-1].isspace()):
                    head, *parts = SAFE.split(t)
                    parts = [p[1:] for p in parts]
                    found = list(map(get, parts))
                    fresh = {p for p, ids in zip(parts, found, strict=True) if ids is None}
                    odd |= {p for p in fresh if " " in p}
                new |= fresh
            rows.append((head, parts, found))
        self._learn(list(new - odd))
        self.spaced.update(zip(odd, self._plain([" " + p for p in odd]), strict=True))
        first = self._plain([head for head, _, _ in rows])
        out = []
        for ids, (_, parts, found) in zip(first, rows, strict=True):
            if None in found:
                found = [x if x is not None else get(p) for p, x in zip(parts, found, strict=True)]
            out.append(ids + b"".join(found))
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.spaced[p]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary, or plain content where the samples are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack(documents: list[bytes], width: int, dictionary: bytes) -> bytes:
    """One block of serialized documents."""
    own = _dictionary(dictionary)
    z = zstandard.ZstdCompressor(level=LEVEL, dict_data=own) if own else zstandard.ZstdCompressor(level=LEVEL)
    frames = [z.compress(d) for d in documents]
    offsets = np.cumsum([0, *map(len, frames)], dtype="<u8")
    return b"".join([MAGIC, bytes([width, 0, 0, 0]), hashlib.sha256(dictionary).digest(), struct.pack("<I", len(frames)), offsets.tobytes(), *frames])


class Block:
    """A block opened for reading; documents are decompressed one by one."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        if data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.kind, (self.n,) = np.dtype(f"<u{data[4]}"), struct.unpack_from("<I", data, 40)
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, 44)
        self.data, self.base = data, 44 + 8 * (self.n + 1)
        own = _dictionary(dictionary)
        self.z = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        a, b = (self.base + int(self.offsets[k + i]) for i in (0, 1))
        return np.frombuffer(self.z.decompress(self.data[a:b]), self.kind).astype("<u4")


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Write ``blocks`` and ``dictionary`` under ``path``."""
    spark = docs.sparkSession
    # Ids of least hash among about twenty times as many as are wanted, so no task sends more than these few numbers.
    n, h = docs.count(), F.xxhash64("doc_id")
    least = docs.select(h.alias("h")).where(F.pmod("h", F.lit(max(1, n // (20 * SAMPLE)))) == 0).orderBy("h").limit(SAMPLE).collect()
    some = docs.where(h.isin([r[0] for r in least])).where(F.length("text").between(1, SAMPLE_CHARS)).select("text").limit(2 * SAMPLE).collect()
    dictionary = train_dictionary(encoder(tokenizer_path).encode_all(sorted(r[0] for r in some)))
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("block", pa.binary())])

    def run(batches):
        enc, seq, shard = encoder(tokenizer_path), 0, TaskContext.get().partitionId()
        held_ids, held, n = [], [], 0
        end = np.array([end_id], enc.kind).tobytes()

        def block():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([n // enc.width], pa.int64()), pa.array([held_ids], pa.list_(pa.int64())), pa.array([pack(held, enc.width, shared.value)], pa.binary())], schema=schema)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_all([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    held_ids.append(doc_id)
                    held.append(ids + end)
                    n += len(held[-1])
                    if n >= BLOCK_IDS * enc.width:
                        yield block()
                        seq, held_ids, held, n = seq + 1, [], [], 0
        if held:
            yield block()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    map_arrow(dealt.select("doc_id", "text"), run, "shard int, seq int, ids long, doc_ids array<long>, block binary").write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the blocks under ``path``."""
    blocks = spark.read.schema("shard int, seq int, ids long, doc_ids array<long>, block binary").parquet(f"{path}/blocks")
    (data,) = (bytes(r[0]) for r in spark.read.parquet(f"{path}/dictionary").select("data").collect())
    shared = spark.sparkContext.broadcast(data)
    # Where each block starts: within its shard, and one row per shard before it.
    own = blocks.select("shard", "seq", "ids")
    inner = own.withColumn("before", F.sum("ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("ids"))
    shards = own.groupBy("shard").agg(F.sum("ids").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    places = inner.join(shards, "shard").select("shard", "seq", (F.col("before") + F.col("base")).alias("at"))

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                block, at = Block(b.column(2)[row].as_py(), shared.value), b.column(0)[row].as_py()
                starts, sizes, crcs = [], [], []
                for k in range(block.n):
                    ids = block.ids(k)
                    starts.append(at)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(1)[row].as_py(), pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.drop("ids").join(F.broadcast(places) if places.limit(200_001).count() <= 200_000 else places, ["shard", "seq"])
    return map_arrow(placed.select("at", "doc_ids", "block"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents into the shared folder, then read them back from there."""
    shared_dir(docs.sparkSession)
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, end_id, path)
    return read_tokens(docs.sparkSession, path)
