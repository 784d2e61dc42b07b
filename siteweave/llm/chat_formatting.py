"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn by turn, as
``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Inside roles and
texts each ``<`` that backslashes (or none) and a ``|`` follow gets one backslash
more, so no control string can arise there and the step can be undone. The whole
is encoded once, with offsets; the sorted spans of the assistant's texts meet the
token spans by binary search, and a token is under the loss mask if it overlaps
one.

Rows are grouped by a shuffle and sorted by turn, role and text; a worker holds
one conversation at a time.

Cases: null texts and roles are empty; null turns come first; repeated rows are
turns of their own; null conversation ids form one conversation; an empty table
gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from tokenizers import AddedToken, Tokenizer

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END) + "\n", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@dataclass
class Formatted:
    text: str
    #: Starts and ends of the assistant's texts in ``text``, sorted.
    spans: np.ndarray


def render(turns: list[tuple[str, str]]) -> Formatted:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return Formatted("".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2))


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(text)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer with the template's three markers as tokens of their own; other special strings are ordinary text."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = False
    t.add_tokens([AddedToken(m, special=False, normalized=False) for m in (START, SEP, END)])
    t.encode_special_tokens = True
    return t


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token, given by ``offsets(start, end)`` in order, overlaps one of the sorted ``spans``."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    # The first span that ends behind the token's start is the only one that can come before its end.
    k = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    hit = k < len(spans)
    hit[hit] = spans[k[hit], 0] < offsets[hit, 1]
    return hit


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id. A byte-level vocabulary writes printable bytes as themselves and the others, in order, from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    t = tokenizer(path)
    out = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def masked_texts(ids: np.ndarray, hit: np.ndarray, pieces: list[bytes]) -> list[str]:
    """The texts under the mask, one for each run of tokens; markers are tokens of their own, so no token lies on both sides of a run's end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [unescape(b"".join(pieces[i] for i in ids[a:b].tolist()).decode()) for a, b in edges.reshape(-1, 2)]


def encode(formatted: Formatted, tok: Tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets in code points, and the loss mask."""
    enc = tok.encode(formatted.text, add_special_tokens=False)
    ids = enc.ids
    offsets = np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
    return np.array(ids, dtype=np.uint32), offsets, mask(offsets, formatted.spans)


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(conv_id, formatted, ids, loss_mask, n_tokens)``, one row per conversation: ids as unsigned 32-bit integers, the mask as bits."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        tok, key, turns, out = tokenizer(tokenizer_path), None, None, []

        def close():
            f = render(turns)
            ids, _, hit = encode(f, tok)
            out.append((key, f.text, ids.astype("<u4").tobytes(), np.packbits(hit).tobytes(), len(ids)))

        def batch(schema):
            rows = out[:]
            out.clear()
            kinds = [schema, pa.string(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "formatted", "ids", "loss_mask", "n_tokens"])

        schema = pa.int64()
        for b in batches:
            schema = b.schema.field(0).type
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if turns is None or conv != key:
                    if turns is not None:
                        close()
                    key, turns = conv, []
                turns.append((role or "", text or ""))
            if len(out) > 200:
                yield batch(schema)
        if turns is not None:
            close()
        if out:
            yield batch(schema)

    dealt = rows.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt.select("conv_id", "role", "text"), run, f"conv_id {kind}, formatted string, ids binary, loss_mask binary, n_tokens long")


def digest(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests: turns from the text, the loss texts from ids and mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        pieces = token_bytes(tokenizer_path)
        for b in batches:
            n, turns_sha, loss, loss_sha, size = [], [], [], [], []
            for text, ids, bits, tokens in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                turns = parse(text)
                n.append(len(turns))
                turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=tokens).astype(bool)
                under = "".join(masked_texts(np.frombuffer(ids, "<u4"), hit, pieces))
                loss.append(len(under))
                loss_sha.append(hashlib.sha256(under.encode()).hexdigest())
                size.append(len(text))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(loss, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64()), b.column(4)]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    return map_arrow(formatted.select("conv_id", "formatted", "ids", "loss_mask", "n_tokens"), run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
