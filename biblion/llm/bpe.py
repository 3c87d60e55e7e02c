"""Operator 9: byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until a piece has LEAF characters or fewer; pieces are encoded by the tokenizer, and
neighbours are joined up the tree. Only tokens near a joint can differ from those of the whole text. The joint's window
grows, by doubling, until it ends on both sides at a boundary that every context has: a place after a letter and
before a character that is no letter. No alternative of the pattern goes on from a letter to anything but
a letter, and none looks back, so a match ends there in any text. Tokens outside the window therefore provably
stay; the window is encoded anew and its old tokens are cut off by their bytes. Without such a boundary the
window grows to the whole of both halves. Decoding concatenates the bytes of halves up the same tree.

Each row is independent: no shuffle, and a task's memory is a batch's texts and ids.

Edge cases. Null text counts as empty: no tokens. A text without letters or without anything else is one window.
Special tokens' strings are ordinary text. Repeated rows are encoded each; further columns are ignored, also
when they are named like a result column.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from unicodedata import ucd_3_2_0 as ucd  # categories that no later version has changed between letter and not

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm import textvec as tv
from biblion.llm.shared import table

LEAF = 1024


class Coder:
    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        by_bytes = {base64.b64decode(a): int(b) for a, b in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=by_bytes, special_tokens={})
        self.of_id: dict[int, bytes] = {i: b for b, i in by_bytes.items()}
        self.size = np.zeros(max(self.of_id) + 1, np.int64)
        for i, b in self.of_id.items():
            self.size[i] = len(b)

    # --- encoding ---

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self._encode(text, 0, len(text), leaf)

    def _encode(self, text: str, low: int, high: int, leaf: int) -> np.ndarray:
        if high - low <= leaf:
            return np.array(self.encoding.encode_ordinary(text[low:high]), np.uint32)
        mid = (low + high) // 2
        return self._join(text, low, mid, high, self._encode(text, low, mid, leaf), self._encode(text, mid, high, leaf))

    def _join(self, text: str, low: int, mid: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = low, high
        reach = 16
        while True:
            at = max(low, mid - reach)
            found = next((p for p in range(mid - 1, at, -1) if _boundary(text, p)), None)
            if found is not None:
                a = found
            if found is not None or at == low:
                break
            reach *= 2
        reach = 16
        while True:
            to = min(high, mid + reach)
            found = next((p for p in range(mid + 1, to) if _boundary(text, p)), None)
            if found is not None:
                b = found
            if found is not None or to == high:
                break
            reach *= 2
        keep = self._cut(left[::-1], len(text[a:mid].encode()))
        skip = self._cut(right, len(text[mid:b].encode()))
        return np.concatenate([left[: len(left) - keep], self._window(text[a:b]), right[skip:]])

    def _window(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def _cut(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up n_bytes; a boundary of every context never cuts through one."""
        n, at = 0, 32
        while True:
            total = np.cumsum(self.size[ids[:at]])
            n = int(np.searchsorted(total, n_bytes, "left")) + 1 if n_bytes else 0
            if n <= len(total) or at >= len(ids):
                break
            at *= 4
        if n and total[n - 1] != n_bytes:
            raise AssertionError("a boundary lies inside a token")
        return n

    # --- decoding ---

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.of_id.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def _letter(c: str) -> bool:
    return c.isalpha() and (c.isascii() or ucd.category(c)[0] == "L")


def _boundary(text: str, p: int) -> bool:
    after = text[p]
    return _letter(text[p - 1]) and not after.isalpha() and (after.isascii() or ucd.category(after)[0] in "PZNS")


_loaded: dict = {}


def coder(spec: tuple[bytes, str]) -> Coder:
    """One per worker process and vocabulary."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = Coder(*spec)
    return _loaded[key]


ENCODED = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode(spec, leaf: int, with_ids: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        for ids, texts in tv.batches(frames):
            coded = [own.encode(t or "", leaf) for t in texts]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            columns = [pa.array(ids, pa.int64())]
            if with_ids:
                columns.append(pa.array([c.view(np.int32) for c in coded], pa.list_(pa.int32())))
            columns += [pa.array([len(c) for c in coded], pa.int64()), pa.array([sha(c.astype("<u4").tobytes()) for c in coded]), pa.array([sha(own.decode(c, leaf)) for c in coded])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ENCODED.split(", ") if with_ids or not x.startswith("ids ")])

    return run


def vocabulary(ranks_path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The file's bytes and the pattern; the public vocabulary where none is named."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(ranks_path, "rb") as f:
        return f.read(), pattern


def encode(docs: DataFrame, spec: tuple[bytes, str], leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (left out on request), n_tokens, ids_sha256, decoded_sha256."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encode(sent, leaf, with_ids), ENCODED if with_ids else ENCODED.replace("ids array<int>, ", ""))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
