"""Vectorised word work on UTF-8 bytes: many documents at once, numpy only.

Documents are joined with line feeds into one buffer; words are maximal runs of word bytes. A word's
fingerprint is a polynomial hash modulo 2**64 followed by a mixer. Buffers are worked through in pieces that
are cut between words, so the memory beyond the words themselves is bounded by PIECE and the longest word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.compute as pc

PIECE = 1 << 20
#: Bytes of text that batches() puts together.
BATCH = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_power = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    """n powers of the base, or more."""
    global _power
    if n > len(_power):
        base = np.full(max(256, 2 * n), _BASE, np.uint64)  # odd, so no power is 0 modulo 2**64
        base[0] = 1
        _power = np.cumprod(base, dtype=np.uint64)
    return _power


#: a-z, 0-9 and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[ord("A") : ord("Z") + 1] = ALNUM[128:] = True
#: All but space and 0x09-0x0D.
SOLID = np.ones(256, bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (A-Z lower-cased), each followed by a line feed; where each one starts, and the end."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    parts.append(b"")
    return LOWER[np.frombuffer(b"\n".join(parts), np.uint8)], starts


def _spans(buf: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(word[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def words(buf: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, start and end of each word of the buffer, in order."""
    found, at = [], 0
    while at < len(buf):
        end = min(at + PIECE, len(buf))
        while end < len(buf) and word[buf[end - 1]]:  # to the end of a word
            gap = np.flatnonzero(~word[buf[end : end + PIECE]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + PIECE, len(buf))
        piece = buf[at:end]
        s, e = _spans(piece, word)
        if len(s):
            size = e - s
            power = _powers(int(size.max()) + 1)
            # only the bytes of words, one after another
            first = np.cumsum(size) - size
            own = np.arange(int(size.sum()), dtype=np.int64)
            own -= np.repeat(first, size)
            value = piece[own + np.repeat(s, size)].astype(np.uint64)
            value += np.uint64(1)
            value *= power[own]
            found.append((mix(np.add.reduceat(value, first)), s + at, e + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def per_doc(starts: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """For each document, the index of its first word, and the number of all words."""
    return np.searchsorted(word_starts, starts)


def shingles(fp: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n consecutive words at each place where n words follow."""
    if len(fp) < n:
        return np.zeros(0, np.uint64)
    out = fp[: len(fp) - n + 1].copy()
    for j in range(1, n):
        out = mix(out * np.uint64(_BASE) + fp[j : len(fp) - n + 1 + j])
    return out


def ragged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges [begin, end), one range after another, and the number of the range of each."""
    size = np.maximum(end - begin, 0)
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size), owner


def batches(frames: Iterable, id_col: str = "doc_id", text_col: str = "text", most: int = BATCH) -> Iterator[tuple[list, list]]:
    """Ids and texts of Arrow batches in portions of about most characters; a longer text is a portion of its own."""
    for batch in frames:
        ids, column = batch.column(id_col).to_pylist(), batch.column(text_col)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        at = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield ids[at:i], column.slice(at, i - at).to_pylist()
                at, size = i, 0
            size += n
        if at < len(ids):
            yield ids[at:], column.slice(at).to_pylist()
