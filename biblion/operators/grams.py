"""Pairs of texts that can be close: a lossless bound on the pairs of neighbouring letters that two texts share.

An edit changes at most two of them, so texts a and b with k edits or fewer share max(len a, len b) - 1 - 2k at least,
counted as often as they occur. Counted from the middles of the texts, a letter moves by k / 2 at most, so only letter
pairs at places that near count as shared. The shared ones of all pairs are one product of two matrices, in which letter
pairs that fall together only raise the count; the frequent ones have columns of their own. What is left is measured
exactly, many pairs at once, by machine words of one bit a letter. Texts meet in tiles of bounded size, of lengths that
the bound lets through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of a side in a tile, texts of a side in one product, columns for letter pairs and bits for words
# (powers of 2), pairs that are measured at a time, edits that one machine word has room for, steps between two looks at
# which pairs are already too far, tasks a core that the tiles are dealt to.
TILE, PART, COLUMNS, WORDS, PAIRS, BAND, LOOK, SPREAD = 4096, 512, 1024, 256, 4096, 31, 8, 8


def letter_pairs(a: list[str], b: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The length of each text of a and b, and a matrix whose rows' products are at least the number of letter pairs that
    a text of a and one of b share at places that differ by width / 2 at most, counted from the middles."""
    texts = a + b
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, number = np.unique(codes, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    both = owner[1:] == owner[:-1]
    text, letters = owner[1:][both], (number[:-1] * len(known) + number[1:])[both]
    zone = (2 * place[:-1][both] - sizes[text]) // max(width, 1)
    zone -= zone.min(initial=0) - 1  # from 1 on
    zones = int(zone.max(initial=1)) + 2
    ours = text < len(a)
    # a letter pair of b counts in its own zone and in those beside it
    rows = np.concatenate([text[ours], *[text[~ours]] * 3])
    code = np.concatenate([letters[ours] * zones + zone[ours], *[letters[~ours] * zones + zone[~ours] + d for d in (-1, 0, 1)]])
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(rows * np.int64(code.max(initial=0) + 1) + code)
    rows, code = rows[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])
    nth = np.arange(len(code)) - np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
    _, code = np.unique(code * np.int64(nth.max(initial=0) + 1) + nth, return_inverse=True)
    first = rows < len(a)
    n = int(code.max(initial=-1)) + 1
    often = np.bincount(code[first], minlength=n).astype(np.float64) * np.bincount(code[~first], minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(n)
    own = COLUMNS * 3 // 4
    column = np.where(rank < own, rank, own + rank % (COLUMNS - own))[code]
    met = (often > 0)[code]
    return sizes, np.bincount(rows[met] * COLUMNS + column[met], minlength=len(texts) * COLUMNS).reshape(len(texts), COLUMNS).astype(np.float32)


def word_bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text as bits, the frequent ones with bits of their own, and how many of its words have the bit
    of another one of it: texts share as many words at most as they share bits, and the lesser of these numbers."""
    words = [set(t.split(" ")) - {""} for t in texts]
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    rank = np.empty(len(number), np.int64)
    rank[np.argsort(-np.bincount(code, minlength=len(number)), kind="stable")] = np.arange(len(number))
    own = WORDS // 2
    bit = np.where(rank < own, rank, own + rank % own)[code]
    bits = np.zeros((len(texts), WORDS // 64), np.uint64)
    np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return bits, np.bincount(owner, minlength=len(texts)) - np.bitwise_count(bits).sum(1).astype(np.int64)


class Letters:
    """Texts as rows of letter numbers, and for each text and letter the places where it occurs, 64 to a machine word."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        known, number = np.unique(codes, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        longest = int(self.sizes.max(initial=1))
        self.rows = np.zeros((longest, len(texts)), np.int64)
        self.rows[place, owner] = number
        self.known, self.words = len(known), -(-longest // 64)
        self.where = np.zeros((self.words, len(texts) * self.known), np.uint64)
        np.bitwise_or.at(self.where, (place >> 6, owner * self.known + number), np.uint64(1) << (place & 63).astype(np.uint64))

    def edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The edit distance of texts i and j, pair by pair (the bit-parallel rows of Myers and Hyyrö)."""
        one, top = np.uint64(1), np.uint64(63)
        m, n = self.sizes[i], self.sizes[j]
        words = -(-int(m.max()) // 64)
        up, down = np.full((words, len(i)), ~np.uint64(0)), np.zeros((words, len(i)), np.uint64)
        last, bit = (m - 1) >> 6, ((m - 1) & 63).astype(np.uint64)
        row, score = i * self.known, m.copy()
        ends = [(last == w).astype(np.int64) for w in range(words)]
        for t in range(int(n.max())):
            at = row + self.rows[t, j]
            going = n > t
            more, less = one, np.uint64(0)  # what the word below hands up
            for w in range(words):
                eq, p, q = self.where[w, at], up[w], down[w]
                xv = eq | q
                eq |= less
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = q | ~(xh | p), p & xh
                step = ((ph >> bit) & one).astype(np.int64) - ((mh >> bit) & one).astype(np.int64)
                score += step * ends[w] * going
                ph_out, mh_out = ph >> top, mh >> top
                ph, mh = ph << one | more, mh << one | less
                up[w], down[w] = mh | ~(xv | ph), ph & xv
                more, less = ph_out, mh_out
        return score

    def near(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which of the texts i and j are limit edits apart or fewer, pair by pair, for limits of BAND at most that the
        difference of the lengths does not exceed.

        The rows of edits in a band: 64 rows about a column, moved down by one with it (Hyyrö). Followed is the diagonal
        that ends at the last letters, on which the distance never falls, so pairs leave as soon as it is too large."""
        one, full = np.uint64(1), ~np.uint64(0)
        k = int(limit.max())
        m, n = self.sizes[i], self.sizes[j]
        up, down = np.full(len(i), full << np.uint64(63 - k)), np.zeros(len(i), np.uint64)
        far, bit = np.maximum(m - n, 0), (63 - k + (m - n)).astype(np.uint64)
        row, which, good = i * self.known, np.arange(len(i)), np.zeros(len(i), bool)
        most, first = int(n.max()), int(n.min())
        for t in range(most):
            at = row + self.rows[t, j]
            start = t + k - 63  # the text's place at the lowest bit
            word, shift = start >> 6, np.uint64(start & 63)
            eq = self.where[word, at] >> shift if 0 <= word < self.words else np.uint64(0)
            if shift and 0 <= word + 1 < self.words:
                eq = eq | self.where[word + 1, at] << (np.uint64(64) - shift)
            same = (((eq & up) + up) ^ up) | eq | down
            right, left = down | ~(same | up), same & up
            step = (~same >> bit & one).astype(np.int64)
            far += step if t < first else step * (n > t)
            same >>= one
            up, down = left | ~(same | right), same & right
            if t % LOOK == LOOK - 1 or t + 1 == most:
                open_ = far <= limit
                over = n <= t + 1
                good[which[open_ & over]] = True
                stay = np.nonzero(open_ & ~over)[0]
                if not len(stay):
                    break
                if len(stay) < 0.8 * len(which):
                    up, down, far, bit, row, which, limit, j, n = (x[stay] for x in (up, down, far, bit, row, which, limit, j, n))
                    first = int(n.min())
        return good


def within(a: list[str], b: list[str], least: float, words: int = 0, ordered: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs within the bounds of length and of edits; where words is more than 0, only those that may
    share as many words. ordered: only pairs whose first text is the lesser."""
    texts = a + b
    limits = lambda la, lb: np.floor((1 - least) * (la + lb) + 1e-9)
    size, pairs = letter_pairs(a, b, int(limits(max(map(len, a), default=0), max(map(len, b), default=0))))
    bits, doubled = word_bits(texts) if words else (None, None)
    letters = Letters(texts)
    places = {t: k for k, t in enumerate(sorted(set(texts)))} if ordered else {}
    rank = np.array([places[t] for t in texts], np.int64) if ordered else None
    by_size = np.argsort(size[: len(a)], kind="stable"), len(a) + np.argsort(size[len(a) :], kind="stable")
    # how many letter pairs texts of two lengths share at least
    lengths, number = np.unique(size, return_inverse=True)
    la, lb = lengths[:, None], lengths[None, :]
    high = np.maximum(la, lb)
    shared = np.where(np.minimum(la, lb) >= least / (2 - least) * high - 1e-9, high - 1 - 2 * limits(la, lb), np.inf).astype(np.float32)
    for i in range(0, len(a), PART):
        for j in range(0, len(b), PART):
            x, y = by_size[0][i : i + PART], by_size[1][j : j + PART]
            asked = shared[number[x][:, None], number[y][None, :]]
            if np.isinf(asked).all():
                continue  # all of one side are too short for the other
            m, n = np.nonzero(pairs[x] @ pairs[y].T >= asked)
            m, n = x[m], y[n]
            if words:
                may = np.bitwise_count(bits[m] & bits[n]).sum(1, dtype=np.int64) + np.minimum(doubled[m], doubled[n]) >= words
                m, n = m[may], n[may]
            if ordered:
                less = rank[m] < rank[n]
                m, n = m[less], n[less]
            limit = limits(size[m], size[n]).astype(np.int64)
            for k in range(0, len(m), PAIRS):
                p, q, most = m[k : k + PAIRS], n[k : k + PAIRS], limit[k : k + PAIRS]
                banded = (most <= BAND) & (np.abs(size[p] - size[q]) <= most)
                good = np.zeros(len(p), bool)
                if banded.any():
                    good[banded] = letters.near(p[banded], q[banded], most[banded])
                if not banded.all():
                    good[~banded] = letters.edits(p[~banded], q[~banded]) <= most[~banded]
                if good.any():
                    yield p[good], q[good] - len(a)


def close_texts(left: DataFrame, right: DataFrame, blocks: list[str], least: float, words: int = 0, ordered: bool = False) -> DataFrame:
    """left(blocks..., a) and right(blocks..., b), each of distinct rows -> blocks..., a, b that pass
    joins.edit_bound and joins.length_bound. Where words is more than 0, pairs that share fewer are left out, though
    not all of them. ordered: only pairs with a < b by code
    points, for a table against itself."""
    width = math.log((2 - least) / least) * (1 + 1e-9)

    def sized(df: DataFrame, text: str) -> DataFrame:
        return df.where(F.length(text) > 0).withColumn("__c", F.floor(F.log(F.length(text)) / width))

    def tiles(df: DataFrame) -> DataFrame:
        return df.groupBy(*blocks, "__c").agg(F.ceil(F.count("*") / TILE).alias("__n"))

    def number(text: str, n: str) -> Column:
        return F.pmod(F.xxhash64(text), F.col(n))

    a, b = sized(left, "a"), sized(right, "b")
    near = tiles(a).select(*blocks, F.col("__c").alias("ca"), F.col("__n").alias("na"), F.explode(F.array(*[F.col("__c") + x for x in (-1, 0, 1)])).alias("cb"))
    near = near.join(tiles(b).select(*blocks, F.col("__c").alias("cb"), F.col("__n").alias("nb")), [*blocks, "cb"])
    at = [*blocks, "ca", "cb", "ta", "tb"]
    one = a.withColumnRenamed("__c", "ca").join(near, [*blocks, "ca"]).withColumn("ta", number("a", "na")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    two = b.withColumnRenamed("__c", "cb").join(near, [*blocks, "cb"]).withColumn("tb", number("b", "nb")).withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    rows = one.select(*at, F.lit(True).alias("first"), F.col("a").alias("text")).unionByName(two.select(*at, F.lit(False).alias("first"), F.col("b").alias("text")))
    fields = rows.schema
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in blocks), "a string", "b string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches)
        side = got.column("first").to_numpy()
        mine, theirs = (got.column("text").filter(pa.array(s)).combine_chunks() for s in (side, ~side))
        if not len(mine) or not len(theirs):
            return
        block = [got.column(c).slice(0, 1) for c in blocks]
        for i, j in within(mine.to_pylist(), theirs.to_pylist(), least, words, ordered):
            same = [pa.array(c.to_pylist() * len(i), c.type) for c in block]
            yield pa.RecordBatch.from_arrays([*same, mine.take(pa.array(i)), theirs.take(pa.array(j))], names=[*blocks, "a", "b"])

    # a tile is few bytes and much work, so the tasks must not be put together by their bytes
    context = rows.sparkSession.sparkContext
    return rows.repartition(SPREAD * context.defaultParallelism, *at).groupBy(*at).applyInArrow(run, schema)
