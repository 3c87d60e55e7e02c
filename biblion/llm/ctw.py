"""Operator 7: language-model scoring by context-tree weighting over bytes.

A text is its words (A-Z lower-cased), joined by single spaces and closed by a line feed; this form and the
token list of the baseline say the same. Each byte is eight binary decisions, and each decision (the bits of
the byte seen so far) has its own tree over the DEPTH bytes before it. A node estimates a bit by
Krichevsky-Trofimov; its weighted probability is the half-half mixture of its own block probability and the
product of its children's. After training, the predictive probability mixes the estimates of all depths with
the posterior weights of that mixture. Nothing is learned while scoring.

Work. One pass counts the (DEPTH+1)-grams of all texts (held-out ones with count 0, so that every context that
scoring meets is in the table) and the training words; both are summed by a shuffle, in proportion to the input.
The tree is tables too. Grams are dealt by the SPLIT bytes before their byte and worked through a few contexts
at a time, which gives the nodes beyond depth SPLIT; the nodes above are summed depth by depth with groupBy, and
what they mix in goes down again by joins on the node above, which has at most 256 nodes under it. The depth is
the same at every size. A second pass over the texts adds the log probability of every byte: the most frequent
grams, at most MAX_GRAMS of them, are broadcast (24 bytes a gram at most), all others are joined by a shuffle.

Baseline words. The most frequent training words, at most MAX_HOT of them (a power of two of the count is the
threshold, so all words of a count are in or out together), are broadcast; all others are joined by a shuffle
on their 64-bit fingerprint. So no word is dropped, and no frequent word can make a hot key.

Edge cases. Null text counts as empty; an empty text is the end token alone. A null doc_id counts as the empty
string in the hold-out rule. Repeated rows are scored each. With no training text every c and N is 0 and every
byte costs eight bits; the baseline score is then null. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm import textvec as tv
from biblion.llm.shared import stash, table

DEPTH, SPLIT, MAX_GRAMS, MAX_HOT = 5, 3, 6_000_000, 1 << 19
PORTION = 1 << 19  # grams worked through at a time, or those of one context
END = np.uint64(0x656E64)  # the end token's fingerprint
SPACE, CLOSE = 32, 10
ALPHA = 0.1


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


# --- grams -----------------------------------------------------------------------------------------------


def grams(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram of every byte of every canonical text, where each text's grams start, word fingerprints, first words.

    A gram holds the byte in its lowest eight bits and the byte k places before it in the bits above 8k; bytes
    before the text are CLOSE.
    """
    fp, s, e = tv.words(buf, tv.SOLID)
    first = tv.per_doc(starts, s)
    docs = len(starts) - 1
    size = e - s + 1
    total = np.concatenate([[0], np.cumsum(size)])
    length = np.maximum(total[first[1:]] - total[first[:-1]], 1)
    out_start = np.cumsum(length + depth) - length
    out = np.full(int(out_start[-1] + length[-1]) if docs else 0, CLOSE, np.uint8)
    doc = np.repeat(np.arange(docs), np.diff(first))
    to = out_start[doc] + total[:-1] - total[first[:-1]][doc]
    source, owner = tv.ragged(s, e)
    out[source - s[owner] + to[owner]] = buf[source]
    ends = to + size - 1
    out[ends] = SPACE
    last = first[1:][np.diff(first) > 0] - 1
    out[ends[last]] = CLOSE
    wide = out.astype(np.uint64)
    gram = wide.copy()
    for k in range(1, depth + 1):
        gram[k:] |= wide[:-k] << np.uint64(8 * k)
    own = np.ones(len(out), bool)
    for k in range(1, depth + 1):
        own[out_start - k] = False
    return gram[own], np.cumsum(length) - length, fp, first


def _count(depth: int) -> Callable:
    """Rows (kind, key, n): kind 0 grams, 1 words, with their count in training texts."""

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        key, n = key[order], n[order]
        new = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, int)
        return (key[new], np.add.reduceat(n, new)) if len(key) else (key, n)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        for ids, texts in tv.batches(frames):
            buf, starts = tv.join(texts)
            gram, at, fp, first = grams(buf, starts, depth)
            train = np.array([not held_out(i) for i in ids])
            known = np.repeat(train, np.diff(np.append(at, len(gram))))
            for part, weight in ((gram[known], 1), (gram[~known], 0)):
                key, n = np.unique(part, return_counts=True)
                held[0].append((key, n * weight))
            key, n = np.unique(np.append(fp[np.repeat(train, np.diff(first))], np.full(int(train.sum()), END)), return_counts=True)
            held[1].append((key, n))
            for kind, parts in held.items():
                if sum(len(p[0]) for p in parts) > 2_000_000:
                    held[kind] = [merge(parts)]
                    if len(held[kind][0][0]) > 1_000_000:
                        yield rows(kind, *held[kind].pop())
        for kind, parts in held.items():
            if parts:
                yield rows(kind, *merge(parts))

    return run


# --- the tree --------------------------------------------------------------------------------------------


def _log_gamma(x, log):
    y = x + 8
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - log(x * (x + 1) * (x + 2) * (x + 3)) - log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(a, b, log=np.log):
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones (arrays, or columns with log=F.log)."""
    return _log_gamma(a + 0.5, log) + _log_gamma(b + 0.5, log) - _log_gamma(a + b + 1, log) - math.log(math.pi)


def _mask(depth: int) -> int:
    return (1 << 8 * depth + 8) - 1


def _bits(key: np.ndarray, n: np.ndarray, depth: int, split: int) -> Iterator[tuple]:
    """For each bit of the byte: its nodes at depth split with their sums (node, a, b, weighted, share), the node
    of each gram, whether its bit is one, and the bit's probability as mixed by all depths beyond split. At depth
    depth the share of a node's own estimate is 1.
    """
    byte, context = key & np.uint64(255), key >> np.uint64(8)
    n = n.astype(float)
    for k in range(8):
        node = context << np.uint64(8) | np.uint64(1 << k) | byte >> np.uint64(8 - k)
        one = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        node, at = np.unique(node, return_inverse=True)
        a, b = (np.bincount(at, weights=n * w, minlength=len(node)) for w in (~one, one))
        weighted, share, p = log_kt(a, b), np.ones(len(node)), np.zeros(len(key))
        for d in range(depth - 1, split - 1, -1):
            p = share[at] * (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1) + (1 - share[at]) * p
            node, up = np.unique(node & np.uint64(_mask(d)), return_inverse=True)
            a, b, inner = (np.bincount(up, weights=x, minlength=len(node)) for x in (a, b, weighted))
            own = log_kt(a, b)
            weighted = np.logaddexp(own, inner) - math.log(2)
            share = np.exp(own - math.log(2) - weighted)
            at = up[at]
        yield node, a, b, weighted, share, at, one, p


def tree_log10(key: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """log10 of the predictive probability of each gram's byte after its context; n: counts in training. All in one piece."""
    total = np.zeros(len(key))
    for _, a, b, _, share, at, one, p in _bits(key, n, depth, 0):
        total += np.log10(share[at] * (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1) + (1 - share[at]) * p)
    return total


def _whole(frames: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by context, in portions that hold whole contexts."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in frames:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= PORTION:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held = [[c[cut:] for c in columns]]
            size -= cut
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


NODES = "node long, a double, b double, weighted double, share double"
MODEL = "key long, n long, value float"


def _nodes(depth: int, split: int) -> Callable:
    """Rows (context, key, n), sorted by context -> the nodes at depth split."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n in _whole(frames):
            for node, a, b, weighted, share, *_ in _bits(key.view(np.uint64), n, depth, split):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node.view(np.int64), a, b, weighted, share)], names=[x.split()[0] for x in NODES.split(", ")])

    return run


def _values(depth: int, split: int) -> Callable:
    """Rows (context, key, n, zero, one, rest), sorted by context, grams and (n = -1) nodes at depth split -> MODEL."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, zero, one, rest in _whole(frames):
            key, up = key.view(np.uint64), np.flatnonzero(n < 0)
            up = up[np.argsort(key[up])]
            key, n, above, zero, one, rest = key[n >= 0], n[n >= 0], key[up], zero[up], one[up], rest[up]
            total = np.zeros(len(key))
            for node, _, _, _, _, at, bit, p in _bits(key, n, depth, split):
                to = np.searchsorted(above, node)[at]
                total += np.log10(np.where(bit, one[to], zero[to]) + rest[to] * p)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(total.astype(np.float32))], names=[x.split()[0] for x in MODEL.split(", ")])

    return run


def gram_model(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Distinct grams (key, n) -> (key, n, value): log10 of the predictive probability of the byte after its context."""
    split = min(SPLIT, depth)
    context = lambda c: F.shiftright(c, 8).bitwiseAND(F.lit(_mask(split) >> 8).cast("long")).alias("context")
    up = lambda d: F.col("node").bitwiseAND(F.lit(_mask(d)).cast("long"))
    grams = grams.select(context("key"), "key", "n")
    level = {split: stash(grams.repartition("context").sortWithinPartitions("context").mapInArrow(_nodes(depth, split), NODES), "nodes")}
    for d in range(split - 1, -1, -1):
        sums = level[d + 1].groupBy(up(d).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("inner"))
        sums = sums.withColumn("own", log_kt(F.col("a"), F.col("b"), F.log))
        more = F.greatest("own", "inner") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("inner")))) - math.log(2)
        sums = sums.withColumn("weighted", more)
        level[d] = stash(sums.select("node", "a", "b", "weighted", F.exp(F.col("own") - math.log(2) - F.col("weighted")).alias("share")), "nodes")
    # what depths 0 to d give a zero and a one, and what they leave to the depths beyond
    mixed = lambda c, x: F.col(f"{c}_up") + F.col("rest_up") * F.col("share") * (F.col(x) + 0.5) / (F.col("a") + F.col("b") + 1)
    top = None
    for d in range(split + 1):
        nodes = level[d]
        if top is None:
            nodes = nodes.select("*", F.lit(0.0).alias("zero_up"), F.lit(0.0).alias("one_up"), F.lit(1.0).alias("rest_up"))
        else:
            nodes = nodes.withColumn("up", up(d - 1)).join(top.select(F.col("node").alias("up"), *[F.col(c).alias(f"{c}_up") for c in ("zero", "one", "rest")]), "up")
        top = nodes.select("node", mixed("zero", "a").alias("zero"), mixed("one", "b").alias("one"), (F.col("rest_up") * (1 - F.col("share"))).alias("rest"))
    none = F.lit(0.0)
    rows = grams.select("context", "key", "n", none.alias("zero"), none.alias("one"), none.alias("rest")).unionByName(top.select(context("node"), F.col("node").alias("key"), F.lit(-1).cast("long").alias("n"), "zero", "one", "rest"))
    return stash(rows.repartition("context").sortWithinPartitions("context").mapInArrow(_values(depth, split), MODEL), "model")


class Lookup:
    """Open addressing from 64-bit keys to floats, in numpy."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, math.ceil(math.log2(max(1, len(key)) * 1.5)))
        size = 1 << self.bits
        self.at, self.key, self.value = np.full(size, -1, np.int32), key, value
        left, slot = np.arange(len(key), dtype=np.int32), self._slot(key)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for one slot the last stays
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (tv.mix(key) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, key: np.ndarray, missing: float = np.nan) -> np.ndarray:
        out = np.full(len(key), missing, np.float64)
        slot, left = self._slot(key), None
        while len(slot):
            at = self.at[slot]
            there = at >= 0
            same = there.copy()
            same[there] = self.key[at[there]] == (key if left is None else key[left])[there]
            (out.__setitem__)(np.flatnonzero(same) if left is None else left[same], self.value[at[same]])
            go = there & ~same
            left = np.flatnonzero(go) if left is None else left[go]
            slot = (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


# --- both passes -----------------------------------------------------------------------------------------

SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, score double, base_hot double, known_hot long, word int, fp long, times long"


def distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's keys once, and how often it has them."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(key, prepend=~key[:1]) != 0)) if len(key) else np.zeros(0, int)
    return doc[new], key[new], np.diff(np.append(new, len(key)))


def _score(depth: int, model, hot, norm: float | None) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for ids, texts in tv.batches(frames):
            buf, starts = tv.join(texts)
            gram, at, fp, first = grams(buf, starts, depth)
            value = model.value(gram)
            far = np.isnan(value)
            score = np.add.reduceat(np.where(far, 0.0, value), at)
            docs = len(ids)
            of = np.repeat(np.arange(docs), np.diff(np.append(at, len(gram))))
            doc = np.repeat(np.arange(docs), np.diff(first))
            count = hot.value(np.append(fp, END), -1.0)
            end, count = count[-1], count[:-1]
            known = count >= 0
            cost = lambda c: np.log10((c + ALPHA) / norm) if norm else np.full(np.shape(c), np.nan)
            base = np.bincount(doc[known], weights=cost(count[known]), minlength=docs) + cost(np.array(max(end, 0.0)))
            known_hot = np.bincount(doc[known], minlength=docs) + int(end > 0)
            # all other words and grams, once for each document
            (d, w, times), (gram_d, gram_w, gram_times) = distinct(doc[~known], fp[~known]), distinct(of[far], gram[far])
            rows = np.arange(row, row + docs)
            row += docs
            pad = len(d) + len(gram_d)
            blank = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(pad, t)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rows, rows[d], rows[gram_d]])), blank(ids, pa.int64()), blank([held_out(i) for i in ids], pa.bool_()),
                blank(np.diff(first) + 1, pa.int64()), blank(np.diff(np.append(at, len(gram))), pa.int64()), blank(score, pa.float64()), blank(base, pa.float64()), blank(known_hot, pa.int64()),
                pa.array(np.repeat(np.arange(3, dtype=np.int32), [docs, len(d), len(gram_d)])),
                pa.array(np.concatenate([rows, w.view(np.int64), gram_w.view(np.int64)])), pa.array(np.concatenate([np.zeros(docs, np.int64), times, gram_times])),
            ], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def _arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def _most_frequent(by_size: list, most: int) -> int | None:
    """The least power of two such that at most most rows have that count or more."""
    least, taken = None, 0
    for r in by_size:  # 64 rows at most
        taken += r["v"]
        if taken > most:
            break
        least = 1 << r["j"]
    return least


def score(docs: DataFrame, depth: int = DEPTH, max_grams: int = MAX_GRAMS, max_hot: int = MAX_HOT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = stash(docs.mapInArrow(_count(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    by_size = lambda df, n: df.groupBy(F.floor(F.log2(n)).cast("int").alias("j")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("j")).collect()
    grams = gram_model(counts.where("kind = 0").select("key", "n"), depth)
    seen = F.col("n") + 1  # grams of held-out texts alone have n = 0
    least_gram = _most_frequent(by_size(grams, seen), max_grams)
    got = _arrow(grams.where(seen >= least_gram if least_gram else F.lit(False)).select("key", "value"))  # max_grams rows at most
    model = spark.sparkContext.broadcast(Lookup(got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy()))

    words = counts.where("kind = 1 and n > 0")
    sizes = by_size(words, F.col("n"))
    vocabulary, tokens = sum(r["v"] for r in sizes), sum(r["n"] for r in sizes)
    norm = tokens + ALPHA * (vocabulary + 1)
    least = _most_frequent(sizes, max_hot)
    top = _arrow(words.where(F.col("n") >= least if least else F.lit(False)).select("key", "n"))
    hot = spark.sparkContext.broadcast(Lookup(top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)))

    rows = docs.mapInArrow(_score(depth, model, hot, norm if tokens else None), SCORED)
    cold = words.select(F.lit(1).alias("word"), F.col("key").alias("fp"), F.col("n").alias("c"), F.lit(None).cast("float").alias("value"))
    if least:
        cold = cold.where(F.col("c") < least)
    if least_gram != 1:
        cold = cold.unionByName(grams.where(seen < least_gram if least_gram else F.lit(True)).select(F.lit(2).alias("word"), F.col("key").alias("fp"), F.lit(None).cast("long").alias("c"), "value"))
    c = F.coalesce("c", F.lit(0))
    rest = F.when(F.col("word") == 1, F.col("times") * F.log10((c + F.lit(ALPHA)) / F.lit(norm)))
    known = F.when(F.col("c") > 0, F.col("times"))
    far = F.when(F.col("word") == 2, F.col("times") * F.col("value").cast("double"))
    doc = lambda x: F.max(x).alias(x)  # noqa: E731  one row of a document has it
    out = rows.join(cold, ["word", "fp"], "left").select("row", "doc_id", "held_out", "n_tokens", "n_bytes", "score", "base_hot", "known_hot", rest.alias("rest"), known.alias("known"), far.alias("far"))
    out = out.groupBy("row").agg(*map(doc, ("doc_id", "held_out", "n_tokens", "n_bytes", "score", "base_hot", "known_hot")), F.sum("rest").alias("rest"), F.sum("known").alias("known"), F.sum("far").alias("far"))
    base, total = F.col("base_hot") + F.coalesce("rest", F.lit(0.0)), F.col("score") + F.coalesce("far", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known_hot") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (base if tokens else F.lit(None).cast("double")).alias("base_score"), total.alias("score"), "n_bytes", (-total * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
