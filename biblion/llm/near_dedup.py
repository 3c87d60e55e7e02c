"""Operator 10: near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A text is the set of its shingles (WORDS words each, A-Z lower-cased; a shorter text with words is one shingle);
two texts are linked when the Jaccard similarity of their sets is THRESHOLD or more, and classes are the
connected components of links. With weighted=True a shingle's weight is how often the text has it, and the
similarity is that of weighted sets. Texts with the same word sequence are one text from the start: they are
collapsed by a partial aggregate on a 128-bit fingerprint, so copies never meet in pairs.

Signature. Darts are thrown at the plane (weight, rank) of every shingle: the number of darts in a cell is
Poisson, their place in the cell and their coordinate (0..K-1) are hashed, so the same cell holds the same darts
in every text. A dart counts when it lies under the shingle's weight. Ranks are opened in doubling levels until
every coordinate has a dart; the earliest dart of a coordinate is its value. Two texts agree on a coordinate
with probability equal to their (weighted) Jaccard similarity. Documents are taken in slices of about SLICE darts,
so memory does not follow the number of short texts in a batch.

Join. BANDS bands of ROWS coordinates: at similarity 0.8 all bands miss with probability 0.0004. Shingle sets are
made in a second scan, for members of buckets of two or more alone. A bucket is not expanded into pairs. First
every member is verified against the bucket's hub, the member that shares the most buckets with others (the
likely original), in groups of STAR members that each get the hub's set once. Members that are then in another
component than most of their bucket are strays: they meet all texts of that component, and the strays of a
bucket each other, in blocks of STAR texts or BLOCK_BYTES of sets that texts stream past. No candidate is skipped;
beyond the members, what is moved grows with the strays alone, by whole blocks. A very common band is one hot key of narrow
rows: hot keys are broadcast to their rows (join_groups). Components come from label propagation with pointer
jumping on tables; neither links nor labels are collected. What is sent to all tasks is checked: a filter of at
most 32 MB and tables of at most MAX_BROADCAST_ROWS rows, with a shuffled join beyond.

Edge cases. Null or empty text and text without words has no shingles: each such row is a class of its own
(class_id its doc_id, n_copies 1), for nothing is known to be the same. The class id is the smallest doc_id of
the class. Rows with a null doc_id take part, but sort last. Repeated rows are copies. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm import textvec as tv
from biblion.llm.bits import key_bits, passing
from biblion.llm.identity import drop_rows, keyed, text_key
from biblion.llm.shared import join_groups, small, stash, table

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
MAX_BROADCAST_ROWS = 1_000_000
STAR, BLOCK_BYTES, SLICE = 256, 1 << 20, 400_000
#: Rank at which the first level ends; every further level doubles the rank.
FIRST_RANK = 0.5
SCALE = 2.0**-53


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * SCALE


def darts(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signatures (docs x k, uint64) of weighted sets; documents without elements keep all-ones.

    element: fingerprints, weight: positive weights, doc: the document of each, in ascending order.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    rank = np.full(docs * k, np.inf)
    value = np.full(docs * k, full, np.uint64)
    # cells are one unit of weight wide; a weight of 2.5 opens three cells
    cell, owner = tv.ragged(np.zeros(len(weight), np.int64), np.ceil(weight).astype(np.int64))
    seed = tv.mix(element[owner] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    room, of = weight[owner] - cell, doc[owner]
    mass = np.bincount(doc, weights=weight, minlength=docs)
    open_docs = mass > 0
    low, level = 0.0, 0
    while open_docs.any():
        high = FIRST_RANK * 2.0**level
        live = open_docs[of]
        s, r, d = seed[live], room[live], of[live]
        h = tv.mix(s ^ np.uint64(level + 1))
        u, area = _unit(h), high - low
        # Poisson by inversion, a whole number of darts for every cell
        number = np.zeros(len(u), np.int64)
        term = acc = math.exp(-min(area, 600.0))
        i = 0
        while (more := u > acc).any() and i < 4000:
            number += more
            i += 1
            term *= area / i
            acc += term
            if term < 1e-18 and i > area:
                break
        which = np.flatnonzero(number)
        j, w = tv.ragged(np.zeros(len(which), np.int64), number[which])
        w = which[w]
        dart = tv.mix(h[w] + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        place = tv.mix(dart ^ np.uint64(0xA0761D6478BD642F))
        under = _unit(place) < r[w]
        dart, w = dart[under], w[under]
        at = low + area * _unit(tv.mix(dart ^ np.uint64(0xE7037ED1A0B428DB)))
        slot = d[w] * k + (tv.mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(k)).astype(np.int64)
        # the earliest dart of each coordinate, of equally early ones the smallest
        earliest, chosen = np.full(docs * k, np.inf), np.full(docs * k, full, np.uint64)
        np.minimum.at(earliest, slot, at)
        best = (at == earliest[slot]) & (at < rank[slot])
        np.minimum.at(chosen, slot[best], dart[best])
        new = np.unique(slot[best])
        rank[new], value[new] = earliest[new], chosen[new]
        low, level = high, level + 1
        # a level is closed as a whole, so a coordinate with a dart has its earliest one
        open_docs &= np.isinf(rank).reshape(docs, k).any(axis=1) if docs else open_docs
    return value.reshape(docs, k)


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    out = np.repeat(np.arange(1, n_bands + 1, dtype=np.uint64)[None, :], len(signature), axis=0)
    part = signature[:, : n_bands * rows].reshape(len(signature), n_bands, rows)
    for r in range(rows):
        out = tv.mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return out


def elements(texts: list, words: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, its weight, its document) sorted by document and shingle; word fingerprints, and each document's first."""
    buf, starts = tv.join(texts)
    fp, s, _ = tv.words(buf, tv.ALNUM)
    first = tv.per_doc(starts, s)
    n = np.diff(first)
    at, doc = tv.ragged(first[:-1], np.maximum(first[:-1], first[1:] - words + 1))
    element, owner = [tv.shingles(fp, words)[at]], [doc]
    for d in np.flatnonzero((n > 0) & (n < words)):  # a short text is one shingle
        element.append(tv.shingles(fp[first[d] : first[d + 1]], n[d]) ^ np.uint64(n[d]))
        owner.append(np.array([d]))
    element, doc = np.concatenate(element), np.concatenate(owner)
    order = np.argsort(element)
    narrow = doc[order].astype(np.uint16 if len(n) <= 1 << 16 else np.int64)  # narrow numbers are sorted by radix
    order = order[np.argsort(narrow, kind="stable")]
    element, doc = element[order], doc[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(element, prepend=~element[:1]) != 0)) if len(doc) else order
    weight = np.diff(np.append(new, len(doc))) if weighted else np.ones(len(new), np.int64)
    return element[new], weight, doc[new], fp, first


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """darts() for slices of documents with about SLICE darts each, or one longer document."""
    cut = np.searchsorted(doc, np.arange(docs + 1))
    total = np.concatenate([[0], np.cumsum(weight)])
    # a document needs about k ln k + 2k darts, and every cell of its shingles is looked at once at least
    upto = np.cumsum(total[cut[1:]] - total[cut[:-1]] + int(k * math.log(k) + 2 * k))
    out, a = [], 0
    while a < docs:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE, "right")))
        part = slice(cut[a], cut[b])
        out.append(darts(element[part], weight[part].astype(np.float64), doc[part] - a, b - a, k))
        a = b
    return np.concatenate(out) if out else np.zeros((0, k), np.uint64)


SIGNED = "row long, doc_id long, text_key long, text_fp binary, size long, bands array<long>"


def _sign(words: int, n_bands: int, rows_in_band: int, weighted: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for ids, texts, keys in keyed(frames):
            element, weight, doc, fp, first = elements(texts, words, weighted)
            docs = len(ids)
            key = bands(signatures(element, weight, doc, docs, n_bands * rows_in_band), n_bands, rows_in_band).view(np.int64)
            raw = fp.tobytes()
            text_fp = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + docs)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(text_fp, pa.binary()),
                pa.array(np.bincount(doc, weights=weight, minlength=docs).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * n_bands), pa.array(key.reshape(-1))),
            ], names=["row", "doc_id", "text_key", "text_fp", "size", "bands"])
            row += docs

    return run


def _sets(words: int, weighted: bool, bits):
    """The sets of the texts whose own_key may be wanted, each as sorted numbers; equal sets have equal bytes."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            key = batch.column("own_key").to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(passing(bits.value, key.view(np.uint64)))
            # of rows that are equal in a batch, one
            wanted = wanted[np.sort(np.unique(key[wanted], return_index=True)[1])]
            batch = batch.take(pa.array(wanted))
            rows = pa.RecordBatch.from_arrays([batch.column("own_key"), batch.column("text")], names=["doc_id", "text"])
            for ids, texts in tv.batches([rows]):
                element, weight, doc, *_ = elements(texts, words, weighted)
                if weighted:  # one number for every unit of weight
                    unit, owner = tv.ragged(np.zeros(len(weight), np.int64), weight)
                    element, doc = tv.mix(element[owner] + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), doc[owner]
                    order = np.lexsort((element, doc))
                    element, doc = element[order], doc[order]
                cut, flat = np.searchsorted(doc, np.arange(len(ids) + 1)) * 8, element.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["own_key", "shingles"]
                )

    return run


class Held:
    """Sets that others are compared with, as one sorted list of their elements."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.node, self.label = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.size = np.array([len(r[2]) for r in rows])
        element = np.concatenate([r[2] for r in rows])
        order = np.argsort(element, kind="stable")
        self.element, self.owner = element[order], np.repeat(np.arange(len(rows)), self.size)[order]

    def linked(self, label: int, own: np.ndarray, threshold: float) -> np.ndarray:
        """One node of every other label that has a set similar to own."""
        # sizes first: the similarity is the smaller by the larger at best
        if not ((np.minimum(self.size, len(own)) >= threshold * np.maximum(self.size, len(own)) - 1e-9) & (self.label != label)).any():
            return self.node[:0]
        low, high = np.searchsorted(self.element, own), np.searchsorted(self.element, own, "right")
        common = np.bincount(self.owner[tv.ragged(low, high)[0]], minlength=len(self.size))
        hit = np.flatnonzero((common >= threshold * (self.size + len(own) - common) - 1e-9) & (self.label != label))
        return self.node[hit[np.unique(self.label[hit], return_index=True)[1]]]


GROUP = ("kind", "key", "q", "r")


def _links(threshold: float):
    """Rows (GROUP, side, node, label, shingles) sorted by group and side -> links of nodes of side 1 to nodes of side 0."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held = None, [], None
        for batch in frames:
            found: list[tuple[int, int]] = []
            side, node, label = (batch.column(c).to_pylist() for c in ("side", "node", "label"))
            sets = batch.column("shingles")
            for i, at in enumerate(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True)):
                if at != group:
                    group, rows, held = at, [], None
                own = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if side[i] == 0:
                    rows.append((node[i], label[i], own.copy()))
                elif rows:
                    held = held or Held(rows)
                    found += [(node[i], b) for b in held.linked(label[i], own, threshold).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def verified(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the two sides of each group; rows: GROUP, side, node, label."""
    dealt = small(rows, MAX_BROADCAST_ROWS).join(sets.select("node", "shingles"), "node").select(*GROUP, "side", "node", "label", "shingles")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "side").mapInArrow(_links(threshold), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): the smallest node of each connected component.

    Each round every node takes the least label around it and then the label of its label; labels only fall, and
    the rounds end when none does. A chain of n nodes takes about log n rounds; each is one written table.
    """
    both = stash(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("degree")), "labels")
    while True:
        # a hub of many links, and later a label of many nodes, is one hot key of narrow rows
        seen = join_groups(both, label.select(F.col("node").alias("b"), "label", "degree"), "b", "degree")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", "label", "degree", F.least("label", "near").alias("low"))
        # the label that the label's own node has, and hooks: a node's label learns the low that the node saw
        hook = step.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        step = stash(step.join(hook, "node", "left").select("node", "label", "degree", F.least("low", F.coalesce("hook", "low")).alias("low")), "step")
        jump = step.groupBy("low").agg(F.count("*").alias("n")).join(step.select(F.col("node").alias("low"), F.col("low").alias("jump")), "low")
        after = join_groups(step, jump, "low", "n", "left").select("node", F.col("label").alias("before"), "degree", F.least("low", F.coalesce("jump", "low")).alias("label"))
        after = stash(after, "labels")
        moved = after.where("label < before").limit(1).count()
        label = after.drop("before")
        if not moved:
            return label.select("node", "label")


def buckets_of(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (node, size, bands) -> pairs (node, hub) to verify; members (band, node, size) and sizes (band, n) of larger buckets.

    Buckets of two are their pair. Of larger buckets with the same members one stays.
    """
    member = texts.select("node", "size", F.explode("bands").alias("band"))
    sized = stash(member.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"), "buckets")
    large = stash(join_groups(member, sized.where("n > 2").select("band", "n"), "band", "n"), "members")
    popular = large.groupBy("node").agg(F.sum("n").alias("shared"))
    hub = F.max(F.struct("shared", (-F.col("node")).alias("minus"))).alias("hub")
    same = (F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(0xFFFFFFFF)).alias("y"))
    named = large.join(popular, "node").groupBy("band").agg(hub, *same, F.max("n").alias("n"))
    named = named.groupBy("x", "y", "n").agg(F.min(F.struct("band", (-F.col("hub.minus")).alias("hub"))).alias("one"))
    named = stash(named.select("one.band", "one.hub", "n"), "hubs")
    star = join_groups(large.select("node", "size", "band"), named, "band", "n")
    pairs = star.where("node <> hub").select("node", "hub").union(sized.where("n = 2").select(F.col("high").alias("node"), F.col("low").alias("hub")))
    return stash(pairs.distinct(), "pairs"), star.select("band", "node", "size", "n"), named.select("band", "n")


def sets_of(docs: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, weighted: bool) -> DataFrame:
    """node, size, shingles of every text of pairs, from a second scan of docs (doc_id, text, text_key)."""
    own_key = F.xxhash64("text_key", "doc_id").alias("own_key")
    nodes = stash(pairs.select("node").union(pairs.select("hub")).distinct(), "nodes")
    wanted = texts.join(small(nodes, MAX_BROADCAST_ROWS), "node", "left_semi").select("node", "size", F.xxhash64("text_key", F.col("first_id").alias("doc_id")).alias("own_key"))
    wanted = stash(wanted, "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(wanted, "own_key", wanted.count()))
    made = docs.select("text", own_key).mapInArrow(_sets(words, weighted, bits), "own_key long, shingles binary")
    sets = stash(made.join(small(wanted, MAX_BROADCAST_ROWS), "own_key").select("node", "size", "shingles"), "sets")
    if not sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return sets
    return stash(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")), "sets")  # of repeated rows


def star_rows(pairs: DataFrame) -> DataFrame:
    """Groups of STAR members with their hub."""
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / STAR)).cast("int").alias("q")
    member = join_groups(pairs, hubs, "hub", "n").select("hub", part, "node")
    row = lambda side, node: (F.lit(0).alias("kind"), F.col("hub").alias("key"), "q", F.lit(0).alias("r"), F.lit(side).alias("side"), F.col(node).alias("node"), F.col(node).alias("label"))
    return member.select(*row(1, "node")).union(member.select("hub", "q").distinct().select(*row(0, "hub")))


def block_rows(kind: int, held: DataFrame, passed: DataFrame) -> DataFrame:
    """Groups in which rows of passed stream past blocks of held with the same key; both: key, node, label, size."""
    load = lambda df, what: df.groupBy("key").agg(F.sum("size").alias(what), F.count("*").alias(f"{what}_n"))
    plan = load(held, "h").join(load(passed, "p"), "key")
    plan = plan.select("key", (F.col("h_n") + F.col("p_n")).alias("n"), *(F.ceil(F.greatest(F.col(c) * 8 / BLOCK_BYTES, F.col(f"{c}_n") / STAR)).cast("int").alias(to) for c, to in (("h", "blocks"), ("p", "streams"))))
    plan = stash(plan, "plan")
    deal = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = lambda side, q, r: (F.lit(kind).alias("kind"), "key", q.alias("q"), r.alias("r"), F.lit(side).alias("side"), "node", "label")
    one = join_groups(held, plan, "key", "n").select(*row(0, deal(2, F.col("blocks")), every("streams")))
    return one.union(join_groups(passed, plan, "key", "n").select(*row(1, every("blocks"), deal(3, F.col("streams")))))


def stray_rows(members: DataFrame, buckets: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Groups for the candidates that are in different components after the hubs, if there are any."""
    named = members.join(label, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
    most = named.groupBy("band", "label").agg(F.count("*").alias("of_label")).groupBy("band")
    most = most.agg(F.max(F.struct("of_label", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("band", F.col("top.label").alias("major"))
    stray = join_groups(named, most.join(buckets, "band"), "band", "n").where("label <> major")
    stray = stash(stray.select("band", "major", "node", "label", "size"), "strays")
    if not stray.limit(1).count():
        return None
    # strays against all texts of the component that most of their bucket is in
    against = stray.select(F.col("major").alias("key"), "node", "label", "size").distinct()
    whole = sets.select("node", "size").join(label, "node", "left").select("node", "size", F.coalesce("label", "node").alias("label"))
    majors = whole.groupBy("label").agg(F.count("*").alias("n")).join(against.select(F.col("key").alias("label")).distinct(), "label")
    whole = join_groups(whole, majors, "label", "n").select(F.col("label").alias("key"), "node", "label", "size")
    # and strays of a bucket against each other
    several = stray.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n")
    each = join_groups(stray, several, "band", "n").select(F.col("band").alias("key"), "node", "label", "size")
    return block_rows(1, against, whole).union(block_rows(2, each, each))


def near_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, n_copies (texts with the same words), kept (one row of its class), text_key."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key())
    signed = stash(docs.mapInArrow(_sign(words, n_bands, rows, weighted), SIGNED), "signed")
    # one text of each word sequence; the smallest (doc_id, row) speaks for it
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row", "text_key")).alias("least")
    texts = signed.where("text_fp is not null").groupBy("text_fp").agg(least, F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = stash(texts.select("text_fp", F.col("least.row").alias("node"), F.col("least.doc_id").alias("first_id"), F.col("least.text_key").alias("text_key"), "n_copies", "size", "bands"), "texts")

    pairs, members, buckets = buckets_of(texts)
    sets = sets_of(docs, texts, pairs, words, weighted)
    links = stash(verified(star_rows(pairs), sets, threshold), "links")
    label = components(links)
    strays = stray_rows(members, buckets, label, sets)
    if strays is not None:
        more = stash(verified(strays, sets, threshold), "links")
        if more.limit(1).count():
            label = components(links.unionByName(more))

    # texts with copies or links; every other row speaks for itself
    named = stash(texts.select("text_fp", "node", "first_id", "n_copies").join(label, "node", "left").where("n_copies > 1 or label is not null"), "named")
    ids = named.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("no"), "first_id", "node")).alias("k"), F.count("*").alias("n"))
    linked = join_groups(named.where("label is not null"), ids, "label", "n").select("text_fp", F.col("k.first_id").alias("class_id"), F.col("k.node").alias("keep_row"), "n_copies")
    groups = linked.unionByName(named.where("label is null").select("text_fp", F.col("first_id").alias("class_id"), F.col("node").alias("keep_row"), "n_copies"))
    groups = stash(groups, "groups")
    alone = F.col("keep_row").isNull()
    return join_groups(signed.select("row", "doc_id", "text_key", "text_fp"), groups, "text_fp", "n_copies", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_key",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without the near copies of another one, all their columns as they are."""
    rows = stash(near_classes(docs, **options).select("doc_id", "text_key", "kept"), "kept")
    out = drop_rows(docs, rows.where("not kept"))
    # the row that stays may itself be there several times
    again = rows.groupBy("doc_id", "text_key").agg(F.max("kept").alias("one"), F.min("kept").alias("all"))
    again = stash(again.where(F.col("one") & ~F.col("all")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__own")), "again")
    if not again.limit(1).count():
        return out
    same = (F.col("__key") == F.col("__own")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    twice = docs.withColumn("__key", text_key()).join(again, same, "left_semi")
    return out.unionByName(twice.dropDuplicates(["doc_id", "__key"]).drop("__key"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).drop("text_key")
