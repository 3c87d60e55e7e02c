"""Operator 5: benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of WINDOW words (an item of fewer words is one window). A window is a set
of word shingles (SHINGLE words each, fewer where the window is shorter). Containment must be total, so one
shingle is a sufficient prefix: the window's rarest by its count over all documents. A window of which any
shingle never occurs cannot occur and is dropped. Places of prefix shingles in documents join the windows on
the shingle, pass the positional bound (the window must begin inside the document) and the length bound (and
end inside it), and are verified word by word.

What reaches every task is a bit array of 128 bits a shingle, 2 MB to 32 MB (bits.py); a bit that is set by chance
costs a place that the join then drops. Up to MAX_BROADCAST_ROWS windows of MAX_BROADCAST_BYTES are broadcast too:
the tasks that read the documents join and verify, PAIRS pairs at a time, and give a row a document, however often a
passage occurs. More windows are joined by a shuffle, whose hot shingles AQE splits: documents then emit a row for
each place of a prefix shingle, with the words around it, PAIRS rows at a time. Both give the same rows.

Edge cases. Null or empty text has no words: n_words 0, no hit. An item without words has no window. Repeated
items, and windows that several items share, name all their items. Null item_ids are left out of the list.
Repeated doc_ids are judged row by row. Empty tables give no hits or no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm import textvec as tv
from biblion.llm.bits import bits_of, key_bits, passing
from biblion.llm.identity import drop_rows, keyed, text_key
from biblion.llm.shared import stash, table

WINDOW, SHINGLE, LEAST_BITS = 10, 3, 24
#: Windows that are broadcast, and bytes of their words and item_ids.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 50_000, 16 << 20
#: Pairs of a place and a window, or rows of places, that a task holds at once; a place's own windows are never parted.
PAIRS = 1 << 16


def _fingerprints(fp: np.ndarray, size: int) -> np.ndarray:
    return tv.mix(tv.shingles(fp, size) ^ np.uint64(size))


def _windows(window: int, shingle: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in tv.batches(frames, "item_id"):
            buf, starts = tv.join(texts)
            fp, s, e = tv.words(buf, tv.ALNUM)
            first = tv.per_doc(starts, s)
            out: list[tuple] = []
            for d, item in enumerate(ids):
                a, b = first[d], first[d + 1]
                n = min(window, b - a)
                size = min(shingle, n)
                if n:
                    own = _fingerprints(fp[a:b], size).view(np.int64).tolist()
                    word = [buf[x:y].tobytes().decode() for x, y in zip(s[a:b], e[a:b], strict=True)]
                    out += [(item, " ".join(word[i : i + n]), int(n), own[i : i + n - size + 1]) for i in range(b - a - n + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())))], names=["item_id", "window", "n", "fps"]
            )

    return run


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, window (its words), n, fps (fingerprints of its shingles in order)."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return items.mapInArrow(_windows(window, shingle), "item_id long, window string, n int, fps array<long>")


def _places(buf, starts, sizes, bits):
    """Words of the buffer, first word of each document, and (place, fingerprint) of shingles that pass the filter."""
    fp, s, e = tv.words(buf, tv.ALNUM)
    first = tv.per_doc(starts, s)
    at, found = [], []
    for size in sizes:
        own = _fingerprints(fp, size)
        hit = np.flatnonzero(passing(bits, own))
        owner = np.searchsorted(first, hit, "right") - 1
        hit = hit[hit + size <= first[owner + 1]]  # not across documents
        at.append(hit)
        found.append(own[hit])
    at, found = np.concatenate(at), np.concatenate(found)
    return s, e, first, at, found


def _counts(sizes, bits):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in tv.batches(frames):
            _, _, _, _, found = _places(*tv.join(texts), sizes, bits.value)
            fp, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    return run


def _known(prefix: DataFrame) -> tuple:
    """Windows by prefix shingle: fingerprints, where the windows of each start, offsets, word numbers, words (each with a space after it), items, bits."""
    got = prefix.select("fp", "offset", "n", "window", "items").toArrow().combine_chunks()
    fp = got.column("fp").to_numpy().view(np.uint64)
    order = np.argsort(fp, kind="stable")
    fps, start = np.unique(fp[order], return_index=True)
    offset, n = (got.column(c).to_numpy().astype(np.int64)[order] for c in ("offset", "n"))
    window, items = got.column("window").to_pylist(), got.column("items").to_pylist()
    return fps, np.append(start, len(fp)), offset, n, [window[i].encode() + b" " for i in order], [items[i] for i in order], bits_of(fps, LEAST_BITS)


def _line(buf: np.ndarray) -> bytes:
    """The words of the buffer, each with a space after it."""
    inside = tv.ALNUM[buf]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # every text ends with a line feed
    return np.where(inside, buf, np.uint8(0x20))[kept].tobytes()


def _portions(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to most; what is larger by itself is a range of its own."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + most, "right")))
        yield a, b
        a = b


def _found(buf, starts, sizes, known):
    """First word of each document, and of each window found: document, number, first word, end."""
    fps, start, offset, n, window, _, bits = known
    s, e, first, at, fp = _places(buf, starts, sizes, bits)
    slot = np.searchsorted(fps, fp)
    real = np.flatnonzero(fps[np.minimum(slot, len(fps) - 1)] == fp) if len(fps) else np.zeros(0, np.int64)
    at, slot = at[real], slot[real]
    out = [np.zeros((4, 0), np.int64)]
    if len(at):
        line, place = _line(buf), np.concatenate([[0], np.cumsum(e - s + 1)])
        length = np.fromiter(map(len, window), np.int64, len(window))
        doc = np.searchsorted(first, at, "right") - 1
    for a, b in _portions(start[slot + 1] - start[slot], PAIRS):
        k, own = tv.ragged(start[slot[a:b]], start[slot[a:b] + 1])
        d, begin = doc[a:b][own], at[a:b][own] - offset[k]
        end = begin + n[k]
        fits = np.flatnonzero((begin >= first[d]) & (end <= first[d + 1]))
        fits = fits[place[end[fits]] - place[begin[fits]] == length[k[fits]]]
        d, k, begin, end = d[fits], k[fits], begin[fits], end[fits]
        same = [line[x:y] == window[w] for x, y, w in zip(place[begin].tolist(), place[end].tolist(), k.tolist(), strict=True)]
        out.append(np.stack([d, k, begin, end])[:, np.array(same, bool)])
    return first, np.concatenate(out, axis=1)


JUDGED = "doc_id long, text_key long, n_words long, n_hit long, items array<string>"


def _judged(sizes, known):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value[5]
        for ids, texts, keys in keyed(frames):
            first, (d, k, begin, end) = _found(*tv.join(texts), sizes, known.value)
            # windows open at each word, then hit words before each word
            depth = np.cumsum(np.bincount(begin, minlength=first[-1] + 1) - np.bincount(end, minlength=first[-1] + 1))
            n_hit = np.diff(np.concatenate([[0], np.cumsum(depth > 0)])[first])
            named: list[set] = [set() for _ in ids]
            for x in np.unique(d * len(items) + k).tolist():
                named[x // len(items)].update(items[x % len(items)])
            whole = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.diff(first)), pa.array(n_hit), pa.array([sorted(map(str, x)) for x in named], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(whole, names=[x.split()[0] for x in JUDGED.split(", ")])

    return run


CANDIDATE = "row long, doc_id long, text_key long, n_words long, fp long, place int, around_from int, around string"


def _rows(*columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = [x.split() for x in CANDIDATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _candidates(sizes, bits, window):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for ids, texts, keys in keyed(frames):
            buf, starts = tv.join(texts)
            s, e, first, at, found = _places(buf, starts, sizes, bits.value)
            rows = np.arange(row, row + len(ids))
            row += len(ids)
            yield _rows(rows, ids, keys, np.diff(first), *[[None] * len(ids)] * 4)
            for a in range(0, len(at), PAIRS):
                here, fps = at[a : a + PAIRS], found[a : a + PAIRS]
                doc = np.searchsorted(first, here, "right") - 1
                low = np.maximum(first[doc], here - window + 1)
                high = np.minimum(first[doc + 1], here + window)
                around = [b" ".join(bytes(buf[s[i] : e[i]]) for i in range(x, y)).decode() for x, y in zip(low, high, strict=True)]
                yield _rows(rows[doc], [ids[d] for d in doc], [keys[d] for d in doc], np.diff(first)[doc], fps.view(np.int64), here - first[doc], low - first[doc], around)

    return run


def _by_shuffle(docs: DataFrame, prefix: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """The columns of JUDGED, for any number of windows."""
    rare = prefix.select("fp").distinct()
    few = docs.sparkSession.sparkContext.broadcast(key_bits(rare, "fp", rare.count(), LEAST_BITS))
    rows = stash(docs.mapInArrow(_candidates(sizes, few, window), CANDIDATE), "candidates")

    begin = F.col("place") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), begin - F.col("around_from") + 1, F.col("n")), " ") == F.col("window")
    hits = rows.where("fp is not null").join(prefix, "fp").where(fits).where(same)
    # the words of a document that lie in any span, added up over the spans in order of their start
    spans = F.sort_array(F.collect_set(F.struct(begin.alias("a"), (begin + F.col("n")).alias("b"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.b - F.greatest(acc.to, x.a))).cast("long").alias("n"), F.greatest(acc.to, x.b).alias("to")),
        lambda acc: acc.n,
    )
    hits = hits.groupBy("row").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hits = hits.select("row", covered.alias("n_hit"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.where("fp is null").join(hits, "row", "left").select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, text_key."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key())
    by_item = stash(benchmark_windows(benchmark, window, shingle), "windows")
    sizes = sorted(r[0] for r in by_item.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect()) or [shingle]

    shingles = by_item.select(F.explode("fps").alias("fp")).distinct()
    bits = spark.sparkContext.broadcast(key_bits(shingles, "fp", shingles.count(), LEAST_BITS))
    counted = docs.select("doc_id", "text").mapInArrow(_counts(sizes, bits), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    counted = shingles.join(counted, "fp")

    # the rarest shingle of each distinct window; a window with a shingle that never occurs goes
    windows = by_item.groupBy("window").agg(F.first("n").alias("n"), F.first("fps").alias("fps"), F.array_compact(F.collect_set("item_id")).alias("items"))
    places = windows.select("window", F.size("fps").alias("size"), F.posexplode("fps").alias("place", "fp")).join(counted.withColumnRenamed("n", "often"), "fp")
    prefix = places.groupBy("window").agg(F.min(F.struct("often", "place", "fp")).alias("rare"), F.count("*").alias("there"), F.first("size").alias("size"))
    prefix = prefix.where("there = size").select("window", F.col("rare.place").alias("offset"), F.col("rare.fp").alias("fp"))
    prefix = stash(prefix.join(windows.drop("fps"), "window"), "prefixes")
    there = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + 8 * F.size("items")), F.lit(0))).first()
    if there[0] <= MAX_BROADCAST_ROWS and there[1] <= MAX_BROADCAST_BYTES:
        judged = docs.mapInArrow(_judged(sizes, spark.sparkContext.broadcast(_known(prefix))), JUDGED)
    else:
        judged = _by_shuffle(docs, prefix, sizes, window)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a word of a benchmark window, all their columns as they are."""
    found = decontaminate(docs, benchmark, **options).where("contaminated").select("doc_id", "text_key")
    return drop_rows(docs, stash(found, "contaminated"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
with b as (select item_id, {_WORDS.format("text")} as w from benchmark where text is not null),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
    from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
p as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
    from (select d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) as i from d, (select distinct n from win) l where len(d.w) >= l.n)),
h as (select p.doc_id, p.i, p.n, win.item_id from p join win on win.n = p.n and win.g = p.g),
x as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from h) group by doc_id),
y as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
    from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x using (doc_id) left join y using (doc_id)
"""
