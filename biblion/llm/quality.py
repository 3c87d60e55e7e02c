"""Operator 4: quality classifier by ordinal cumulative-link regression on graded ratings.

Ratings are graded 0 (low quality), 1 (good but toxic), 2 (good and clean). One weight vector over hashed text
features is shared by all grades, and ordered thresholds cut its score: P(grade <= j) = sigmoid(cut_j - score).
A document gets its expected grade and the tail probability P(grade = 2), which selection compares with the
value that KEEP_CLEAN of the clean documents reach in a fifth of the labelled ones that the fit has not seen.

Features of whole texts: words, their first 4 and 5 bytes, runs of marks, and repeats of the word before; counts
enter as log(1 + n), divided by the square root of their norm. Training takes every labelled document, whole:
their features are written once, and each step of the fit (L-BFGS, on the driver) is one pass over them that sends
back a gradient a task. Up to DRIVER_BYTES of features the passes are made on the driver. A document's share of a
gradient is rounded to 2**-30, so sums are exact and the model is the same for any number and order of tasks.
Weights (4 * 2**BITS bytes) are broadcast.

Edge cases. Labels without quality or doc_id are left out, null toxic counts as 0; several labels of a document
count as the worst of them. Null or empty text has no features: its score is 0. Without labels every weight is
0 and every document is kept. Repeated rows are judged each; an empty table gives an empty result. Columns other
than the ones named pass through `select_clean` as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm import textvec as tv
from biblion.llm.shared import small, stash, table

#: STEPS: passes over the labelled documents at most.
BITS, GRADES, STEPS, DECAY, FOLDS, KEEP_CLEAN = 18, 3, 100, 1e-4, 5, 0.985
#: Entries (a feature of a document) that the fit works on at a time, and of a row of features.
CHUNK = 1 << 19
#: Steps that the fit looks back on.
HISTORY = 30
#: Bytes of features up to which the fit runs on the driver, tasks of a pass beyond, labelled ids that are broadcast.
DRIVER_BYTES, TASKS, MAX_IDS = 8 << 20, 32, 1_000_000
#: The fit ends when five steps together raise the mean log likelihood by less.
ENOUGH = 1e-4
_LOG = np.log1p(np.arange(1 << 16))
#: Shares of a gradient are multiples of 1 / UNIT.
UNIT = float(1 << 30)
PART = "folds binary, grades binary, scales binary, features binary, sizes binary, docs binary, counts binary"
MARK = tv.SOLID & ~tv.ALNUM
MARK_SALT, REPEAT = np.uint64(0x6D61726B), np.uint64(0x726570656174 << 16)


class Model(NamedTuple):
    weights: np.ndarray
    cuts: np.ndarray
    least: float  # tail probability from which a document is kept


def _counts(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, number) of all texts, in ascending order of text."""
    buf, starts = tv.join(texts)
    fp, s, e = tv.words(buf, tv.ALNUM)
    marks, at, _ = tv.words(buf, MARK)
    keys, places = [fp, tv.mix(marks ^ MARK_SALT)], [s, at]
    for k in (4, 5):
        long = s[e - s >= k]
        head = np.full(len(long), k, np.uint64)
        for j in range(k):
            head = head << np.uint64(8) | buf[long + j]
        keys.append(tv.mix(head))
        places.append(long)
    owner = np.searchsorted(starts, s, "right")
    again = np.flatnonzero((fp[1:] == fp[:-1]) & (owner[1:] == owner[:-1])) + 1  # of the same text
    keys.append(np.full(len(again), REPEAT))
    places.append(s[again])
    doc = np.searchsorted(starts, np.concatenate(places), "right") - 1
    key, n = np.unique(doc.astype(np.int64) << BITS | (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def _values(doc: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
    value = _LOG[n]
    return value / (np.bincount(doc, weights=value**2, minlength=texts) ** 0.25)[doc]


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts, in ascending order of text."""
    doc, feature, n = _counts(texts)
    return doc, feature, _values(doc, np.minimum(n, 65_535), len(texts))


class Part(NamedTuple):
    """Features of some documents by feature: each one's entries are the documents that have it."""

    fold: np.ndarray
    grade: np.ndarray
    scale: np.ndarray  # of each document; an entry's value is value * scale
    feature: np.ndarray  # ascending
    size: np.ndarray  # entries of each feature
    doc: np.ndarray
    value: np.ndarray


def _by_feature(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by feature, the distinct features and the number of each."""
    order = np.argsort(feature, kind="stable")
    return order, *np.unique(feature[order], return_counts=True)


def _parts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled documents, those of many in a row; a row is either fitted or held out."""
    waiting = {True: [], False: []}

    def row(held: bool) -> pa.RecordBatch:
        folds, grades, sizes, features_, counts = (np.concatenate(x) for x in zip(*waiting[held], strict=True))
        waiting[held].clear()
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int32), sizes)
        scale = 1 / np.maximum(np.bincount(doc, weights=_LOG[counts] ** 2, minlength=len(sizes)) ** 0.25, 0.5)  # less only without features
        order, distinct, size = _by_feature(doc, features_)
        columns = (folds, grades, scale, distinct, size.astype(np.int32), doc[order], counts[order])
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=[c.split()[0] for c in PART.split(", ")])

    for batch in frames:
        rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])
        for ids, texts in tv.batches([rows]):
            doc, feature, n = _counts(texts)
            own = batch.slice(ids[0], len(ids))
            fold, grade = (own.column(c).to_numpy().astype(np.int8) for c in ("fold", "grade"))
            sizes = np.bincount(doc, minlength=len(texts)).astype(np.int32)
            for held in (True, False):
                some = (fold == 0) == held
                if some.any():
                    at = some[doc]
                    waiting[held].append((fold[some], grade[some], sizes[some], feature[at].astype(np.int32), np.minimum(n[at], 65_535).astype(np.uint16)))
                    if sum(len(x[3]) for x in waiting[held]) >= CHUNK:
                        yield row(held)
    for held in (True, False):
        if waiting[held]:
            yield row(held)


def _read(batch) -> Iterator[Part]:
    """Each row that _parts has made."""
    for row in zip(*(batch.column(k) for k in range(7)), strict=True):
        docs = len(row[0].as_buffer())
        kinds = (np.int8, np.int8, float, np.int32, np.int32, np.uint16 if docs <= 1 << 16 else np.int32, np.uint16)
        fold, grade, scale, feature, size, doc, n = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, kinds, strict=True))
        yield Part(fold, grade.astype(np.int64), scale, feature, size, doc, _LOG[n])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _scores(w, part: Part) -> np.ndarray:
    n = len(part.scale)
    own, out = np.arange(n), np.zeros(n)
    weight = np.repeat(w[part.feature], part.size)
    for a in range(0, len(part.doc), CHUNK):
        # on top of what there is, so the sums are the same for any chunks
        b = a + CHUNK
        out = np.bincount(np.concatenate([own, part.doc[a:b]]), weights=np.concatenate([out, weight[a:b] * part.value[a:b]]), minlength=n)
    return out * part.scale


def sums(w, cuts, part: Part) -> np.ndarray:
    """Log likelihood, its gradient by the cuts and by the weights, summed in whole units of 1 / UNIT."""
    n, grade = len(part.grade), part.grade
    s = _scores(w, part)
    below = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None, :] - s[:, None]), np.ones((n, 1))], axis=1)
    slope = below * (1 - below)
    row = np.arange(n)
    p = np.maximum(below[row, grade + 1] - below[row, grade], 1e-9)
    upper, lower = slope[row, grade + 1] / p, slope[row, grade] / p
    whole = lambda x: np.round(x * UNIT)
    by_cut = [whole(upper[grade == j]).sum() - whole(lower[grade == j + 1]).sum() for j in range(GRADES - 1)]
    by_weight = np.zeros(len(w))
    if len(part.doc):
        pull = (lower - upper) * part.scale * UNIT
        first = np.cumsum(part.size) - part.size
        for a in range(0, len(part.doc), CHUNK):
            b = min(a + CHUNK, len(part.doc))
            i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b)
            by_weight[part.feature[i:j]] += np.add.reduceat(np.round(pull[part.doc[a:b]] * part.value[a:b]), np.maximum(first[i:j] - a, 0))
    return np.concatenate([[whole(np.log(p)).sum()], by_cut, by_weight])


def _entries(doc, feature, value, grade) -> Part:
    order, distinct, size = _by_feature(doc, feature)
    return Part(np.ones(len(grade), np.int8), grade, np.ones(len(grade)), distinct, size, doc[order], value[order])


def slopes(w, cuts, doc, feature, value, grade) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean log likelihood by the weights and by the cuts."""
    mean = sums(w, cuts, _entries(doc, feature, value, grade)) / UNIT / len(grade)
    return mean[GRADES:], mean[1:GRADES]


def _climb(total, n: int, steps: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the greatest penalised likelihood by L-BFGS; total(w, cuts) gives the sums of n documents."""
    # cuts are the first one and the logs of the gaps, so their order can't break
    k = GRADES - 1
    cuts_of = lambda x: np.cumsum(np.concatenate([x[:1], np.exp(x[1:k])]))

    def look(x):
        got = total(x[k:], cuts_of(x)) / UNIT / n
        tail = np.cumsum(got[1 : 1 + k][::-1])[::-1]
        pull = np.concatenate([tail[:1], tail[1:] * np.exp(x[1:k])])
        return got[0] - decay * (x[k:] @ x[k:]) / 2, np.concatenate([pull, got[1 + k :] - decay * x[k:]])

    x = np.concatenate([[-1.0], np.zeros(k - 1), np.zeros(1 << BITS)])
    (now, g), used, past, best = look(x), 1, [], []
    while used < steps and np.abs(g).max() > 1e-7:
        step, held = g.copy(), []
        for s, y, curve in reversed(past):
            held.append((s @ step) / curve)
            step -= held[-1] * y
        if past:
            s, y, curve = past[-1]
            step *= curve / np.square(y, dtype=float).sum()
        else:
            step /= max(np.sqrt(step @ step), 1e-12)
        for (s, y, curve), h in zip(past, reversed(held), strict=True):
            step += s * (h - (y @ step) / curve)
        rise, size = g @ step, 1.0
        while used < steps:
            place = x + size * step
            place[k:] = place[k:].astype(np.float32)  # as passes are sent them
            there, slope = look(place)
            used += 1
            if there >= now + 1e-4 * size * rise:
                break
            size /= 2
        else:
            break
        moved, turned = place - x, g - slope
        if moved @ turned > 1e-12 * (moved @ moved):
            past = [*past[1 - HISTORY :], (moved.astype(np.float32), turned.astype(np.float32), moved @ turned)]
        x, now, g = place, there, slope
        best.append(now)
        if len(best) > 5 and best[-1] - best[-6] < ENOUGH:
            break
    return x[k:], cuts_of(x)


def _fit(doc, feature, value, grade, steps=STEPS, decay=DECAY) -> tuple[np.ndarray, np.ndarray]:
    part = _entries(doc, feature, value, grade)
    return _climb(lambda w, cuts: sums(w, cuts, part), len(grade), steps, decay)


def _tail(w, cuts, part: Part) -> np.ndarray:
    return 1 - _sigmoid(cuts[-1] - _scores(w, part))


def labelled(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """grade, fold and text of the labelled documents; most: of a sample of them, by the hash of doc_id."""
    grade = F.when(F.min("quality") < 1, 0).when(F.max(F.coalesce("toxic", F.lit(0))) > 0, 1).otherwise(2)
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(grade.cast("int").alias("grade"))
    hashed = F.xxhash64("doc_id", F.lit(4))
    if most is not None:
        graded = graded.orderBy(hashed, "doc_id").limit(most)
    graded = graded.select("doc_id", "grade", F.pmod(hashed, F.lit(FOLDS)).cast("int").alias("fold"))
    return docs.select("doc_id", "text").join(small(graded, MAX_IDS), "doc_id").select("grade", "fold", "text")


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, their bytes by place and without sign, so that the high ones are mostly 0 and compress."""
    x = x.astype(np.int64)
    return zlib.compress((x << 1 ^ x >> 63).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    x = np.frombuffer(zlib.decompress(packed.as_buffer()), np.uint8).reshape(8, -1).T.copy().view(np.uint64)[:, 0]
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def _pass(of_part, parts: DataFrame) -> DataFrame:
    """of_part over the rows of _parts; one row of its sum a task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in frames:
            for part in _read(batch):
                got = of_part(part)
                if out is None:
                    out = got
                else:
                    out += got
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(out)], pa.binary())], names=["sums"])

    return parts.mapInArrow(run, "sums binary")


def _numbers(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, fitted ones and clean held-out ones of each row."""
    for batch in frames:
        for a, b in zip(batch.column("folds"), batch.column("grades"), strict=True):
            fold, grade = (np.frombuffer(x.as_buffer(), np.int8) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (len(fold), (fold != 0).sum(), ((fold == 0) & (grade == GRADES - 1)).sum())], names=["everywhere", "fitted", "clean"])


def train(docs: DataFrame, labels: DataFrame, most: int | None = None) -> Model:
    """The model of all labelled documents among docs, or of most of them where that is given."""
    spark = docs.sparkSession
    parts = stash(labelled(docs, labels, most).mapInArrow(_parts, PART), "labelled")
    sizes = parts.agg(3 * F.sum(F.length("counts"))).first()[0]  # six bytes an entry
    if sizes is None:
        return Model(np.zeros(1 << BITS, np.float32), np.array([-1.0, 0.0]), 0.0)
    here = list(_read(parts.toArrow())) if sizes <= DRIVER_BYTES else None
    parts = parts.coalesce(min(TASKS, spark.sparkContext.defaultParallelism))
    # the cut-off comes from a fold that the weights have not seen
    everywhere, fitted, clean = parts.select("folds", "grades").mapInArrow(_numbers, "everywhere long, fitted long, clean long").agg(*[F.sum(c) for c in ("everywhere", "fitted", "clean")]).first()
    seen = fitted if fitted and clean else everywhere
    learned = parts.where(F.substring("folds", 1, 1) != F.lit(b"\0")) if seen < everywhere else parts

    def total(w, cuts):
        if here is not None:
            return sum(sums(w, cuts, part) for part in here if part.fold[0] or seen == everywhere)
        sent = spark.sparkContext.broadcast(w.astype(np.float32))
        try:
            out = np.zeros(GRADES + len(w))
            for packed in _pass(lambda part: sums(sent.value, cuts, part), learned).toArrow()["sums"]:  # at most TASKS gradients, never rows of Java objects
                out += _unpacked(packed)
            return out
        finally:
            sent.destroy()

    w, cuts = _climb(total, int(seen), STEPS, DECAY)
    least = 0.5
    if clean:
        # the tail probability that all but 1 - KEEP_CLEAN of the clean documents reach
        sent = spark.sparkContext.broadcast((w, cuts))

        def tails(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in frames:
                for part in _read(batch):
                    tail = _tail(*sent.value, part)
                    yield pa.RecordBatch.from_arrays([pa.array(tail[(part.fold == 0) & (part.grade == GRADES - 1)])], names=["tail"])

        held = parts.where(F.substring("folds", 1, 1) == F.lit(b"\0"))
        least = held.mapInArrow(tails, "tail double").agg(F.percentile("tail", F.lit(1 - KEEP_CLEAN))).first()[0]
        sent.destroy()
    return Model(w.astype(np.float32), cuts, least)


def _grades(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and tail probability."""
    doc, feature, value = features(texts)
    s = np.bincount(doc, weights=model.weights[feature] * value, minlength=len(texts))
    above = 1 - _sigmoid(model.cuts[None, :] - s[:, None])
    return above.sum(axis=1), above[:, -1]


def _judge(model):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in tv.batches(frames):
            expected, tail = _grades(model.value, texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(expected), pa.array(tail), pa.array(tail >= model.value.least)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return run


def _clean(model):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])
            for ids, texts in tv.batches([rows]):
                _, tail = _grades(model.value, texts)
                yield batch.slice(ids[0], len(ids)).filter(pa.array(tail >= model.value.least))

    return run


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_judge(sent), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def select_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model keeps, all their columns as they are."""
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, train(docs, table(spark, sf_dir, "labels")))
