"""Rows by identity (doc_id, hash of the whole text): what a decision table needs to take effect on documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblion.llm import textvec as tv

#: Decisions up to this many rows (16 bytes each) are broadcast, more are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")


def keyed(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Portions of ids, texts and text keys of batches (doc_id, text, text_key)."""
    for batch in frames:
        names, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
        rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])
        for at, texts in tv.batches([rows]):
            yield names[at[0] : at[-1] + 1], texts, keys[at[0] : at[-1] + 1]


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, text_key) is in dropped; all columns as they are."""
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    if dropped.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    same = F.col("__own") == F.col("__key")
    return docs.withColumn("__own", text_key()).join(dropped, same & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti").drop("__own")
