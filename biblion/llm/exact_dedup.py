"""Operator 1: exact dedup by a tree-merge of sorted digest runs (DataFrame operations only).

Texts are equal when they are the same after deleting every ASCII white-space character. Each input partition
is one run of (digest, smallest identifier, count). Runs meet in binomial rounds: in every round FAN_IN
neighbouring runs are merged by a sort aggregate on (run, digest, normalised length), which keeps the
smallest verified identifier and adds up the counts, so a digest is one row per run at most, however often
it occurs. After ceil(log_FAN_IN(runs)) rounds one run is left, spread over all tasks by digest. The rows then
look up their survivor in an equi-join, to which hot groups are broadcast.

Verified: two rows count as equal only if SHA-256, the normalised length and an independent 64-bit hash agree.

Edge cases. Null text counts as empty; all empty or white-space texts are one group. Ties on length go to the
smallest doc_id, then to the smallest hash of the text, then to the first row; a null doc_id sorts last and its row is
never kept while another row of the group exists. Repeated doc_ids stay separate rows, of which one is kept at most. An empty table gives an empty result. Further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm.identity import drop_rows, text_key
from biblion.llm.shared import join_groups, stash, table, text_or_empty

FAN_IN = 8
KEY = ("digest", "norm_len", "check")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]", "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document; text goes no further."""
    norm = normalised(text_or_empty(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.length(text_or_empty(text_col)).alias("chars"),
        norm.alias("norm"),
        F.spark_partition_id().alias("run"),
        F.xxhash64(text_or_empty(text_col)).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    ).select(
        "id", "chars", "run", "text_key", "row",
        F.unhex(F.sha2("norm", 256)).alias("digest"), F.length("norm").alias("norm_len"), F.xxhash64("norm").alias("check"),
    )


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """digest rows -> one row per distinct text: KEY, keep_id, keep_key, keep_row, group_size."""
    # (longest text, present id, smallest id) is the order of the identifiers: the least struct stays.
    best = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id"), F.col("text_key"), F.col("row"))
    runs = rows.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))
    last = rows.agg(F.max("run")).first()[0] or 0
    merge = lambda df: df.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    while last > 0:
        runs = merge(runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
        last //= fan_in
    return merge(runs.withColumn("run", F.lit(0))).select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.text_key").alias("keep_key"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stash(digest_rows(docs, id_col, text_col), "digests")
    alone = merge_runs(rows, fan_in)
    # Only groups of two or more need the join's right side; all others keep themselves.
    many = alone.where("group_size > 1")
    joined = join_groups(rows, many, [*KEY], "group_size", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The documents with one row of each group of equal texts, all columns as they are."""
    rows = stash(digest_rows(docs), "digests")
    many = merge_runs(rows, fan_in).where("group_size > 1")
    own = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    grouped = join_groups(rows, many, [*KEY], "group_size").select(F.col("id").alias("doc_id"), "text_key", own.alias("own"))
    out = drop_rows(docs, grouped.where("not own"))
    # the row that stays may itself be there several times
    again = grouped.where("own").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = stash(again, "again")
    if not again.limit(1).count():
        return out
    keyed = docs.withColumn("__key", text_key())
    twice = keyed.join(again, (F.col("__key") == again["text_key"]) & keyed["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    return drop_rows(out, again).unionByName(twice.dropDuplicates(["doc_id", "__key"]).drop("__key"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over w as place
  from d window w as (partition by text_sha256 order by chars desc, doc_id))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from g
"""
