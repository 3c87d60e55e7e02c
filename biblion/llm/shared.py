"""Helpers shared by the corpus operators: reading, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (a local session), one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="biblion-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table up to which it is broadcast, and rows of a key from which the key counts as hot.
MAX_BROADCAST_ROWS, HOT = 200_000, 1_000


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has most rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], members: str, how: str = "inner", most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """rows joined with groups, which has one row a key and in column members the number of the key's rows.

    Few groups are broadcast. Of many, the hot ones are, so that no task gets all rows of a key; the others meet by
    a shuffle. Hot groups are at most 1/HOT of the rows; if even they are too many to send, AQE splits the join.
    """
    if groups.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(groups), key, how)
    hot = groups.where(F.col(members) > HOT)
    if hot.limit(most + 1).count() > most:
        return rows.join(groups, key, how)
    marked = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key), F.lit(True).alias("__hot"))), key, "left")
    some = marked.where("__hot").drop("__hot").join(F.broadcast(hot), key)
    return some.unionByName(marked.where("__hot is null").drop("__hot").join(groups.where(F.col(members) <= HOT), key, how))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def literal_rows(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table of few string rows as a plan literal."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows])))
