"""Answers with a lifetime by kind, as tables: freshness, purge, statistics, upsert, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days that an answer of a kind is used.
TTL_DAYS = {"positive": 60, "negative": 2, "search": 14, "status": 7, "meta": 365}


def ttl_days(kind: Column, days: dict[str, int] = TTL_DAYS) -> Column:
    out = F.lit(0)
    for k, d in days.items():
        out = F.when(kind == k, d).otherwise(out)
    return out


def fresh(answers: DataFrame, now: Column, offline: bool = False, days: dict[str, int] = TTL_DAYS, after: Column | None = None) -> DataFrame:
    """answers(kind, stored_at, ...) still in their lifetime; offline all of them; `after` asks for a newer answer."""
    out = answers if offline else answers.where(F.expr("stored_at") + F.make_dt_interval(ttl_days(F.col("kind"), days)) > now)
    return out if after is None else out.where(F.col("stored_at") >= after)


def purge(answers: DataFrame, now: Column, sources: list[str] | None = None, kinds: list[str] | None = None, days: dict[str, int] = TTL_DAYS) -> DataFrame:
    """What stays after expired answers, and answers of the named sources or kinds, are removed."""
    out = fresh(answers, now, days=days)
    if sources:
        out = out.where(~F.col("source").isin(*sources))
    return out.where(~F.col("kind").isin(*kinds)) if kinds else out


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest answer of each (source, key); of equally late ones the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("source", "key").orderBy(F.col("stored_at").desc(), F.col("__new").desc(), "payload")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def stats(answers: DataFrame) -> DataFrame:
    return answers.groupBy("source", "kind").agg(F.count("*").alias("n"))


def export(answers: DataFrame) -> DataFrame:
    """What may be passed on, in a stable order."""
    return answers.where("exportable").orderBy("source", "key")
