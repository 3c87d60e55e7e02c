"""Answers as a stream: the latest of each key, and late or expired ones left out by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.operators.cache import TTL_DAYS, ttl_days


def latest_answers(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """answers(source, key, kind, stored_at, payload) as a stream -> one row a key and update: the latest answer."""
    newest = F.max_by(F.struct("kind", "payload", "stored_at"), "stored_at").alias("a")
    return answers.withWatermark("stored_at", late).groupBy("source", "key").agg(newest).select("source", "key", "a.*")


def unexpired(answers: DataFrame, days: dict[str, int] = TTL_DAYS) -> DataFrame:
    """A stream without answers whose lifetime is over when they are processed."""
    return answers.where(F.expr("stored_at") + F.make_dt_interval(ttl_days(F.col("kind"), days)) > F.current_timestamp())


def answers_per_day(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by source, kind and day; a day is final when the watermark has passed it."""
    return answers.withWatermark("stored_at", late).groupBy(F.window("stored_at", "1 day"), "source", "kind").agg(F.count("*").alias("n"))
