"""Scores of decisions against labels, and comparisons of runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tallies(outcomes: DataFrame, by: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """outcomes(truth boolean, outcome in flag/clean/abstain, by...) -> total, flag, clean, abstain and the four cells.

    With sets, one pass counts for each of those subsets of by; what a subset leaves out is null.
    """
    cell = lambda truth, what: F.count_if((F.col("truth") == truth) & (F.col("outcome") == what))
    grouped = outcomes.groupBy(*by) if sets is None else outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    return grouped.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("flag", "clean", "abstain")],
        cell(True, "flag").alias("tp"), cell(False, "flag").alias("fp"), (F.count_if("truth") - cell(True, "flag")).alias("fn"), (F.count_if(~F.col("truth")) - cell(False, "flag")).alias("tn"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def metrics(t: DataFrame) -> DataFrame:
    """precision, recall (an abstention is a miss), f1, fpr and coverage of tallies."""
    c = F.col
    p, r = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return t.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "fpr": ratio(c("fp"), c("fp") + c("tn")), "coverage": ratio(c("flag") + c("clean"), c("total"))})


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, (mid - half) / scale), F.when(n > 0, (mid + half) / scale)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected and Cohen's kappa of two label columns."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.count("*").alias("x"))
    right = pairs.groupBy(F.col(b).alias("label")).agg(F.count("*").alias("y"))
    both = left.join(right, "label").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    out = n.crossJoin(F.broadcast(both)).withColumn("expected", F.col("xy") / (F.col("n") * F.col("n")))  # one row each
    return out.select("n", "observed", "expected", ratio(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def replay_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost and gained between two runs, with repetitions counted."""
    return before.exceptAll(after).withColumn("change", F.lit("lost")).unionByName(after.exceptAll(before).withColumn("change", F.lit("gained")))


def stratified(rows: DataFrame, size: int, stratum: str, key: str, seed: int) -> DataFrame:
    """A sample of size rows, as even over the strata as they allow; the same for the same seed."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    turn = rows.withColumn("__turn", F.row_number().over(w))
    return turn.orderBy("__turn", F.xxhash64(F.lit(seed + 1), stratum), stratum).limit(size).drop("__turn")


def repeated_lines(lines: DataFrame, least: int = 3, longest: int = 90) -> DataFrame:
    """lines(doc, line) -> line keys (trailing digits cut) that occur least times or more, with their number."""
    key = F.trim(F.regexp_replace(F.trim("line"), r"\s*\d+$", ""))
    return lines.select(key.alias("line_key")).where((F.length("line_key") > 0) & (F.length("line_key") < longest)).groupBy("line_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def with_all(counts: DataFrame, names: list[str], column: str) -> DataFrame:
    """Counts with a row for every name, 0 where nothing was counted."""
    spark = counts.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias(column))
    return every.join(counts, column, "left").fillna(0)


def z_of(confidence: float) -> float:
    """Two-sided normal quantile, by bisection on the error function."""
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < confidence else (low, mid)
    return (low + high) / 2
