"""Offline rules: joins and windows over entries, citations, issues and suppressions.

Tables (see biblion.schemas): entries(key, file, line, ...), cites(key, file, line, ord). Every function returns
findings-shaped rows or a plain relation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblion.functions.idents import fingerprint

# Required fields of each entry type, alternatives after a bar.
REQUIRED_FIELDS = {
    "article": "author title journal|journaltitle year|date",
    "inproceedings": "author title booktitle year|date",
    "conference": "author title booktitle year|date",
    "book": "author|editor title publisher year|date",
    "incollection": "author title booktitle publisher year|date",
    "inbook": "author|editor title chapter|pages publisher year|date",
    "phdthesis": "author title school|institution year|date",
    "mastersthesis": "author title school|institution year|date",
    "thesis": "author title type institution|school year|date",
    "techreport": "author title institution year|date",
    "report": "author title type institution year|date",
    "online": "title url year|date|urldate",
}


def undefined_citations(cites: DataFrame, entries: DataFrame) -> DataFrame:
    """CIT001. key, uses, and the first site (file, line) of every cited key without an entry."""
    gone = cites.join(entries.select("key"), "key", "left_anti")
    order = F.struct(*[c for c in ("file", "line") if c in cites.columns] or ["key"])
    return gone.groupBy("key").agg(F.count("*").alias("uses"), F.min(order).alias("first"))


def unused_entries(entries: DataFrame, cites: DataFrame, cites_all: bool = False) -> DataFrame:
    """CIT003. Entries that nothing cites; none when everything is cited at once."""
    return entries.limit(0) if cites_all else entries.join(cites.select("key"), "key", "left_anti")


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (first definitions, versions, hits)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def repeats_of(rows: DataFrame, key: list[str], order: list[Column], first: str) -> DataFrame:
    """Later rows of a key with column `first` of its first row, as first_<name> (CIT002, CIT008)."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = rows.withColumns({"__n": F.row_number().over(w), f"first_{first}": F.first(first).over(w)})
    return out.where("__n > 1").drop("__n")


def near_duplicates(entries: DataFrame) -> DataFrame:
    """CIT004. entries(key, ord, signatures: array in order of weight) -> key, signature, first_key.

    The first signature of an entry that an earlier entry of another key has reports it, once.
    """
    sig = entries.select("key", "ord", F.posexplode("signatures").alias("pos", "signature"))
    # the first entry of each signature that several have: one row a signature, summed up before the shuffle
    place = F.struct("ord", "pos")
    firsts = sig.groupBy("signature").agg(F.min(F.struct(place.alias("place"), "key")).alias("f"), F.count("*").alias("n")).where("n > 1")
    seen = sig.join(firsts, "signature").where((place > F.col("f.place")) & (F.col("f.key") != F.col("key")))
    # an entry's signatures are few
    best = seen.groupBy("key", "ord").agg(F.min(F.struct("pos", "signature", F.col("f.key").alias("first_key"))).alias("b"))
    return best.select("key", "ord", "b.signature", "b.first_key")


def missing_fields(entries: DataFrame) -> DataFrame:
    """CIT006. entries(key, entry_type, fields: array of names) -> key, missing (array, in the order of the rule)."""
    need = F.lit(None).cast("array<string>")
    for kind, fields in REQUIRED_FIELDS.items():
        need = F.when(F.lower("entry_type") == kind, F.array(*map(F.lit, fields.split()))).otherwise(need)
    lacks = F.filter(need, lambda f: ~F.arrays_overlap(F.split(f, r"\|"), F.transform("fields", lambda x: F.lower(x))))
    return entries.select("key", lacks.alias("missing")).where(F.size("missing") > 0)


def missing_resources(resources: DataFrame, files: DataFrame) -> DataFrame:
    """CIT005. Declared bibliographies without a file of that name."""
    return resources.join(files.select("file"), "file", "left_anti")


def suppress(findings: DataFrame, suppressions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """findings(rule, key, ...) and suppressions(rule, key) -> kept findings, used suppressions, unused ones."""
    kept = findings.join(suppressions, ["rule", "key"], "left_anti")
    used = suppressions.join(findings.select("rule", "key"), ["rule", "key"], "left_semi")
    return kept, used, suppressions.join(findings.select("rule", "key"), ["rule", "key"], "left_anti")


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 3).when(c == "warning", 2).when(c == "info", 1).otherwise(0)


def sort_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, then by place, rule and key: a total order."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.col("file").asc_nulls_first(), F.col("line").asc_nulls_first(), "rule", "key")


def page(findings: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the sorted findings; the limit is the feature."""
    return sort_findings(findings).offset(offset).limit(limit)


def with_fingerprint(findings: DataFrame, detail: Column | None = None) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(F.col("rule"), F.col("key"), F.col("field"), detail if detail is not None else F.lit("")))


def apply_settings(findings: DataFrame, ignore_rules: list[str], ignore_keys: list[str], severities: dict[str, str]) -> DataFrame:
    """Ignored rules and key patterns (globs) go, severities are overridden."""
    out = findings.where(~F.col("rule").isin(*ignore_rules)) if ignore_rules else findings
    for glob in ignore_keys:
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob) + "$"
        out = out.where(~F.coalesce(F.col("key").rlike(pattern), F.lit(False)))
    level = F.col("severity")
    for rule, severity in severities.items():
        level = F.when(F.col("rule") == rule, severity).otherwise(level)
    return out.withColumn("severity", level)


def rule_table(spark: SparkSession) -> DataFrame:
    from biblion.plans.rules import RULES

    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(t).alias("summary")) for r, n, s, t in RULES])))


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n for every severity, 0 where nothing was found."""
    from biblion.operators.evaluate import with_all

    return with_all(findings.groupBy("severity").agg(F.count("*").alias("n")), ["error", "warning", "info"], "severity")
