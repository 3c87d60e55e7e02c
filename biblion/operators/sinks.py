"""Reports: JSON, SARIF, text and BibTeX from findings, assessments and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblion.functions.text import deaccent, escape_bibtex, protect_capitals
from biblion.operators.hygiene import page, severity_rank


def json_report(findings: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """One page of findings as JSON lines, with the offset of the next page (null on the last)."""
    total = findings.count()
    after = offset + limit
    rows = page(findings, offset, limit)
    return rows.select(F.to_json(F.struct(*findings.columns, F.lit(after if after < total else None).cast("int").alias("next_offset"))).alias("value"))


def sarif(findings: DataFrame, rules: DataFrame, by: str = "project") -> DataFrame:
    """SARIF 2.1.0, one document per project. A project's findings are gathered for its document."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    known = rules.agg(F.array_sort(F.collect_list(F.struct(F.col("rule").alias("id"), "name"))).alias("rules"))  # 33 rows
    runs = findings.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-severity_rank(F.col("severity"))).alias("o"), "file", "line", result.alias("r")))).alias("found"))
    driver = F.struct(F.struct(F.lit("biblion").alias("name"), F.col("rules")).alias("driver"))
    document = F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(F.struct(driver.alias("tool"), F.transform("found", lambda x: x["r"]).alias("results"))).alias("runs"))
    return runs.join(F.broadcast(known), F.lit(True)).select(by, F.to_json(document).alias("sarif"))


def text_report(findings: DataFrame, grouped: tuple[str, ...] = ("REF015", "REF016"), least: int = 3, shown: int = 6) -> DataFrame:
    """A line a finding; rules in grouped become one line from least findings on, with the first keys."""
    many = findings.where(F.col("rule").isin(*grouped)).groupBy("rule").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("key")).alias("keys")).where(F.col("n") >= least)
    one = findings.join(many.select("rule"), "rule", "left_anti").select("rule", F.concat_ws(" ", F.upper("severity"), "rule", F.concat(F.coalesce("file", F.lit("-")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("-"))), "key", "message").alias("line"))
    rest = F.when(F.size("keys") > shown, F.concat(F.lit(" and "), (F.size("keys") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return one.unionByName(many.select("rule", F.concat(F.col("rule"), F.lit(" x"), F.col("n").cast("string"), F.lit(": "), F.array_join(F.slice("keys", 1, shown), ", "), rest).alias("line")))


def citation_key(family: Column, year: Column, title: Column) -> Column:
    """familyyearword: the first author, the year, and the first long word of the title."""
    slug = lambda c: F.regexp_replace(F.lower(deaccent(c)), "[^a-z0-9]", "")
    word = F.coalesce(F.get(F.filter(F.split(F.lower(deaccent(title)), r"[^a-z0-9]+"), lambda w: (F.length(w) > 3)), F.lit(0)), F.lit(""))
    return F.concat(slug(F.coalesce(family, F.lit("anon"))), F.coalesce(year.cast("string"), F.lit("")), word)


def bibtex_entry(records: DataFrame) -> DataFrame:
    """records -> source, source_id, key, bibtex."""
    types = {"journal-article": "article", "proceedings-article": "inproceedings", "book": "book", "monograph": "book", "book-chapter": "incollection", "dissertation": "phdthesis", "report": "techreport", "dataset": "dataset", "software": "software"}
    kind = F.lit("misc")
    for a, b in types.items():
        kind = F.when(F.lower("work_type") == a, b).otherwise(kind)
    names = F.array_join(F.transform("authors", lambda p: F.when(p["literal"].isNotNull(), F.concat(F.lit("{"), p["literal"], F.lit("}"))).otherwise(F.concat_ws(", ", p["family"], F.nullif(p["given"], F.lit(""))))), " and ")
    names = F.when(F.col("authors_complete"), names).otherwise(F.concat(names, F.lit(" and others")))
    line = lambda n, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"  {n} = {{"), v, F.lit("}")))
    fields = F.array_compact(F.array(
        line("author", names), line("title", protect_capitals(escape_bibtex(F.col("title")))), line("year", F.col("year").cast("string")), F.when(kind == "inproceedings", line("booktitle", escape_bibtex(F.col("venue")))).when(kind == "article", line("journal", escape_bibtex(F.col("venue")))),
        line("volume", F.col("volume")), line("number", F.col("issue")), line("pages", F.regexp_replace("pages", r"(?<=\w)\s*[-–—]+\s*(?=\w)", "--")), line("publisher", escape_bibtex(F.col("publisher"))), line("doi", F.col("identifiers")["doi"]),
    ))
    key = citation_key(F.get("authors", F.lit(0))["family"], F.col("year"), F.col("title"))
    return records.select("source", "source_id", key.alias("key"), F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}\n")).alias("bibtex"))


def verdict_line(assessments: DataFrame, unasked: int = 0) -> DataFrame:
    """One row, line: how many references have each verdict, in the order of the verdicts, those that occur."""
    from biblion.plans.rules import VERDICTS

    place = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    counted = assessments.groupBy("verdict").agg(F.count("*").alias("n"))
    said = F.struct(place.alias("place"), F.concat(F.col("n").cast("string"), F.lit(" "), F.replace("verdict", F.lit("_"), F.lit(" "))).alias("said"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), " · ")
    tail = f" ({unasked} without a cached answer, not verified)" if unasked else ""
    return counted.agg(F.when(F.count("*") == 0, "References: none to verify").otherwise(F.concat(F.lit("References: "), all_, F.lit(tail))).alias("line"))
