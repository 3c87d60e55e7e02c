"""Corrections: one edit per entry and field, safe rules first; edits are applied file by file."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rules whose edits are safe, and those that need a decision.
SAFE = ("REF016", "REF017")
UNSAFE = ("REF001", "REF010", "REF011", "REF012", "REF013", "REF014", "REF015")
FIX = "file string, key string, rule string, field string, action string, old string, new string"


def one_fix_each(findings: DataFrame, order: list[Column]) -> DataFrame:
    """One finding of each (key, field): safe rules before the others, then by order."""
    w = Window.partitionBy("key", "field").orderBy(F.when(F.col("rule").isin(*SAFE), 0).otherwise(1), *order)
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def plan(findings: DataFrame, entries: DataFrame, level: str = "safe") -> DataFrame:
    """findings(rule, key, field, suggestion, ...) and entries(key, file, fields map) -> FIX rows.

    Findings without a suggestion, edits that change nothing and rules beyond the level give none.
    """
    rules = SAFE if level == "safe" else SAFE + UNSAFE
    wanted = findings.where(F.col("rule").isin(*rules) & F.col("suggestion").isNotNull() & F.col("field").isNotNull())
    with_old = wanted.join(entries.select("key", "file", "fields"), "key").withColumn("old", F.col("fields")[F.lower("field")])
    with_old = with_old.where(F.coalesce(F.col("old") != F.col("suggestion"), F.lit(True)))
    one = one_fix_each(with_old, [F.col("rule"), F.col("suggestion")])
    return one.select("file", "key", "rule", "field", F.when(F.col("old").isNull(), "add").otherwise("replace").alias("action"), "old", F.col("suggestion").alias("new"))


def published_fixes(published: DataFrame) -> DataFrame:
    """published(file, key, fields: array<struct<field,value>>, has: map) -> edits that turn a preprint entry into the published one."""
    one = published.select("file", "key", "has", F.explode("fields").alias("f"))
    old = F.col("has")[F.col("f.field")]
    action = F.when(F.col("f.field") == "entrytype", "retype").when(F.col("f.value").isNull(), "remove").when(old.isNull(), "add").otherwise("replace")
    return one.where(~F.coalesce(old == F.col("f.value"), F.lit(False))).select("file", "key", F.lit("REF015").alias("rule"), F.col("f.field").alias("field"), action.alias("action"), old.alias("old"), F.col("f.value").alias("new"))


def _spans(text: str, key: str) -> tuple[int, int] | None:
    """Where the entry of a key stands, by its braces."""
    m = re.search(r"@\s*\w+\s*[{(]\s*" + re.escape(key) + r"\s*,", text)
    if not m:
        return None
    depth, i = 1, m.end()
    while i < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[i], 0) if text[i - 1] != "\\" else 0
        i += 1
    return m.start(), i


def _field_span(entry: str, name: str) -> tuple[int, int, int, int] | None:
    """(start of the field, start of its value, end of its value, end with the comma)."""
    for m in re.finditer(r"(?im)(?<=[,\n])\s*" + re.escape(name) + r"\s*=\s*", entry):
        i, depth, quoted = m.end(), 0, False
        while i < len(entry):
            c = entry[i]
            if c == '"' and not depth and entry[i - 1] != "\\":
                quoted = not quoted
            depth += (c == "{") - (c == "}") if not quoted else 0
            if depth < 0 or (c == "," and not depth and not quoted):
                break
            i += 1
        return m.start(), m.end(), len(entry[:i].rstrip()), i + (entry[i : i + 1] == ",")
    return None


def apply_edits(text: str, edits: list[dict]) -> str:
    """The text with its edits, everything else byte for byte; the last span goes first."""
    newline = "\r\n" if "\r\n" in text else "\n"
    jobs = []
    for e in edits:
        span = _spans(text, e["key"])
        if not span:
            continue
        entry = text[span[0] : span[1]]
        found = _field_span(entry, e["field"])
        if e["action"] == "retype":
            m = re.match(r"@\s*(\w+)", entry)
            jobs.append((span[0] + m.start(1), span[0] + m.end(1), e["new"]))
        elif e["action"] == "remove" and found:
            jobs.append((span[0] + found[0], span[0] + found[3], ""))
        elif found and e["action"] in ("replace", "add"):
            jobs.append((span[0] + found[1], span[0] + found[2], "{" + e["new"] + "}"))
        elif e["action"] in ("add", "replace"):
            body = entry[:-1].rstrip()
            comma = "" if body.endswith(",") else ","
            at = span[0] + len(body)
            jobs.append((at, at, f"{comma}{newline}  {e['field']} = {{{e['new']}}}"))
    for a, b, new in sorted(jobs, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def apply(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """files(file, text) and FIX rows -> file, text, diff of the files that change: one group a file."""
    per_file = fixes.groupBy("file").agg(F.collect_list(F.struct("key", "field", "action", "new")).alias("edits"))

    @F.pandas_udf("struct<text:string,diff:string>")
    def run(file: pd.Series, text: pd.Series, edits: pd.Series) -> pd.DataFrame:
        rows = []
        for name, old, e in zip(file, text, edits):
            new = apply_edits(old, [dict(x) for x in e])
            rows.append((new, "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), name, name))))
        return pd.DataFrame(rows, columns=["text", "diff"])

    done = files.join(per_file, "file").withColumn("out", run("file", "text", "edits"))
    return done.where("out.text <> text").select("file", "out.text", "out.diff")
