"""The main run: a folder of sources and bibliographies, and registry tables, to findings and verdicts."""

from __future__ import annotations

import sys
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.functions import idents, names
from biblion.functions.text import title_key, word_count
from biblion.operators import hygiene, late, resolve, scoring, verdict
from biblion.plans.rules import RULES
from biblion.sources import scan
from biblion.tables import stash

# Where an entry names its venue, in order of preference; the first three name it.
VENUE_FIELDS = ("booktitle", "journal", "journaltitle", "howpublished", "publisher")
BIBLIOGRAPHIES, DOCUMENTS = "*.{bib,bbl,ris,json,yaml,yml,docx}", "*.{tex,md,qmd,Rmd,typ}"
FINDING = ("rule", "severity", "key", "field", "file", "line", "message")
EXIT = {"clean": 0, "blocking": 1, "incomplete": 2, "usage": 3, "internal": 4}


class Evidence(NamedTuple):
    """What else could be asked, each a table or left out (then the rules that need it say nothing)."""

    agencies: DataFrame | None = None  # doi, agency, exists (null: no answer)
    catalogues: tuple[DataFrame, ...] = ()  # name of a venue
    software: DataFrame | None = None  # kind, name, exists
    pages: DataFrame | None = None  # url, code
    archived: DataFrame | None = None  # url
    substitutes: DataFrame | None = None  # key, source, substitute
    chinese_journals: tuple[str, ...] = ()


class Report(NamedTuple):
    entries: DataFrame
    cites: DataFrame
    findings: DataFrame
    assessments: DataFrame | None


def _authors(values: pd.Series) -> pd.DataFrame:
    rows = [names.parse_authors(v) for v in values]
    return pd.DataFrame({"people": [[p._asdict() for p in people] for people, _ in rows], "truncated": [more for _, more in rows]})


def people_of(names_: Column) -> Column:
    """BibTeX names -> struct(people, truncated)."""
    return F.pandas_udf(_authors, f"struct<people:array<{names.PERSON}>,truncated:boolean>")(names_)


def entry_info(entries: DataFrame) -> DataFrame:
    """entries of the readers -> what the scorer compares. The first definition of a key counts."""
    first = hygiene.first_of(entries, ["key"], [F.col("file"), F.col("line")])
    text = lambda n: F.nullif(F.col("fields")[n]["text"], F.lit(""))
    value = lambda n: F.nullif(F.col("fields")[n]["value"], F.lit(""))
    year = F.coalesce(*[F.nullif(F.regexp_extract(text(n), r"(?<!\d)((?:1[5-9]|20)\d\d)(?!\d)", 1), F.lit("")) for n in ("year", "date", "note")]).cast("int")
    venue = F.coalesce(*[text(n) for n in VENUE_FIELDS])
    hosts = F.transform(idents.links(F.concat_ws(" ", *[value(n) for n in ("url", "howpublished", "note")])), idents.host)
    known = lambda h: h.rlike(r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in resolve.INDEXED_HOSTS) + ")$")
    e = first.withColumn("who", people_of(F.coalesce(value("author"), value("editor"), F.lit(""))))
    return e.select(
        "key", "file", "line", F.coalesce(text("title"), text("chapter")).alias("title"), F.col("who.people").alias("authors"), F.col("who.truncated").alias("truncated"), year.alias("year"), venue.alias("venue"),
        F.coalesce(*[text(n) for n in VENUE_FIELDS[:3]]).isNotNull().alias("venue_named"), (text("journal").isNotNull() | text("journaltitle").isNotNull()).alias("journal"), text("volume").alias("volume"), idents.first_page(text("pages")).alias("first_page"),
        F.array_compact(F.array(idents.issn(text("issn")))).alias("issns"), idents.normalize_doi(value("doi")).alias("doi"), "entry_type", F.exists(hosts, lambda h: (h != "") & ~known(h)).alias("link_unindexed"),
        F.concat_ws(" ", text("note"), text("titleaddon"), text("howpublished")).alias("remarks"), F.coalesce(value("langid"), value("language")).alias("language"),
        F.array_distinct(idents.links(F.concat_ws(" ", *[value(n) for n in ("url", "howpublished", "note")]))).alias("urls"),
    )


def _finding(df: DataFrame, rule: str, message: Column, *, key="key", field: Column | None = None, file="file", line="line") -> DataFrame:
    severity = next(s for r, _, s, _ in RULES if r == rule)
    cell = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), cell(key, "string").alias("key"), (F.lit(None).cast("string") if field is None else field).alias("field"), cell(file, "string").alias("file"), cell(line, "int").alias("line"), message.alias("message"))


def offline_findings(entries: DataFrame, issues: DataFrame, cites: DataFrame, links: DataFrame | None = None, books: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """CIT, TEX and REF017 findings. books and texts are the files, for what is declared but missing or unreadable."""
    kind = lambda k: issues.where(F.col("kind") == k)
    firsts = hygiene.first_of(entries, ["key"], [F.col("file"), F.col("line")])
    ids = resolve.identifiers(firsts.select("key", F.transform_values("fields", lambda _, v: v["value"]).alias("fields")))
    tk = title_key(F.col("fields")["title"]["text"])
    year = F.regexp_extract(F.coalesce(F.col("fields")["year"]["text"], F.col("fields")["date"]["text"], F.lit("")), r"(\d{4})", 1)
    signed = firsts.join(ids.where("scheme in ('doi', 'arxiv')").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("scheme") == "doi", 0).otherwise(1).alias("o"), "ord", F.concat_ws(":", "scheme", "value").alias("s")))), lambda x: x["s"]).alias("s")), "key", "left")
    titled = F.when(word_count(F.col("fields")["title"]["text"]) >= 4, F.array(F.concat_ws("|", tk, year))).otherwise(F.array().cast("array<string>"))
    signed = signed.select("key", F.struct("file", "line").alias("ord"), F.concat(F.coalesce("s", F.array().cast("array<string>")), titled).alias("signatures"))
    near = hygiene.near_duplicates(signed).select("key", "ord.file", "ord.line", "first_key", "signature")
    undefined = hygiene.undefined_citations(cites.where("key <> '*'"), entries).select("key", "uses", "first.file", "first.line")
    everything = cites.where("key = '*' and nocite").select(F.lit(1).alias("all")).distinct()
    unused = hygiene.unused_entries(firsts, cites).join(F.broadcast(everything), F.lit(True), "left_anti")
    lacking = hygiene.missing_fields(firsts.select("key", "entry_type", F.map_keys("fields").alias("fields"))).join(firsts.select("key", "file", "line"), "key")
    later = hygiene.repeats_of(entries, ["key"], [F.col("file"), F.col("line")], "line")
    lint = firsts.select("key", "file", "line", F.explode(F.map_entries(F.map_filter("fields", lambda k, _: k.isin("doi", "isbn", "issn")))).alias("f")).select("key", "file", F.col("f.value.line").alias("line"), F.col("f.key").alias("scheme"), idents.lint_identifier(F.col("f.key"), F.col("f.value.value")).alias("why")).where("why is not null")
    parts = [
        _finding(undefined, "CIT001", F.concat(F.lit("no entry has this key; uses: "), F.col("uses").cast("string"))), _finding(kind("duplicate_key"), "CIT002", F.concat(F.lit("first defined at line "), "detail")),
        _finding(later, "CIT002", F.concat(F.lit("first defined at line "), F.col("first_line").cast("string"))), _finding(unused, "CIT003", F.lit("never cited")), _finding(near, "CIT004", F.concat(F.lit("the same work as "), "first_key")),
        _finding(kind("unreadable"), "CIT005", F.col("detail")), _finding(lacking, "CIT006", F.array_join("missing", ", ")), _finding(kind("syntax"), "CIT007", F.col("detail")), _finding(kind("duplicate_field"), "CIT008", F.col("detail"), field=F.col("detail")),
        _finding(lint, "REF017", F.col("why"), field=F.col("scheme")),
    ]
    if links is not None:
        edges = links.where("kind = 'include'").select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), F.regexp_extract("target", r"([^/]+)$", 1).alias("target"))
        parts.append(_finding(scan.cycles(edges), "TEX002", F.lit("files include each other")))
        parts.append(_finding(links.where("kind = 'bib' and target rlike '^https?://'"), "TEX003", F.col("target")))
        if books is not None and texts is not None:
            parts.append(_finding(scan.missing_targets(books, links, "bib"), "CIT005", F.concat(F.lit("no such file: "), "target")))
            parts.append(_finding(scan.missing_targets(texts, links, "include"), "TEX001", F.concat(F.lit("no such file: "), "target")))
            parts.append(_finding(scan.unreadable(texts), "TEX004", F.lit("not a text file")))
    return _union(parts)


def suppressed(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings without those that their entry's comments ignore, and CFG001 for comments that ignored nothing."""
    said = entries.select("key", "file", F.explode("suppressions").alias("s")).select("key", "file", F.col("s.line").alias("line"), F.explode("s.rules").alias("rule"))
    kept, _, unused = hygiene.suppress(findings, said.select("rule", "key").distinct())
    idle = said.join(unused, ["rule", "key"], "left_semi")
    return kept.unionByName(_finding(idle, "CFG001", F.concat(F.lit("ignores "), "rule", F.lit(", which reported nothing"))))


def _published(bound: DataFrame, records: DataFrame) -> DataFrame:
    """REF015: a cited preprint with a published record of the same title and first author."""
    first = F.lower(F.coalesce(F.get("authors", F.lit(0))["family"], F.get("authors", F.lit(0))["literal"]))
    preprint = F.coalesce((F.col("source") == "arxiv") | F.col("work_type").isin(*scoring.PREPRINT_TYPES), F.lit(False))
    keyed = lambda df: df.withColumns({"title_key": title_key(F.col("title")), "author": first}).where("title_key <> '' and author is not null")
    return verdict.published_versions(keyed(bound.where(preprint)).select("key", "title_key", "author"), keyed(records.where(~preprint)).select("title_key", "author", "source_id", "year", "venue"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entry_flags(info: DataFrame, ids: DataFrame, evidence: Evidence) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(info with live_identifier, venue_known and translated; dead identifiers (key, value); catalogue of each venue)."""
    out, dead, shelves = info, None, None
    if evidence.agencies is not None:
        told = stash(ids.where("scheme = 'doi'").select("key", F.col("value").alias("doi")).join(evidence.agencies.select("doi", "exists"), "doi"), "told")
        dead = told.where("not exists").select("key", F.col("doi").alias("value"))
        out = out.join(told.groupBy("key").agg(F.bool_or("exists").alias("live_identifier")), "key", "left")
    if evidence.catalogues:
        shelves = stash(late.venue_known(info.select("key", "venue"), *evidence.catalogues), "shelves")
        out = out.join(shelves.select("key", F.col("catalogue").isNotNull().alias("venue_known")), "key", "left")
    for flag in ("live_identifier", "venue_known"):
        out = out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) if flag in out.columns else F.lit(False))
    journals = evidence.chinese_journals or (r"\b\B",)  # a pattern that nothing fits
    return out.withColumn("translated", verdict.translated(F.col("title"), F.col("venue"), F.col("remarks"), journals, F.col("language"))), dead, shelves


def late_findings(info: DataFrame, bound: DataFrame, evidence: Evidence, shelves: DataFrame | None) -> list[DataFrame]:
    """REF019, REF020 and REF021."""
    row = lambda df, rule, severity, field, note: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "key", F.lit(field).cast("string").alias("field"), note.alias("note"))
    out = []
    if evidence.software is not None:
        own = info.select("key", "title", idents.software_links(F.array_join("urls", " ")).alias("links"))
        out.append(row(late.software(own, evidence.software).where("status = 'missing'"), "REF019", "info", "url", F.col("name")))
    if shelves is not None:
        preprint = F.coalesce((F.col("source") == "arxiv") | F.col("work_type").isin(*scoring.PREPRINT_TYPES), F.lit(False))
        known_else = bound.groupBy("key").agg(F.bool_and(preprint).alias("only_preprint")).where("only_preprint")
        unknown = shelves.where("catalogue is null").join(known_else, "key", "left_semi")
        named = info.where(F.col("venue_named") & ~F.coalesce(F.lower("venue").rlike("arxiv|preprint|corr"), F.lit(False))).select("key", "venue")
        out.append(row(unknown.join(named, "key"), "REF020", "warning", "venue", F.col("venue")))
    if evidence.pages is not None:
        pages = info.select("key", F.explode("urls").alias("url"))
        archived = evidence.archived if evidence.archived is not None else evidence.pages.select("url").limit(0)
        out.append(row(late.gone_pages(pages, evidence.pages, archived), "REF021", "info", "url", F.col("url")))
    return out


def check(spark: SparkSession, path: str, records: DataFrame | None = None, sources: DataFrame | None = None, current_year: int = 2024, evidence: Evidence = Evidence()) -> Report:
    """path: a folder; records: registry records (biblion.sources.registries), without which only the offline rules run;
    sources(source, available, reason): which registries could be asked."""
    books, texts = scan.files(spark, path, BIBLIOGRAPHIES), scan.files(spark, path, DOCUMENTS)
    entries = stash(scan.entries(books), "entries")
    issues, cites, links = stash(scan.issues(books), "issues"), stash(scan.cites(texts), "cites"), stash(scan.links(texts), "links")
    findings = offline_findings(entries, issues, cites, links, books, texts)
    if records is None:
        return Report(entries, cites, suppressed(findings, entries), None)
    ids = resolve.identifiers(entries.select("key", F.transform_values("fields", lambda _, v: v["value"]).alias("fields")))
    info, dead, shelves = entry_flags(stash(entry_info(entries), "info"), ids, evidence)
    info = stash(info, "flagged")
    anchored = stash(resolve.anchor(ids, records), "anchored")
    found = resolve.search(info, records, anchored)
    pairs = stash(anchored.unionByName(found, allowMissingColumns=True), "pairs")
    if sources is None:
        sources = records.select("source").distinct().select("source", F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"))
    own = records.withColumn("doi", F.col("identifiers")["doi"]).drop("identifiers", "status", "issue", "pages", "publisher", "url", "year")
    scored = scoring.score_pairs(pairs, info, own, current_year).withColumn("versions_known", F.col("source") != "arxiv")
    answered = stash(resolve.answers(info, pairs, sources), "answers")
    assessments, about = verdict.decide(info, scored, answered, current_year, dead)
    bound = stash(assessments.where("source is not null").select("key", "source", "source_id").join(records, ["source", "source_id"]), "bound")
    told = records.where(F.size("status") > 0).select("source", F.col("identifiers")["doi"].alias("doi"), "status").where("doi is not null")
    about = about.unionByName(verdict.status_findings(bound.select("key", F.col("identifiers")["doi"].alias("doi")), told))
    about = _union([about, _published(bound, records), *late_findings(info, bound, evidence, shelves)])
    run = resolve.run_findings(answered, evidence.substitutes)
    nothing = lambda kind: F.lit(None).cast(kind)
    run = run.select("rule", "severity", nothing("string").alias("key"), nothing("string").alias("field"), nothing("string").alias("file"), nothing("int").alias("line"), F.concat_ws("; ", "source", F.concat(F.col("affected").cast("string"), F.lit(" entries")), "reasons").alias("message"))
    placed = about.join(info.select("key", "file", "line"), "key").select("rule", "severity", "key", "field", "file", "line", F.col("note").alias("message"))
    return Report(entries, cites, suppressed(_union([findings, placed, run]), entries), assessments)


def main(argv: list[str]) -> int:
    """check <folder> [registry parquet]: prints a line a finding; 0 clean, 1 blocking, 3 usage."""
    if len(argv) not in (2, 3):
        print("usage: check <folder> [records.parquet]", file=sys.stderr)
        return EXIT["usage"]
    from biblion.operators.sinks import text_report

    spark = SparkSession.builder.getOrCreate()
    report = check(spark, argv[1], spark.read.parquet(argv[2]) if len(argv) == 3 else None)
    findings = stash(report.findings, "findings")
    for row in text_report(hygiene.sort_findings(findings)).toLocalIterator():
        print(row.line)
    return EXIT["blocking"] if verdict.has_blocking(findings, "error").first().blocking else EXIT["clean"]


if __name__ == "__main__":
    sys.exit(main(sys.argv))
