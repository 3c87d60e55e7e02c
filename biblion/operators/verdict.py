"""One verdict per reference, with reasons and findings.

The cascade is a few grouped aggregates over scored pairs: an identifier that leads to the work or to another one, else
one candidate bound by the first rung of a ladder that exactly one work passes, else the reasons why nothing can be
said; and only if there is none, not_found. A source that did not answer is a reason, never a no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblion.functions.text import has_han, non_latin, title_key
from biblion.operators.resolve import GREY_TYPES, looks_cs
from biblion.tables import stash

# Fixed values.
LEAST_WORDS, YEAR_GAP, TITLE_ONLY, TITLE_ANY_YEAR, VENUE_TITLE, REWORDED, REWORDED_SCORE, OLD = 5, 3, 6, 8, 4, 2, 0.85, 1990
#: Servers whose copies of an article may have another title, and short names of such.
COPY_SERVERS = ("eprint archive", "cryptology eprint", "electronic colloquium on computational complexity", "biorxiv", "medrxiv", "chemrxiv", "ssrn", "techrxiv", "research square", "osf preprints", "preprints.org")
COPY_WORDS = ("eccc", "hal")
UNRELIABLE_PEOPLE = ("s2", "openlibrary", "github", "pypi", "cran", "huggingface", "openml")
RELEASED = ("software", "model", "dataset", "workflow")
REASONS = (
    "OFFLINE_MODE", "BUDGET_EXHAUSTED", "SOURCES_UNAVAILABLE", "CORRUPTED_SOURCE_RECORD", "NON_LATIN_UNSUPPORTED", "TRANSLATED_CHINESE_WORK", "GREY_LITERATURE", "UNINDEXED_LINK", "OLD_WORK", "UNINDEXED_VENUE", "ANONYMOUS", "TOO_NEW",
    "IDENTIFIER_EXISTS_NO_METADATA", "AMBIGUOUS_CANDIDATES", "INSUFFICIENT_METADATA",
)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def relation() -> Column:
    """What a record reached by identifier is to the entry: same, retitled, corrupted, unclear or conflict."""
    t, a = F.col("t.status"), F.col("a.status")
    agree = a.isin("match", "variant")
    placeholder = _yes(F.lower(F.trim("r_title")).rlike(r"^(untitled|title|no title|n/?a|article|front matter|editorial board|\W*)$"))
    released = _yes(F.col("r_work_type").isin(*RELEASED))
    versions_unknown = _yes(F.col("source") == "arxiv") & ~_yes(F.col("versions_known"))
    return (
        F.when(t.isin("match", "variant"), "same").when(t == "unknown", F.when(agree, "same").otherwise("unclear"))
        .when(agree, F.when(placeholder, "corrupted").when(versions_unknown | released, "unclear").otherwise("retitled"))
        .when(versions_unknown & ~_yes(F.col("a.disjoint")) & _yes(F.col("a.overlap") >= 0.5), "unclear")
        .when((a == "unknown") & _yes(F.col("t.score") >= 0.6), "unclear").when(released, "unclear").otherwise("conflict")
    )


def rungs(current_year: int) -> list[Column]:
    """The ladder for search results, strictest first."""
    t, a, y, v = F.col("t.status"), F.col("a.status"), F.col("year_status"), F.col("venue_status")
    sound = ~F.col("suspicious") & ~F.col("wrong_paper")
    gap = F.coalesce(F.col("gap"), F.lit(0))
    words = F.col("title_words")
    key, record = F.col("title_key"), F.col("work")
    changed = F.aggregate("t.changed", F.lit(0), lambda n, x: n + F.greatest(F.size(F.split(x["ours"], " ")), F.size(F.split(x["theirs"], " "))))
    longer = record.startswith(F.concat(key, F.lit(" ")))
    people = F.size(F.filter("authors", lambda p: _yes(F.length(p["family"]) > 0)))
    full_name = F.exists("authors", lambda p: _yes(F.length(F.regexp_replace(p["given"], r"[^\p{L}]", "")) > 1))
    candidate = F.col("role") == "candidate"
    return [
        candidate & F.col("acceptable"),
        candidate & (t == "match") & (a == "match") & sound & ((F.col("year") > current_year) | (v == "match") | (gap <= YEAR_GAP)),
        candidate & (a == "match") & (y == "match") & (v == "match") & _yes(F.col("t.score") >= REWORDED_SCORE) & changed.between(1, REWORDED),
        (words >= 4) & (a == "match") & F.col("a.first") & (y != "mismatch") & longer,
        (F.col("role") == "extending") & F.col("preprint") & F.col("a.first") & ((y == "match") | (F.col("year") - F.array_min("r_years")).between(1, 2)) & longer,
        candidate & (words >= 4) & ((people >= 2) | (full_name & (words >= 8) & (F.lower("entry_type") != "book"))) & (t == "match") & (a == "mismatch")
        & (y.isin("match", "variant") | ((words >= TITLE_ANY_YEAR) & (F.size("t.changed") == 0) & (gap <= YEAR_GAP))) & ((words >= TITLE_ONLY) | (v == "match")),
    ]


def bind(scored: DataFrame, current_year: int) -> DataFrame:
    """One row per key with scored pairs: bound (the pair's struct), by (anchored or the rung's number), conflict,
    corrupted, unclear, ambiguous. One grouped aggregate; a rung counts when its pairs are all of one work."""
    keep = F.struct("rank", "source", "source_id")
    p = scored.withColumn("rel", F.when(F.col("role") == "anchored", relation()))
    fits = F.col("rel").isin("same", "retitled")
    steps = rungs(current_year)
    p = p.withColumns({f"s{i}": _yes(s) & (F.col("role") != "anchored") for i, s in enumerate(steps)})
    aggs = [F.min(F.when(fits, keep)).alias("anchored"), F.max(_yes(F.col("rel") == "conflict")).alias("any_conflict"), F.max(_yes(F.col("rel") == "corrupted")).alias("corrupted"),
            F.max(F.col("role") == "anchored").alias("has_anchor"), F.count_if(F.col("role") == "candidate").alias("candidates"), F.max(_yes((F.col("role") == "candidate") & (F.col("t.status") == "match"))).alias("close")]
    for i in range(len(steps)):
        work = F.when(F.col(f"s{i}"), F.col("work"))
        aggs += [F.min(work).alias(f"lo{i}"), F.max(work).alias(f"hi{i}"), F.min(F.when(F.col(f"s{i}"), keep)).alias(f"b{i}")]
    g = p.groupBy("key").agg(*aggs)
    # a conflict counts only where no other record confirms the same identifier
    if "value" in scored.columns:
        confirmed = p.where(fits).select("key", "scheme", "value").distinct()
        real = p.where("rel = 'conflict'").join(confirmed, ["key", "scheme", "value"], "left_anti").groupBy("key").agg(F.min(keep).alias("conflict"))
        g = g.join(real, "key", "left")
    else:
        g = g.withColumn("conflict", F.lit(None).cast("struct<rank:int,source:string,source_id:string>"))
    one = [F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.struct(F.col(f"b{i}.source").alias("source"), F.col(f"b{i}.source_id").alias("source_id"), F.lit(str(i + 1)).alias("by"))) for i in range(len(steps))]
    anchored = F.when(F.col("anchored").isNotNull(), F.struct(F.col("anchored.source").alias("source"), F.col("anchored.source_id").alias("source_id"), F.lit("anchored").alias("by")))
    # several works pass the first rung: ambiguous, and no later rung may choose among them
    several = _yes(F.col("lo0") != F.col("hi0"))
    bound = F.when(anchored.isNotNull(), anchored).when(~F.col("has_anchor") & ~several, F.coalesce(*one))
    return g.select("key", bound.alias("bound"), F.col("conflict").isNotNull().alias("conflict"), "corrupted", "has_anchor", (several | (F.col("close") & bound.isNull())).alias("ambiguous"))


def field_findings(bound: DataFrame) -> DataFrame:
    """REF010 to REF014 of bound pairs, one row each: rule, severity, key, field, note."""
    reliable = ~F.col("source").isin(*UNRELIABLE_PEOPLE)
    has = lambda c: F.col(c) if c in bound.columns else F.lit(None)
    # a translated title, a preprint of an article cited by its pages, or an article whose copy on a server is cited
    low = F.lower(F.coalesce("venue", F.lit("")))
    copied = F.exists(F.array(*map(F.lit, COPY_SERVERS)), lambda name: F.contains(low, name)) | F.arrays_overlap(F.split(low, "[^a-z]+"), F.array(*map(F.lit, COPY_WORDS)))
    soft = _yes(has("translated").cast("boolean")) | (F.col("preprint") & has("volume").isNotNull() & has("first_page").isNotNull()) | (~F.col("preprint") & copied)
    known = F.coalesce(has("versions_known").cast("boolean"), F.lit(True))
    people = F.concat_ws("; ", F.array_join("a.missing", ", "), F.array_join("a.renamed", ", "), F.array_join("a.left_out", ", "))
    others = (F.col("a.status") == "mismatch") | (F.size("a.missing") > 0) | (F.size("a.renamed") > 0) | (F.size("a.left_out") > 0)
    changes = F.array_join(F.transform("t.changed", lambda x: F.concat(x["ours"], F.lit(" / "), x["theirs"])), ", ")
    short = F.col("preprint") | ~_yes(F.col("r_authors_complete"))

    def row(when: Column, rule: str, severity: Column | str, field: str, note: Column) -> Column:
        level = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(when, F.struct(F.lit(rule).alias("rule"), level.alias("severity"), F.lit(field).alias("field"), F.coalesce(note.cast("string"), F.lit("")).alias("note")))

    rows = F.array(
        row(_yes(F.col("a.disjoint")) & reliable, "REF010", "error", "author", F.lit("no author in common")),
        row(~_yes(F.col("a.disjoint")) & reliable & others, "REF011", F.when(short, "info").otherwise("warning"), "author", people),
        row((F.col("t.status") == "mismatch") | ((F.size("t.changed") > 0) & known), "REF012", F.when(soft, "info").otherwise("warning"), "title", changes),
        row(F.col("year_status") == "mismatch", "REF013", "warning", "year", F.array_join(F.array_sort("r_years").cast("array<string>"), ", ")),
        row(F.col("venue_status") == "mismatch", "REF014", "warning", "venue", F.col("r_venue")),
        row(F.col("r_doi").isNotNull() & F.col("doi").isNull(), "REF016", "info", "doi", F.col("r_doi")),
    )
    return bound.select("key", F.inline(F.array_compact(rows))).select("rule", "severity", "key", "field", "note")


def status_findings(bound: DataFrame, records: DataFrame) -> DataFrame:
    """REF004, REF005 and REF018: what any record with the bound work's DOI says of its status.

    records(source, doi, status array); bound(key, doi): retraction, concern, correction, withdrawal with their reporters.
    """
    told = records.select("source", "doi", F.explode("status").alias("status"))
    got = bound.select("key", "doi").join(told, "doi").groupBy("key", "status").agg(F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("note"))
    s = F.col("status")
    rule = F.when(s.isin("retracted", "partially_retracted"), "REF004").when(s.isin("concern", "corrected"), "REF005").when(s == "withdrawn", "REF018")
    severity = F.when(s == "retracted", "error").when(s == "corrected", "info").otherwise("warning")
    return got.select(rule.alias("rule"), severity.alias("severity"), "key", F.lit(None).cast("string").alias("field"), F.concat_ws(": ", "status", "note").alias("note")).where("rule is not null")


def status_reporters(reports: DataFrame, key: list[str]) -> DataFrame:
    """reports(key..., source): which sources report a status, in order, and how often it was reported (n)."""
    return reports.groupBy(*key).agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count("*").alias("n"))


def missing_everywhere(missing: DataFrame, others: DataFrame) -> DataFrame:
    """missing(key, person) that no other record of the work names: others(key, person)."""
    return missing.join(others, ["key", "person"], "left_anti")


def published_versions(preprints: DataFrame, versions: DataFrame) -> DataFrame:
    """REF015: the published version least unlike each cited preprint. preprints(key, title_key, author), versions(title_key,
    author, source_id, year, venue)."""
    got = preprints.join(versions, ["title_key", "author"])
    return got.groupBy("key").agg(F.min(F.struct("year", "source_id", "venue")).alias("v")).select(F.lit("REF015").alias("rule"), F.lit("warning").alias("severity"), "key", F.lit("venue").alias("field"), F.concat_ws(", ", "v.venue", F.col("v.year").cast("string")).alias("note"))


def abstentions(entries: DataFrame, answers: DataFrame, current_year: int, required: tuple[str, ...] = ("crossref",), cs_required: tuple[str, ...] = ("dblp",)) -> DataFrame:
    """key, reasons (array in their order) for entries that nothing was bound to.

    entries: key, title, entry_type, venue, year, authors, has_identifier, live_identifier, link_unindexed, venue_known,
    translated, corrupted, ambiguous; answers(key, source, outcome, reason).
    """
    known = answers.groupBy("key").agg(
        F.collect_set(F.when(F.col("outcome") == "negative", F.col("source"))).alias("no"), F.collect_set(F.when(F.col("outcome") == "unavailable", F.coalesce("reason", F.lit("SOURCES_UNAVAILABLE")))).alias("down")
    )
    e = entries.join(known, "key", "left")
    no, down = (F.coalesce(c, F.array().cast("array<string>")) for c in ("no", "down"))
    live = _yes(F.col("live_identifier"))
    need = F.when(_yes(looks_cs(F.col("entry_type"), F.col("venue"))), F.array(*map(F.lit, required + cs_required))).otherwise(F.array(*map(F.lit, required)))
    anonymous = F.exists("authors", lambda p: _yes(F.lower(F.concat_ws(" ", p["given"], p["family"], p["literal"])).contains("anonymous")))
    web_only = _yes(F.lower("venue").rlike(r"workshop|@|blog|online"))
    old = _yes(F.col("year") < OLD)
    unlinked = ~live
    words = F.size(F.filter(F.split(title_key(F.col("title")), " "), lambda w: w != ""))
    listed = F.array(
        F.when(F.array_contains(down, "OFFLINE_MODE"), "OFFLINE_MODE").when(F.array_contains(down, "BUDGET_EXHAUSTED"), "BUDGET_EXHAUSTED").when(F.size(down) > 0, "SOURCES_UNAVAILABLE"),
        F.when(_yes(F.col("corrupted")), "CORRUPTED_SOURCE_RECORD"),
        F.when(_yes(non_latin(F.col("title"))), "NON_LATIN_UNSUPPORTED").when(_yes(F.col("translated")), "TRANSLATED_CHINESE_WORK"),
        F.when(unlinked & _yes(F.lower("entry_type").isin(*GREY_TYPES)), "GREY_LITERATURE").when(unlinked & _yes(F.col("link_unindexed")), "UNINDEXED_LINK"),
        F.when(unlinked & old, "OLD_WORK").when(unlinked & web_only, "UNINDEXED_VENUE"),
        F.when(anonymous, "ANONYMOUS"), F.when(_yes(F.col("year").isin(current_year, current_year + 1)), "TOO_NEW"), F.when(live, "IDENTIFIER_EXISTS_NO_METADATA"), F.when(_yes(F.col("ambiguous")), "AMBIGUOUS_CANDIDATES"),
    )
    reasons = F.array_compact(listed)
    thin = (F.size(F.array_except(need, no)) > 0) | F.col("title").isNull() | ((words < LEAST_WORDS) & ~_yes(F.col("venue_known")))
    return e.select("key", F.when((F.size(reasons) == 0) & thin, F.array(F.lit("INSUFFICIENT_METADATA"))).otherwise(reasons).alias("reasons"))


def decide(entries: DataFrame, scored: DataFrame, answers: DataFrame, current_year: int, dead: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(assessments: key, verdict, reasons, source, source_id, by; findings: rule, severity, key, field, note).

    dead(key, value): identifiers that their authority says do not exist.
    """
    dead = dead if dead is not None else entries.limit(0).select("key", F.lit("").alias("value"))
    tied = stash(bind(scored, current_year), "bound")
    pairs = tied.where("bound is not null").select("key", "bound.*").join(scored, ["key", "source", "source_id"])
    pairs = pairs.dropDuplicates(["key"])
    fields = stash(field_findings(pairs), "fields")
    wrong = fields.where(F.col("rule").isin("REF010", "REF011", "REF012", "REF013", "REF014", "REF020") & (F.col("severity") != "info")).select("key").distinct().withColumn("wrong", F.lit(True))
    agree = pairs.select("key", (F.col("t.status").isin("match", "variant").cast("int") + F.col("a.status").isin("match", "variant").cast("int") + F.col("year_status").isin("match", "variant").cast("int")).alias("agree"))
    gone = dead.groupBy("key").agg(F.min("value").alias("gone"))
    e = entries.join(tied, "key", "left").join(wrong, "key", "left").join(agree, "key", "left").join(gone, "key", "left")
    loose = e.where("bound is null and not coalesce(conflict, false)")
    why = abstentions(loose.drop("corrupted", "ambiguous").join(tied.select("key", "corrupted", "ambiguous"), "key", "left"), answers, current_year)
    e = e.join(stash(why, "reasons"), "key", "left")
    verdict = (
        F.when(_yes(F.col("conflict")), "identifier_conflict")
        .when(F.col("bound").isNotNull(), F.when(_yes(F.col("wrong")) | F.col("gone").isNotNull(), "metadata_mismatch").when(F.col("agree") >= 2, "verified").otherwise("cannot_determine"))
        .when(F.size(F.coalesce("reasons", F.array().cast("array<string>"))) == 0, "not_found").otherwise("cannot_determine")
    )
    none = F.array().cast("array<string>")
    reasons = F.when(F.col("bound").isNotNull() & (verdict == "cannot_determine"), F.array(F.lit("INSUFFICIENT_METADATA"))).when(verdict == "cannot_determine", F.col("reasons")).otherwise(none)
    out = stash(e.select("key", verdict.alias("verdict"), reasons.alias("reasons"), "bound.source", "bound.source_id", "bound.by"), "assessments")
    row = lambda df, rule, severity, field, note: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "key", F.lit(field).cast("string").alias("field"), note.alias("note"))
    nothing = F.lit(None).cast("string")
    findings = (
        fields.unionByName(row(out.where("verdict = 'identifier_conflict'"), "REF001", "error", "doi", nothing)).unionByName(row(out.where("verdict = 'not_found'"), "REF003", "error", None, nothing))
        .unionByName(row(out.where("verdict = 'cannot_determine'"), "REF090", "info", None, F.array_join("reasons", ", "))).unionByName(row(gone, "REF002", "error", "doi", F.col("gone")))
    )
    return out, findings


def has_blocking(findings: DataFrame, fail_on: str) -> DataFrame:
    from biblion.operators.hygiene import severity_rank

    return findings.agg(F.coalesce(F.bool_or(severity_rank(F.col("severity")) >= severity_rank(F.lit(fail_on))), F.lit(False)).alias("blocking"))


def translated(title: Column, venue: Column, other: Column, journals: tuple[str, ...], language: Column) -> Column:
    """A Chinese work cited by a translated title: its journal, a language mark, or Chinese in another field."""
    return _yes(venue.rlike(r"(?i)^\W*(?:" + "|".join(journals) + r")\W*$")) | _yes(F.lower(title).rlike(r"\[?in chinese\]?")) | _yes(has_han(other)) | _yes(F.lower(language).rlike(r"^(zh|chi)"))


def other_works(scored: DataFrame) -> DataFrame:
    """Pairs of a search whose record cannot be the cited work: nobody in common and another title. Records of sources
    whose people are not reliable are never counted among them, nor pairs of entries without named people."""
    named = F.exists("authors", lambda p: F.coalesce(p["literal"], F.lit("")) == "")
    return scored.where(named & ~F.col("source").isin(*UNRELIABLE_PEOPLE) & _yes(F.col("a.disjoint")) & (F.col("t.status") != "match"))
