"""Lookups that only some entries need: years, issues, versions, venues, books, software, pages.

Each takes the entries that are left, so the dearer tables are joined by few keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.functions.text import title_key
from biblion.functions.venues import venue_core
from biblion.operators.joins import top_k


def registered_years(pairs: DataFrame, registered: DataFrame, least: int = 1, most: int = 2) -> DataFrame:
    """pairs(key, doi, year, years) whose nearest year is least to most off: registered(doi, years) joins in their years."""
    gap = F.array_min(F.transform("years", lambda y: F.abs(y - F.col("year"))))
    off = pairs.where(gap.between(least, most))
    more = off.join(registered.withColumnRenamed("years", "more"), "doi", "left")
    return more.withColumn("years", F.array_sort(F.array_union("years", F.coalesce("more", F.array().cast("array<int>"))))).drop("more")


def issue_years(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """Articles exactly one year off, with the years of their issue (journal, volume, issue)."""
    own = issues.groupBy("journal", "volume", "issue").agg(F.array_sort(F.collect_set("year")).alias("years"))
    gap = F.array_min(F.transform("years", lambda y: F.abs(y - F.col("year"))))
    return pairs.where(gap == 1).join(own.withColumnRenamed("years", "more"), ["journal", "volume", "issue"], "left").withColumn("years", F.array_sort(F.array_union("years", F.coalesce("more", F.array().cast("array<int>"))))).drop("more")


def versions(latest: DataFrame, known: DataFrame) -> DataFrame:
    """latest(id, version) -> every version from 1 on, with what known(id, version, ...) has of it."""
    every = latest.select("id", F.explode(F.sequence(F.lit(1), F.col("version"))).alias("version"))
    return every.join(known, ["id", "version"], "left")


def venue_known(entries: DataFrame, *catalogues: DataFrame) -> DataFrame:
    """entries(key, venue) -> key, catalogue: the first catalogue (name) with the venue's core among its names; null if
    none has it, and no row for a venue without a core."""
    core = entries.select("key", venue_core(F.col("venue")).alias("core")).where("core <> ''")
    out = core.withColumn("catalogue", F.lit(None).cast("int"))
    for n, c in enumerate(catalogues):
        names = c.select(venue_core(F.col("name")).alias("core"), F.lit(n).alias("hit")).where("core <> ''").distinct()
        out = out.join(names, "core", "left").withColumn("catalogue", F.coalesce("catalogue", "hit")).drop("hit")
    return out.select("key", "catalogue")


def books(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Books kept when title, first author and year all fit: entries(key, title, family, year), found(source_id, title, family, year)."""
    right = found.select("source_id", title_key(F.col("title")).alias("t"), F.lower("family").alias("f"), F.col("year").alias("y"))
    return entries.withColumns({"t": title_key(F.col("title")), "f": F.lower("family")}).join(right, ["t", "f"]).where(F.abs(F.col("year") - F.col("y")) <= 1).select("key", "source_id")


def software(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """entries(key, title, links array<struct<kind,name>>), registry(kind, name, exists): the first link that names the
    entry, else whether a linked thing is missing; what the registry does not list stays unknown."""
    link = entries.select("key", "title", F.posexplode("links").alias("pos", "l")).select("key", "title", "pos", "l.*")
    got = link.join(registry, ["kind", "name"], "left")
    short = F.regexp_extract("name", r"([^/]+)$", 1)
    named = F.arrays_overlap(F.split(title_key(F.col("title")), " "), F.array(title_key(short), F.replace(title_key(short), F.lit(" "), F.lit(""))))
    status = F.when(F.col("exists") & named, 0).when(F.col("exists").eqNullSafe(False), 1).otherwise(2)
    best = top_k(got.withColumn("s", status), ["key"], [F.col("s"), F.col("pos")], 1)
    return best.select("key", "kind", "name", F.when(F.col("s") == 0, "confirmed").when(F.col("s") == 1, "missing").otherwise("unknown").alias("status"))


def gone_pages(links: DataFrame, status: DataFrame, archived: DataFrame) -> DataFrame:
    """REF021: links(key, url) whose page is gone (404, 410) and not archived; an unclear answer is neither."""
    dead = links.join(status.where(F.col("code").isin(404, 410)).select("url"), "url", "left_semi")
    return dead.join(archived.select("url"), "url", "left_anti")


def source_counters(requests: DataFrame) -> DataFrame:
    """requests(source, outcome, reason) -> counts of each outcome, and of the reasons of those unavailable."""
    reasons = requests.where("outcome = 'unavailable'").groupBy("source", "reason").agg(F.count("*").alias("n")).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    n = requests.groupBy("source").agg(F.count("*").alias("requests"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("hit", "negative", "unavailable")])
    return n.join(reasons, "source", "left")
