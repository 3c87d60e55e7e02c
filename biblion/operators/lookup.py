"""One reference out of an identifier or a title: found, ambiguous, not_found or unavailable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.functions import idents
from biblion.functions.text import title_key
from biblion.operators.joins import top_k
from biblion.operators.resolve import record_ids
from biblion.operators.scoring import PRIORITY


def lookup(queries: DataFrame, records: DataFrame, available: bool = True, shown: int = 5) -> DataFrame:
    """queries(query) -> query, status, source, source_id, titles (of an ambiguous one, at most shown).

    An identifier takes the record of a published work before a preprint, then by the order of the sources; a title takes
    the one work whose key is the same.
    """
    doi, ax, pm = idents.normalize_doi(F.col("query")), idents.arxiv_id(F.col("query"), False)["id"], idents.pmcid(F.col("query"))
    value = F.lower(F.coalesce(doi, ax, pm))
    q = queries.withColumn("value", value).withColumn("title_key", F.when(F.col("value").isNull(), title_key(F.col("query"))))
    ranked = records.withColumns({"pre": (F.coalesce(F.col("work_type"), F.lit("")).isin("preprint", "posted-content") | (F.col("source") == "arxiv")).cast("int"), "prio": F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("source")), F.lit(9))})
    by_id = q.where("value is not null").join(record_ids(records).select("source", "source_id", "value").distinct(), "value").join(ranked.select("source", "source_id", "pre", "prio"), ["source", "source_id"])
    by_id = top_k(by_id, ["query"], [F.col("pre"), F.col("prio"), F.col("source_id")], 1).select("query", F.lit("found").alias("status"), "source", "source_id", F.array().cast("array<string>").alias("titles"))
    keyed = ranked.withColumn("title_key", title_key(F.col("title")))
    works = F.array_sort(F.collect_set(F.concat_ws(" ", "title", F.concat(F.lit("("), F.get(F.transform("authors", lambda p: F.coalesce(p["family"], p["literal"])), F.lit(0)), F.lit(")")))))
    by_title = q.where("value is null and title_key <> ''").join(keyed, "title_key").groupBy("query").agg(works.alias("titles"), F.min(F.struct("pre", "prio", "source", "source_id")).alias("b"))
    one = F.size("titles") == 1
    by_title = by_title.select("query", F.when(one, "found").otherwise("ambiguous").alias("status"), F.when(one, F.col("b.source")).alias("source"), F.when(one, F.col("b.source_id")).alias("source_id"), F.when(one, F.array().cast("array<string>")).otherwise(F.slice("titles", 1, shown)).alias("titles"))
    got = queries.join(by_id.unionByName(by_title), "query", "left")
    return got.withColumn("status", F.coalesce("status", F.lit("not_found" if available else "unavailable")))
