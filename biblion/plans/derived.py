"""Citation-like relations derived from the driver's tables, for queries whose operators need such data.

Each has a Spark form and a SQL form with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cites(spark: SparkSession, sf: str) -> DataFrame:
    """Citations: the customer of each order, some of whom do not exist."""
    who = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey") - F.col("o_custkey") % 7)
    return table(spark, sf, "orders").select(F.concat(F.lit("c"), who.cast("string")).alias("key"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("line"))


CITES = """(select 'c' || cast(case when o_orderkey % 97 = 0 then o_custkey + 1000000 else o_custkey - o_custkey % 7 end as varchar) as key,
    o_orderpriority as file, o_orderkey as line from orders)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("line"))


ENTRIES = "(select 'c' || cast(c_custkey as varchar) as key, c_mktsegment as file, c_custkey as line from customer)"


def bib(spark: SparkSession, sf: str) -> DataFrame:
    """Entries: a title, year, venue and DOI for every document; exact copies share a DOI."""
    line = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.array_join(F.slice(F.split(line, " "), 1, 12), " ").alias("title"),
        (1980 + F.col("doc_id") % 45).cast("int").alias("year"), F.col("source").alias("venue"), F.col("lang"),
        F.concat(F.lit("10."), (1000 + F.col("doc_id") % 50).cast("string"), F.lit("/"), F.substring(F.md5("text"), 1, 8)).alias("doi"), F.substring(F.md5("text"), 1, 8).alias("work"),
    )


BIB = """(select doc_id as ord, 'd' || cast(doc_id as varchar) as key,
    array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:12], ' ') as title, cast(1980 + doc_id % 45 as int) as year, source as venue, lang,
    '10.' || cast(1000 + doc_id % 50 as varchar) || '/' || substr(md5(text), 1, 8) as doi, substr(md5(text), 1, 8) as work from documents)"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Records: the even documents, with a word dropped, a year or a venue off, by the residue of doc_id."""
    b = bib(spark, sf).where("ord % 2 = 0")
    words = F.split("title", " ")
    short = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    return b.select(
        "ord", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("source_id"), F.when(F.col("ord") % 3 == 0, "crossref").when(F.col("ord") % 3 == 1, "datacite").otherwise("other").alias("source"),
        F.when(F.col("ord") % 10 == 4, short).otherwise(F.col("title")).alias("title"), F.when(F.col("ord") % 10 == 6, F.col("year") + 1).when(F.col("ord") % 14 == 0, F.col("year") + 5).otherwise(F.col("year")).alias("year"),
        F.when(F.col("ord") % 10 == 8, "elsewhere").otherwise(F.col("venue")).alias("venue"), "doi", "work",
    )


REGISTRY = f"""(select ord, 'r' || cast(ord as varchar) as source_id, case when ord % 3 = 0 then 'crossref' when ord % 3 = 1 then 'datacite' else 'other' end as source,
    case when ord % 10 = 4 then array_to_string(string_split(title, ' ')[1 : greatest(len(string_split(title, ' ')) - 1, 1)], ' ') else title end as title,
    case when ord % 10 = 6 then year + 1 when ord % 14 = 0 then year + 5 else year end as year,
    case when ord % 10 = 8 then 'elsewhere' else venue end as venue, doi, work from {BIB} where ord % 2 = 0)"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings: what each order line would report."""
    n = F.col("l_orderkey") + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("REF0"), (10 + n % 5 + F.col("l_partkey") % 7).cast("string")).alias("rule"), F.when(n % 3 == 0, "error").when(n % 3 == 1, "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("k"), (F.col("l_orderkey") % 1000).cast("string")).alias("key"), F.element_at(F.array(F.lit("title"), F.lit("year"), F.lit("author"), F.lit("venue")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("field"),
        F.col("l_returnflag").alias("file"), F.col("l_orderkey").cast("long").alias("line"), F.col("l_linenumber").cast("int").alias("ord"),
    )


FINDINGS = """(select 'REF0' || cast(10 + (l_orderkey + l_linenumber) % 5 + l_partkey % 7 as varchar) as rule,
    case when (l_orderkey + l_linenumber) % 3 = 0 then 'error' when (l_orderkey + l_linenumber) % 3 = 1 then 'warning' else 'info' end as severity,
    'k' || cast(l_orderkey % 1000 as varchar) as key, ['title', 'year', 'author', 'venue'][l_suppkey % 4 + 1] as field,
    l_returnflag as file, l_orderkey as line, cast(l_linenumber as int) as ord from lineitem)"""

#: lower-cased, accents stripped, ß taken apart: the fold of the title key for the letters in these tables.
SQL_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"
SQL_KEY = "array_to_string(regexp_extract_all(" + SQL_FOLD + ", '[\\p{{L}}\\p{{N}}_]+'), ' ')"
