"""Operator 6: licence scan by canonical digests (DataFrame operations only).

A text is made canonical line by line, once: lines that say who holds the copyright go, letters become small, and all
but letters and digits becomes a space. The lines joined are the canonical text, in which equivalent spellings are
then made one. It is digested and looked up among the digests of known licences by a hash join. Two kinds of whole
texts are looked up: the document, and each of its lines (a licence notice stands on a line of its own).

The known side is broadcast only when it has MAX_BROADCAST_KEYS rows or fewer (about 100 bytes each), else the
join is shuffled. A line is looked up by digest alone, so a line that many documents share costs no more than
others; what is gathered for a document is a set of licence names.

Edge cases. Null or empty text has the digest of the empty text and no licence (an empty canonical text is never
looked up). Two known licences with the same canonical text: the alphabetically first names it. Repeated
doc_ids are one document each (rows are told apart by a row number of their own). Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm.license_texts import DIGESTS, NOTICES, TEXTS
from biblion.llm.shared import literal_rows, small, table, text_or_empty

MAX_BROADCAST_KEYS = 100_000

#: Spellings that count as the same, in small letters and without marks; fixed values.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("recognise", "recognize"), ("organisation", "organization"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("version ", "v"), ("https ", "http "),
)
#: A line that says who holds the copyright, in small letters: the word is not the last of the line, and what follows is
#: no word that a sentence of a licence has there.
_GOES_ON = "notices?|holders?|owners?|laws?|interests?|licen[cs]es?|statements?|protection|permission|and|or|on|in|to|for|of|is"
OWNS = r"^[ \t]*(copyright([^a-z]|$)|\(c\)[ \t]*[0-9<]|©)"
GOES_ON = rf"^[ \t]*copyright([^\p{{L}}\p{{N}}(©<]*$|[ \t]+({_GOES_ON})([^\p{{L}}\p{{N}}]|$))"
NOT_WORD = r"[^\p{L}\p{N}]+"


def bare_lines(text: Column) -> Column:
    """The lines of a text without marks and without lines of ownership; spellings as they are."""
    bare = lambda line: F.when(line.rlike(OWNS) & ~line.rlike(GOES_ON), "").otherwise(F.trim(F.regexp_replace(line, NOT_WORD, " ")))
    return F.filter(F.transform(F.split(F.lower(text), "\n"), bare), lambda line: line != "")


def spelled(bare: Column) -> Column:
    for a, b in SPELLINGS:
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return bare


def canonical(text: Column) -> Column:
    return spelled(F.array_join(bare_lines(text), " "))


def known_digests(spark: SparkSession, known: dict[str, list[str]], digests: dict[str, tuple] | None = None) -> DataFrame:
    """license, digest of each known text, and of those that are known by their digest alone.

    Texts are few and short here; a larger list can be passed as a table.
    """
    rows = [(name, text, None) for name, texts in known.items() for text in texts]
    rows += [(name, None, digest) for name, many in (digests or {}).items() for digest in many]
    df = literal_rows(spark, ["license", "text", "digest"], rows)
    return df.select("license", F.coalesce("digest", F.sha2(canonical(F.col("text")), 256)).alias("digest"))


def scan(docs: DataFrame, texts: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs + digest tables (license, digest) -> one row per document.

    Columns: id, text_digest, text_license (of the whole document), notices (names, sorted, comma-joined),
    n_notices (lines that are a notice) and licensed.
    """
    once = lambda df, whole: df.groupBy("digest").agg(F.min("license").alias("license")).select(F.lit(whole).alias("whole"), "digest", "license")
    known = small(once(texts, True).union(once(notices, False)), MAX_BROADCAST_KEYS)
    rows = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("row"), bare_lines(text_or_empty(text_col)).alias("lines"))
    digest = lambda bare: F.sha2(spelled(bare), 256)
    one = lambda whole, bare: F.struct(F.lit(whole).alias("whole"), F.size("lines").alias("n"), digest(bare).alias("digest"))
    parts = F.concat(F.array(one(True, F.array_join("lines", " "))), F.transform("lines", lambda line: one(False, line)))
    found = rows.select("__id", "row", F.explode(parts).alias("p")).select("__id", "row", "p.*").join(known, ["whole", "digest"], "left").where("whole or license is not null")
    of_line = F.when(~F.col("whole"), F.col("license"))
    found = found.groupBy("row").agg(
        F.first("__id").alias(id_col), F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"), F.max(F.when(F.col("whole") & (F.col("n") > 0), F.col("license"))).alias("text_license"),
        F.array_join(F.sort_array(F.collect_set(of_line)), ",").alias("notices"), F.count(of_line).alias("n_notices"),
    )
    return found.select(id_col, "text_digest", "text_license", "notices", "n_notices", (F.col("text_license").isNotNull() | (F.col("n_notices") > 0)).alias("licensed"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = known_digests(spark, {name: [text] for name, text in TEXTS.items()} | {f"{k} notice": v for k, v in NOTICES.items()}, DIGESTS)
    return scan(table(spark, sf_dir, "documents"), texts, known_digests(spark, NOTICES))


def _sql_spelled(bare: str) -> str:
    for a, b in SPELLINGS:
        bare = f"replace({bare}, '{a}', '{b}')"
    return bare


def _sql_lines(text: str) -> str:
    owns = f"regexp_matches(x, '{OWNS}') and not regexp_matches(x, '{GOES_ON}')"
    bare = f"list_transform(string_split(lower({text}), chr(10)), lambda x: case when {owns} then '' else trim(regexp_replace(x, '{NOT_WORD}', ' ', 'g')) end)"
    return f"list_filter({bare}, lambda x: x <> '')"


def _sql_digest(text: str) -> str:
    return "sha256(" + _sql_spelled(f"array_to_string({_sql_lines(text)}, ' ')") + ")"


def _sql_values(known: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known)


OP6_SQL = f"""
with t as (select digest, min(license) as license from (select license, {_sql_digest("text")} as digest
    from (values {_sql_values([*TEXTS.items(), *((f"{k} notice", x) for k, v in NOTICES.items() for x in v)])}) as v(license, text)
    union all select * from (values {_sql_values([(k, x) for k, v in DIGESTS.items() for x in v])}) as v(license, digest)) group by digest),
n as (select digest, min(license) as license from (select license, {_sql_digest("text")} as digest
    from (values {_sql_values([(k, x) for k, v in NOTICES.items() for x in v])}) as v(license, text)) group by digest),
b as (select doc_id, {_sql_lines("coalesce(text, '')")} as lines from documents),
w as (select doc_id, len(lines) as n, {_sql_spelled("array_to_string(lines, ' ')")} as canon from b),
l as (select doc_id, {_sql_spelled("line")} as canon from (select doc_id, unnest(lines) as line from b)),
f as (select doc_id, string_agg(distinct license, ',' order by license) as notices, count(*) as n_notices
    from l join n on n.digest = sha256(l.canon) group by doc_id)
select w.doc_id, sha256(w.canon) as text_digest, t.license as text_license, coalesce(notices, '') as notices,
    coalesce(n_notices, 0) as n_notices, t.license is not null or n_notices is not null as licensed
from w left join t on t.digest = sha256(w.canon) and w.n > 0 left join f using (doc_id)
"""
