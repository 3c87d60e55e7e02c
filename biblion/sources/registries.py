"""Registry answers as records: projections from each registry's JSON columns to one schema. Native expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblion.functions.idents import normalize_doi
from biblion.functions.text import collapse

PEOPLE = "array<struct<family:string,given:string,literal:string>>"
CROSSREF = (
    "DOI string, title array<string>, subtitle array<string>, type string, author array<struct<given:string,family:string,name:string>>, issued struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>, "
    "`published-online` struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>, `container-title` array<string>, event struct<name:string>, `updated-by` array<struct<type:string,source:string,DOI:string>>, "
    "relation map<string,array<struct<id:string>>>, volume string, issue string, page string, ISSN array<string>, publisher string, URL string"
)
DATACITE = (
    "attributes struct<doi:string,titles:array<struct<title:string>>,creators:array<struct<name:string,nameType:string,givenName:string,familyName:string>>,publicationYear:int,dates:array<struct<date:string,dateType:string>>,"
    "types:struct<resourceTypeGeneral:string>,publisher:string,url:string>"
)
OPENALEX = "id string, doi string, title string, publication_year int, type string, is_retracted boolean, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string,issn:array<string>>>, ids map<string,string>"
PUBMED = "uid string, pubdate string, authors array<struct<name:string,authtype:string>>, title string, fulljournalname string, pubtype array<string>, articleids array<struct<idtype:string,value:string>>, volume string, issue string, pages string"
COLUMNS = "source source_id title authors authors_complete authors_ordered year years venue work_type identifiers alt_titles status volume issue pages publisher url reissue issns".split()


def plain(c: Column) -> Column:
    """A registry's title as text: tags and footnote marks off, entities decoded."""
    c = F.regexp_replace(c, r"(?s)<[^<>]{1,200}>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return collapse(c)


def person(family: Column, given: Column, literal: Column) -> Column:
    suffix = F.regexp_replace(F.trim(family), r"(?i),?\s+(?:jr|sr|ii|iii|iv)\.?$", "")
    return F.struct(F.when(literal.isNull(), suffix).alias("family"), F.when(literal.isNull(), F.regexp_replace(F.trim(given), r"[*†‡\d]+$", "")).alias("given"), literal.alias("literal"))


def display(c: Column) -> Column:
    """A one-string name: Family, Given or Given Family."""
    comma = F.contains(c, F.lit(","))
    family = F.when(comma, F.substring_index(c, ",", 1)).otherwise(F.regexp_extract(F.trim(c), r"((?:(?:von|van|der|den|de|del|di|da|dos|la|le|ter|ten|zu|al)\s+)*\S+)$", 1))
    given = F.when(comma, F.trim(F.regexp_replace(c, r"^[^,]*,\s*", ""))).otherwise(F.trim(F.expr("''")))
    rest = F.trim(F.substr(F.trim(c), F.lit(1), F.length(F.trim(c)) - F.length(family)))
    return person(family, F.when(comma, given).otherwise(rest), F.lit(None).cast("string"))


def _record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    none, no_list = F.lit(None).cast("string"), F.array().cast("array<string>")
    default = {
        "source": F.lit(source), "authors_complete": F.lit(True), "authors_ordered": F.lit(True), "venue": none, "alt_titles": no_list, "status": no_list, "volume": none, "issue": none, "pages": none, "publisher": none, "url": none,
        "reissue": F.lit(False), "issns": no_list, "work_type": none, "identifiers": F.create_map().cast("map<string,string>"),
    }
    row = default | columns
    row["year"] = F.coalesce(row.get("year", F.lit(None).cast("int")), F.array_min(row["years"]))
    return df.select(*[row[c].alias(c) for c in COLUMNS])


def crossref(df: DataFrame) -> DataFrame:
    """df: columns of CROSSREF. All registered years count; print before online before created for the year itself."""
    year = lambda n: F.get(F.get(F.col(f"`{n}`.`date-parts`"), F.lit(0)), F.lit(0))
    years = F.array_sort(F.array_distinct(F.array_compact(F.array(year("issued"), year("published-print"), year("published-online")))))
    years = F.when(F.size(years) > 0, years).otherwise(F.array_compact(F.array(year("created"))))
    title = plain(F.get("title", F.lit(0)))
    sub = plain(F.get("subtitle", F.lit(0)))
    told = F.transform(F.coalesce("updated-by", F.array().cast("array<struct<type:string,source:string,DOI:string>>")), lambda u: F.when(u["type"].isin("retraction", "withdrawal", "removal"), "retracted").when(u["type"] == "expression_of_concern", "concern").when(u["type"].isin("correction", "erratum", "corrigendum"), "corrected").when(u["type"] == "partial_retraction", "partially_retracted"))
    marked = F.when(title.rlike(r"(?i)^\W*(retracted|withdrawn)(\s+article)?\W*[:.]"), F.array(F.lit("retracted"))).otherwise(F.array().cast("array<string>"))
    people = F.transform("author", lambda a: person(a["family"], a["given"], F.when(a["family"].isNull(), a["name"])))
    return _record(
        df, "crossref", source_id=F.lower("DOI"), title=title, authors=people, years=years, venue=F.coalesce(plain(F.get("container-title", F.lit(0))), F.col("event.name")), work_type=F.col("type"), identifiers=F.create_map(F.lit("doi"), F.lower("DOI")),
        alt_titles=F.when(sub.isNotNull() & (sub != ""), F.array(F.concat(title, F.lit(": "), sub))).otherwise(F.array().cast("array<string>")), status=F.array_distinct(F.array_compact(F.concat(told, marked))), volume=F.col("volume"), issue=F.col("issue"), pages=F.col("page"),
        publisher=F.col("publisher"), url=F.col("URL"), issns=F.coalesce("ISSN", F.array().cast("array<string>")),
    )


def datacite(df: DataFrame) -> DataFrame:
    a = "attributes."
    year_of = lambda d: F.regexp_extract(d["date"], r"^(\d{4})", 1).cast("int")
    years = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(a + "publicationYear"), F.transform(F.filter(a + "dates", lambda d: d["dateType"].isin("Issued", "Available", "Submitted", "Updated")), year_of)))))
    people = F.transform(a + "creators", lambda c: F.when(c["nameType"] == "Organizational", person(F.lit(None).cast("string"), F.lit(None).cast("string"), c["name"])).when(c["familyName"].isNotNull(), person(c["familyName"], c["givenName"], F.lit(None).cast("string"))).otherwise(display(c["name"])))
    kind = F.lower(a + "types.resourceTypeGeneral")
    titles = F.transform(a + "titles", lambda t: plain(t["title"]))
    return _record(df, "datacite", source_id=F.lower(a + "doi"), title=F.get(titles, F.lit(0)), alt_titles=F.slice(titles, 2, 20), authors=people, years=years, work_type=kind, identifiers=F.create_map(F.lit("doi"), F.lower(a + "doi")), publisher=F.col(a + "publisher"), url=F.col(a + "url"))


def openalex(df: DataFrame) -> DataFrame:
    people = F.transform("authorships", lambda x: display(x["author"]["display_name"]))
    doi = normalize_doi(F.col("doi"))
    return _record(df, "openalex", source_id=F.col("id"), title=plain(F.col("title")), authors=people, years=F.array_compact(F.array("publication_year")), venue=F.col("primary_location.source.display_name"), work_type=F.col("type"), identifiers=F.when(doi.isNotNull(), F.create_map(F.lit("doi"), doi)).otherwise(F.create_map().cast("map<string,string>")),
                   status=F.when(F.col("is_retracted"), F.array(F.lit("retracted"))).otherwise(F.array().cast("array<string>")), issns=F.coalesce("primary_location.source.issn", F.array().cast("array<string>")))


def pubmed(df: DataFrame) -> DataFrame:
    """Names come as Family IJ; groups say so."""
    def one(a: Column) -> Column:
        family = F.regexp_replace(a["name"], r"\s+[A-Z]{1,4}$", "")
        given = F.regexp_extract(a["name"], r"\s+([A-Z]{1,4})$", 1)
        return F.when(a["authtype"] == "CollectiveName", person(F.lit(None).cast("string"), F.lit(None).cast("string"), a["name"])).otherwise(person(family, given, F.lit(None).cast("string")))

    ids = F.map_from_entries(F.transform(F.filter("articleids", lambda i: i["idtype"].isin("doi", "pmc", "pubmed")), lambda i: F.struct(F.when(i["idtype"] == "pmc", "pmcid").when(i["idtype"] == "pubmed", "pmid").otherwise("doi"), F.lower(i["value"]))))
    status = F.when(F.array_contains("pubtype", "Retracted Publication"), F.array(F.lit("retracted"))).otherwise(F.array().cast("array<string>"))
    return _record(df, "pubmed", source_id=F.col("uid"), title=F.regexp_replace(plain(F.col("title")), r"\.$", ""), authors=F.transform("authors", one), years=F.array_compact(F.array(F.nullif(F.regexp_extract("pubdate", r"^(\d{4})", 1), F.lit("")).cast("int"))), venue=F.col("fulljournalname"), work_type=F.lit("journal-article"), identifiers=ids, status=status, volume=F.col("volume"), issue=F.col("issue"), pages=F.col("pages"))


def dblp(rows: DataFrame) -> DataFrame:
    """rows(pub, title, type, venue, year, doi, ord, name): one a person; put together in the order of ord."""
    one = rows.groupBy("pub").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("title", "type", "venue", "year", "doi")], F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    people = F.transform("names", lambda n: display(F.regexp_replace(n, r"\s+\d{4}$", "")))
    doi = normalize_doi(F.col("doi"))
    return _record(one, "dblp", source_id=F.col("pub"), title=F.regexp_replace(plain(F.col("title")), r"\.$", ""), authors=people, years=F.array_compact(F.array(F.col("year").cast("int"))), venue=F.col("venue"), work_type=F.col("type"), identifiers=F.when(doi.isNotNull(), F.create_map(F.lit("doi"), doi)).otherwise(F.create_map().cast("map<string,string>")))


def arxiv(df: DataFrame) -> DataFrame:
    """df(id, version, title, names array, published, updated, comment, journal_ref, doi): a comment of withdrawal counts."""
    withdrawn = F.lower("comment").rlike(r"withdraw") & ~F.lower("comment").rlike(r"reinstat|restor|un-?withdraw")
    years = F.array_sort(F.array_distinct(F.array_compact(F.array(F.year(F.to_timestamp("published")), F.year(F.to_timestamp("updated"))))))
    ids = F.map_filter(F.create_map(F.lit("arxiv"), F.col("id"), F.lit("doi"), normalize_doi(F.col("doi"))), lambda k, v: v.isNotNull())
    return _record(df, "arxiv", source_id=F.col("id"), title=collapse(F.col("title")), authors=F.transform("names", display), years=years, venue=F.coalesce("journal_ref", F.lit("arXiv")), work_type=F.lit("preprint"), identifiers=ids, status=F.when(withdrawn, F.array(F.lit("withdrawn"))).otherwise(F.array().cast("array<string>")))


def agency_answers(answers: DataFrame, handles: DataFrame) -> DataFrame:
    """answers(doi, agency or null, status), handles(doi, code): agency and exists; only the handle service makes a DOI
    missing, and a DOI that neither answers clearly drops out."""
    exists = F.when(F.col("agency").isNotNull(), True).when(F.col("code").isin(404, 400), False).when(F.col("code") == 200, True)
    return answers.join(handles, "doi", "left").select("doi", "agency", exists.alias("exists")).where("exists is not null")


def outcome(status: Column, content_type: Column, wanted: Column) -> Column:
    """hit, negative or unavailable, from an answer's status and type; a page where data was asked for is no answer."""
    return F.when(status.isin(404, 410), "negative").when((status == 200) & content_type.startswith(wanted), "hit").otherwise("unavailable")


def normalise_json(raw: DataFrame, registry: str) -> DataFrame:
    """raw(payload string) of one registry -> records."""
    schema, f = {"crossref": (CROSSREF, crossref), "datacite": (DATACITE, datacite), "openalex": (OPENALEX, openalex), "pubmed": (PUBMED, pubmed)}[registry]
    return f(raw.select(F.from_json("payload", schema).alias("p")).select("p.*"))
