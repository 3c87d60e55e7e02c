"""Evidence for entries: identifiers to registries, search for what is not anchored, and what each source answered.

Each stage is a join whose left side is what the stages before have left. Registries are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblion.functions import idents
from biblion.functions.text import title_key
from biblion.operators import grams, joins
from biblion.tables import stash

# Hosts whose papers the sources index, entry types, and cut-offs.
INDEXED_HOSTS = tuple(
    "doi.org arxiv.org openreview.net proceedings.mlr.press jmlr.org nips.cc neurips.cc aclanthology.org aclweb.org thecvf.com ecva.net aaai.org ijcai.org usenix.org ieee.org acm.org springer.com sciencedirect.com "
    "elsevier.com wiley.com nature.com science.org tandfonline.com sagepub.com oup.com cambridge.org iop.org aps.org aip.org mdpi.com frontiersin.org plos.org biorxiv.org medrxiv.org nih.gov europepmc.org adsabs.harvard.edu "
    "semanticscholar.org dblp.org openalex.org crossref.org datacite.org zenodo.org pnas.org cell.com jstor.org aanda.org".split()
)
CS_TYPES = ("inproceedings", "conference", "proceedings")
GREY_TYPES = ("book", "booklet", "manual", "misc", "online", "software", "techreport", "report", "phdthesis", "mastersthesis", "thesis", "unpublished", "electronic", "standard", "patent", "dataset")
SEARCH_ROWS = 10


def unindexed(hosts: DataFrame, indexed: list[str] | tuple[str, ...] = INDEXED_HOSTS) -> DataFrame:
    """hosts(host) that are none of the indexed ones nor below one."""
    known = F.lit(False)
    for h in indexed:
        known = known | (F.col("host") == h) | F.col("host").endswith("." + h)
    return hosts.where(~known)


def looks_cs(entry_type: Column, venue: Column) -> Column:
    from biblion.functions.venues import canonical

    return F.lower(entry_type).isin(*CS_TYPES) | F.coalesce(canonical(venue) != "arxiv", F.lit(False))


def identifiers(entries: DataFrame) -> DataFrame:
    """entries(key, fields map<string,string>) -> identifiers(key, ord, scheme, value, field, version, raw).

    Fields in the order of their authority; the first place of a (scheme, value) stays.
    """
    f = lambda n: F.col("fields")[n]
    one = lambda scheme, value, field, version=None, raw=None: F.struct(
        F.lit(scheme).alias("scheme"), value.alias("value"), F.lit(field).alias("field"), (F.lit(None).cast("string") if version is None else version).alias("version"), (f(field) if raw is None else raw).alias("raw")
    )
    archive = F.lower(F.coalesce(f("archiveprefix"), f("eprinttype"), F.lit("")))
    ax = lambda n, ctx: idents.arxiv_id(f(n), ctx)
    found = [one("doi", idents.normalize_doi(f("doi")), "doi"), one("arxiv", F.when(archive.isin("", "arxiv"), ax("eprint", False)["id"]), "eprint", F.when(archive.isin("", "arxiv"), ax("eprint", False)["version"])),
             one("pmid", F.when(archive.isin("pubmed", "pmid"), F.nullif(F.regexp_extract(f("eprint"), r"^\s*(\d{1,9})\s*$", 1), F.lit(""))), "eprint")]
    for n in ("journal", "booktitle", "url", "note", "howpublished", "publisher"):
        if n in ("url", "note", "howpublished"):
            found.append(one("doi", F.when(F.lower(f(n)).contains("doi"), idents.normalize_doi(F.regexp_replace(F.expr(f"try_url_decode(fields['{n}'])"), r"[?&].*$", ""))), n))
        found.append(one("arxiv", ax(n, True)["id"], n, ax(n, True)["version"]))
    rfc = F.coalesce(*[idents.rfc_number(f(n)) for n in ("number", "title", "howpublished", "note", "url")])
    found += [one("arxiv", ax("pages", True)["id"], "pages", ax("pages", True)["version"]), one("doi", F.when(f("doi").isNull() & rfc.isNotNull(), F.concat(F.lit("10.17487/rfc"), rfc.cast("string"))), "number", raw=rfc.cast("string")),
              one("pmid", F.nullif(F.regexp_extract(f("pmid"), r"^\s*(\d{1,9})\s*$", 1), F.lit("")), "pmid"), one("pmcid", idents.pmcid(F.coalesce(f("pmcid"), f("pmc"))), "pmcid"), one("isbn", idents.isbn(f("isbn")), "isbn"), one("issn", idents.issn(f("issn")), "issn")]
    rows = entries.select("key", F.posexplode(F.filter(F.array(*found), lambda x: x["value"].isNotNull() & (x["value"] != ""))).alias("ord", "i")).select("key", "ord", "i.*")
    # a DataCite arXiv DOI names the arXiv id too
    also = rows.where("scheme = 'doi' and value like '10.48550/arxiv.%'").select("key", (F.col("ord") + 100).alias("ord"), F.lit("arxiv").alias("scheme"), F.regexp_replace("value", r"^10\.48550/arxiv\.", "").alias("value"), "field", F.lit(None).cast("string").alias("version"), "raw")
    from biblion.operators.hygiene import first_of

    return first_of(rows.unionByName(also), ["key", "scheme", "value"], [F.col("ord")])


def record_ids(records: DataFrame) -> DataFrame:
    """source, source_id, scheme, value of every identifier of every record."""
    return records.select("source", "source_id", F.explode("identifiers").alias("scheme", "value")).withColumn("value", F.lower("value"))


def anchor(ids: DataFrame, records: DataFrame) -> DataFrame:
    """Entries to the records that hold one of their identifiers: role anchored, with the identifier's place."""
    got = ids.withColumn("value", F.lower("value")).join(record_ids(records), ["scheme", "value"])
    return got.groupBy("key", "source", "source_id").agg(F.min(F.struct("ord", "scheme", "value")).alias("by")).select("key", "source", "source_id", F.lit("anchored").alias("role"), F.col("by.scheme").alias("scheme"), F.col("by.value").alias("value"))


def search(entries: DataFrame, records: DataFrame, anchored: DataFrame, rows: int = SEARCH_ROWS) -> DataFrame:
    """Candidates by title for entries that no identifier anchors: equal or prefixed keys, and two shared words.

    Title keys meet, not entries and records: each once, however many have it. Of the records of a key and source only
    the first can be among the rows kept, since they are equally far from any entry."""
    todo = entries.join(anchored.select("key"), "key", "left_anti").where("title is not null and title <> ''").select("key", title_key(F.col("title")).alias("title_key")).where("title_key <> ''")
    recs = records.select("source", "source_id", title_key(F.col("title")).alias("rk")).where("rk <> ''")
    todo, recs = stash(todo, "todo"), stash(recs, "titles")
    ours, theirs = stash(todo.select(F.col("title_key").alias("a")).distinct(), "todo"), stash(recs.select(F.col("rk").alias("b")).distinct(), "titles")
    by_prefix = joins.prefix_join(ours.select(F.col("a").alias("title_key")), theirs.select(F.col("b").alias("title_key"))).select(F.col("title_key").alias("a"), F.col("record_key").alias("b"))
    a, b = F.col("a"), F.col("b")
    close = joins.length_bound(a, b, joins.CLOSE) & joins.edit_bound(a, b, joins.CLOSE)
    by_prefix = by_prefix.where(close | b.startswith(F.concat(a, F.lit(" "))))
    by_words = grams.close_texts(ours, theirs, [], joins.CLOSE, 2).where(joins.shared_words(a, b) > 1).where(close)
    pairs = by_prefix.union(by_words.select("a", "b")).distinct().select("a", F.col("b").alias("rk"), F.when(close, "candidate").otherwise("extending").alias("role"), F.levenshtein(a, b).alias("far"))
    first = joins.top_k(recs, ["rk", "source"], [F.col("source_id")], rows).drop("n")
    best = joins.top_k(pairs.join(first, "rk"), ["a", "source", "role"], [F.col("far"), F.col("source_id")], rows)
    return todo.join(best.select(F.col("a").alias("title_key"), "source", "source_id", "role"), "title_key").select("key", "source", "source_id", "role")


def answers(entries: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """key, source, outcome for every entry and every source of sources(source, available, reason): hit, negative or
    unavailable. A source that could not answer is unavailable even when others have the work; it is never a no."""
    asked = entries.select("key").join(F.broadcast(sources), F.lit(True))  # the sources are a handful
    hit = evidence.select("key", "source").distinct().withColumn("hit", F.lit(True))
    out = asked.join(hit, ["key", "source"], "left")
    return out.select("key", "source", F.when(F.col("hit"), "hit").when(~F.col("available"), "unavailable").otherwise("negative").alias("outcome"), F.when(F.col("hit").isNull() & ~F.col("available"), F.col("reason")).alias("reason"))


def run_findings(outcomes: DataFrame, substitutes: DataFrame | None = None) -> DataFrame:
    """RUN001: sources that did not answer, the entries affected and the reasons. RUN002: sources for which a substitute
    answered, with what substitutes(key, source, substitute) it was."""
    out = outcomes.where("outcome = 'unavailable'").groupBy("source").agg(F.count_distinct("key").alias("affected"), F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("reasons"))
    out = out.select(F.lit("RUN001").alias("rule"), F.lit("warning").alias("severity"), "source", "affected", "reasons")
    if substitutes is None:
        return out
    stood = substitutes.groupBy("source").agg(F.count_distinct("key").alias("affected"), F.array_join(F.sort_array(F.collect_set("substitute")), ", ").alias("reasons"))
    return out.unionByName(stood.select(F.lit("RUN002").alias("rule"), F.lit("info").alias("severity"), "source", "affected", "reasons"))


def bare_misc(entry_type: Column, venue: Column, links: Column) -> Column:
    """A misc entry without venue or link: often an article cited without its venue."""
    return (F.lower(entry_type) == "misc") & (F.coalesce(venue, F.lit("")) == "") & (F.size(links) == 0)


def untitled_article(title: Column, journal: Column, volume: Column, first_page: Column, year: Column, authors: Column) -> Column:
    """An article that is cited by its place alone: fewer than three words of title, but journal, volume, page, year and people."""
    words = F.size(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: w != ""))
    return (words < 3) & F.coalesce(journal, F.lit(False)) & volume.isNotNull() & first_page.isNotNull() & year.isNotNull() & (F.size(authors) > 0)


# Sources whose records never anchor a reference.
DENYLIST = ({"doi_prefix": "10.65215", "crossref_member": "54718"},)


def denylist(path: str) -> tuple[dict, ...]:
    """The sources of a denylist file (TOML, tables named source)."""
    import tomllib

    with open(path, "rb") as f:
        return tuple(tomllib.load(f).get("source", ()))


def suspicious(records: DataFrame, denied: tuple[dict, ...] = DENYLIST) -> DataFrame:
    """records(source_id, doi, member) that a denied source deposited, by the DOI's prefix or the member's number."""
    prefixes, members = ([x[k] for x in denied if x.get(k)] for k in ("doi_prefix", "crossref_member"))
    return records.where(F.coalesce(F.substring_index("doi", "/", 1).isin(prefixes), F.lit(False)) | F.coalesce(F.col("member").cast("string").isin(members), F.lit(False)))


def closest(candidates: DataFrame, k: int = 5) -> DataFrame:
    """candidates(key, source_id, score): the k closest of each key."""
    from biblion.operators.joins import top_k

    return top_k(candidates, ["key"], [F.col("score").desc(), F.col("source_id")], k).drop("n")
