"""Operators on hand-made rows."""

import json
import random

from pyspark.sql import functions as F

from biblion.operators import cache, evaluate, fixes, grams, hygiene, joins, resolve, scoring, sinks, support, verdict
from biblion.sources import registries
from biblion.streaming import ttl

FINDING = "rule string, severity string, key string, field string, file string, line int, message string, project string"


def findings(spark):
    rows = [("REF013", "warning", "a", "year", "x.bib", 3, "year", "p"), ("CIT001", "error", "b", None, "x.tex", 1, "undefined", "p"), *[("REF016", "info", f"k{i}", "doi", "x.bib", i, "doi", "p") for i in range(8)]]
    return spark.createDataFrame(rows, FINDING)


def test_identifiers(spark):
    fields = [("a", {"doi": "https://doi.org/10.48550/arXiv.1706.03762", "url": "https://doi.org/10.1000/xyz?x=1"}), ("b", {"eprint": "1706.03762v5", "note": "no id"}), ("c", {"journal": "arXiv preprint arXiv:2001.00001", "issn": "0378-5955"}), ("d", {"title": "RFC 2119 key words"}), ("e", {"eprint": "123456", "eprinttype": "pubmed"})]
    got = {(r.key, r.scheme, r.value, r.version) for r in resolve.identifiers(spark.createDataFrame(fields, "key string, fields map<string,string>")).collect()}
    assert got == {
        ("a", "doi", "10.48550/arxiv.1706.03762", None), ("a", "arxiv", "1706.03762", None), ("a", "doi", "10.1000/xyz", None), ("b", "arxiv", "1706.03762", "v5"), ("c", "arxiv", "2001.00001", None), ("c", "issn", "0378-5955", None), ("d", "doi", "10.17487/rfc2119", None), ("e", "pmid", "123456", None)
    }


def test_missing_fields(spark):
    e = spark.createDataFrame([("a", "article", ["author", "title", "date"]), ("b", "misc", []), ("c", "online", ["Title", "url", "urldate"])], "key string, entry_type string, fields array<string>")
    assert [(r.key, r.missing) for r in hygiene.missing_fields(e).collect()] == [("a", ["journal|journaltitle"])]


def test_settings_and_pages(spark):
    f = hygiene.apply_settings(findings(spark), ["CIT001"], ["k[0-3]*".replace("[0-3]", "?")], {"REF013": "error"})
    assert [(r.rule, r.severity) for r in f.collect()] == [("REF013", "error")]
    page = [json.loads(r.value) for r in sinks.json_report(findings(spark), 0, 3).collect()]
    assert [p["rule"] for p in page] == ["CIT001", "REF013", "REF016"] and page[0]["next_offset"] == 3


def test_sarif_and_text(spark):
    f = hygiene.with_fingerprint(findings(spark))
    doc = json.loads(sinks.sarif(f, hygiene.rule_table(spark)).first().sarif)
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 10 and doc["runs"][0]["results"][0]["ruleId"] == "CIT001" and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 33
    lines = [r.line for r in sinks.text_report(findings(spark)).collect()]
    assert "REF016 x8: k0, k1, k2, k3, k4, k5 and 2 more" in lines and len(lines) == 3


def test_fixes(spark):
    text = "@article{a,\n  title = {Old {T}itle},\n  year = 1999\n}\n@misc{b, note = \"x, y\"}\n"
    f = spark.createDataFrame([("REF013", "a", "year", "2000"), ("REF016", "a", "doi", "10.1/x"), ("REF012", "b", "title", None)], "rule string, key string, field string, suggestion string")
    e = spark.createDataFrame([("a", "f.bib", {"title": "Old", "year": "1999"}), ("b", "f.bib", {"note": "x, y"})], "key string, file string, fields map<string,string>")
    assert [(r.field, r.action) for r in fixes.plan(f, e).collect()] == [("doi", "add")]
    every = fixes.plan(f, e, "all")
    out = fixes.apply(spark.createDataFrame([("f.bib", text)], "file string, text string"), every).first()
    assert out.text == "@article{a,\n  title = {Old {T}itle},\n  year = {2000},\n  doi = {10.1/x}\n}\n@misc{b, note = \"x, y\"}\n" and "+  doi = {10.1/x}" in out.diff


def test_crossref_records(spark):
    work = {"DOI": "10.1/X", "title": ["A &amp; <i>B</i>"], "subtitle": ["More"], "type": "journal-article", "author": [{"given": "Ann", "family": "Lee Jr."}, {"name": "The Group"}], "issued": {"date-parts": [[2020, 1]]}, "published-online": {"date-parts": [[2019]]}, "container-title": ["J"], "updated-by": [{"type": "retraction"}], "ISSN": ["0378-5955"]}
    (r,) = registries.normalise_json(spark.createDataFrame([(json.dumps(work),)], "payload string"), "crossref").collect()
    assert (r.source_id, r.title, r.years, r.year, r.status, r.alt_titles) == ("10.1/x", "A & B", [2019, 2020], 2019, ["retracted"], ["A & B: More"])
    assert [(p.family, p.given, p.literal) for p in r.authors] == [("Lee", "Ann", None), (None, None, "The Group")]
    (b,) = sinks.bibtex_entry(registries.normalise_json(spark.createDataFrame([(json.dumps(work),)], "payload string"), "crossref")).collect()
    assert b.bibtex.startswith("@article{lee2019") and "author = {Lee, Ann and {The Group}}" in b.bibtex


def test_dblp_rows(spark):
    rows = [("p1", "T.", "article", "V", "2001", "10.1234/a", 2, "B Two 0001"), ("p1", "T.", "article", "V", "2001", "10.1234/a", 1, "Jan van der One")]
    (r,) = registries.dblp(spark.createDataFrame(rows, "pub string, title string, type string, venue string, year string, doi string, ord int, name string")).collect()
    assert [(p.family, p.given) for p in r.authors] == [("van der One", "Jan"), ("Two", "B")] and r.title == "T" and r.identifiers == {"doi": "10.1234/a"}


def test_unclear_is_never_missing(spark):
    a = spark.createDataFrame([("d1", "Crossref"), ("d2", None), ("d3", None), ("d4", None)], "doi string, agency string")
    h = spark.createDataFrame([("d2", 404), ("d3", 500)], "doi string, code int")
    assert {(r.doi, r.exists) for r in registries.agency_answers(a, h).collect()} == {("d1", True), ("d2", False)}


def test_status_and_judge(spark):
    bound = spark.createDataFrame([("a", "d")], "key string, doi string")
    told = spark.createDataFrame([("crossref", "d", ["retracted"]), ("openalex", "d", ["retracted", "corrected"])], "source string, doi string, status array<string>")
    assert {(r.rule, r.severity, r.note) for r in verdict.status_findings(bound, told).collect()} == {("REF004", "error", "retracted: crossref, openalex"), ("REF005", "info", "corrected: openalex")}
    hits = spark.createDataFrame([(1, 0, "q0", 0.2), (1, 1, "q1", 0.7), (2, 0, "q", 0.1)], "claim_id int, idx int, quote string, score double")
    claims = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False)], "claim_id int, has_text boolean, name_in_title boolean")
    assert [(r.claim_id, r.verdict, r.reason, r.quote) for r in support.judge(hits, claims).orderBy("claim_id").collect()] == [(1, "supported", "passage", "q1"), (2, "supported", "name in title", None), (3, "not_confirmed", "no text", None)]


def test_outage_is_not_a_no(spark):
    """The twin of a not_found entry whose required source was down cannot be determined."""
    e = spark.createDataFrame([("a",), ("b",)], "key string").withColumns({
        "title": F.lit("a long enough title for a search"), "entry_type": F.lit("article"), "venue": F.lit("Some Journal"), "year": F.lit(2010), "authors": F.array(F.struct(F.lit("Lee").alias("family"), F.lit("Ann").alias("given"), F.lit("").alias("literal"))),
        "live_identifier": F.lit(False), "link_unindexed": F.lit(False), "venue_known": F.lit(False), "translated": F.lit(False), "corrupted": F.lit(False), "ambiguous": F.lit(False),
    })
    answers = spark.createDataFrame([("a", "crossref", "negative", None), ("b", "crossref", "unavailable", None)], "key string, source string, outcome string, reason string")
    got = {r.key: r.reasons for r in verdict.abstentions(e, answers, 2024).collect()}
    assert got == {"a": [], "b": ["SOURCES_UNAVAILABLE"]}


def test_search_finds_titles_of_common_words(spark):
    """A changed start of title, and words that are all in more than 50 records."""
    records = [("s", f"r{i}", f"number {i} on robust learning of graph networks with sparse labels and little noise at all") for i in range(120)]
    records.append(("s", "own", "Fast robust learning of graph networks with sparse labels and noise"))
    recs = spark.createDataFrame(records, "source string, source_id string, title string")
    todo = spark.createDataFrame([("a", "Fats robust learning of graph networks with sparse labels and noise"), ("b", "something else of it")], "key string, title string")
    got = resolve.search(todo, recs, spark.createDataFrame([], "key string")).collect()
    assert ("a", "own", "candidate") in {(r.key, r.source_id, r.role) for r in got} and {r.key for r in got} == {"a"}


def test_shared_word_pairs_are_all_there(spark):
    r = random.Random(5)
    title = lambda: " ".join(r.choice(["of", "the", "a", "on", "graph", "net", "learning", "sparse", "x1", "x2"]) for _ in range(r.randrange(1, 9)))
    left, right = ([(f"{k}{i}", title()) for i in range(70)] for k in "ab")
    got = joins.shared_word_pairs(spark.createDataFrame(left, "key string, title_key string"), spark.createDataFrame(right, "source_id string, title_key string"), 0.85).collect()
    fits = lambda a, b: min(len(a), len(b)) >= 0.85 / 1.15 * max(len(a), len(b))
    want = {(k, i) for k, a in left for i, b in right if len(set(a.split()) & set(b.split())) >= 2 and fits(a, b)}
    assert {(x.key, x.source_id) for x in got} == want and len(got) == len(want)


def test_cache(spark):
    rows = [("s", "k", "positive", "2024-01-01", True), ("s", "m", "negative", "2024-01-01", True), ("t", "k", "search", "2024-01-25", False)]
    a = spark.createDataFrame(rows, "source string, key string, kind string, stored_at string, exportable boolean").withColumns({"stored_at": F.to_timestamp("stored_at"), "payload": F.lit("{}")})
    now = F.to_timestamp(F.lit("2024-01-31"))
    assert {(r.source, r.key) for r in cache.fresh(a, now).collect()} == {("s", "k"), ("t", "k")} and cache.fresh(a, now, offline=True).count() == 3
    assert [(r.source, r.key) for r in cache.purge(a, now, sources=["t"]).collect()] == [("s", "k")] and cache.export(a).count() == 2


def test_stratified(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 280, "a").otherwise("b").alias("s"))
    got = evaluate.stratified(rows, 20, "s", "id", 7)
    assert {(r.s, r["count"]) for r in got.groupBy("s").count().collect()} == {("a", 10), ("b", 10)}
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in evaluate.stratified(rows.repartition(5), 20, "s", "id", 7).collect())


def test_stream(spark, tmp_path):
    schema = "source string, key string, kind string, stored_at timestamp, payload string"
    rows = [("s", "k", "positive", "2024-01-01 00:00:00", "old"), ("s", "k", "positive", "2024-01-02 00:00:00", "new"), ("s", "m", "negative", "2024-01-01 00:00:00", "x")]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("stored_at", F.to_timestamp("stored_at"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = ttl.latest_answers(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination()
    assert {(r.key, r.payload) for r in spark.table("latest").collect()} == {("k", "new"), ("m", "x")}
    assert ttl.unexpired(df).count() == 0 and ttl.answers_per_day(df).count() == 3


def test_one_work_by_title(spark):
    """A title of very many entries and records never meets as every two of them; years may lack, keys may come again."""
    e = [(f"e{i}", "hot", 1980 + i % 45) for i in range(20_000)] + [("none", "hot", None), ("both", "hot", 1990), ("both", "cold", 1990), ("cold", "cold", 2000), ("two", "split", 2000)]
    r = [("hot", 1980 + i % 40, "w", f"r{i:05}") for i in range(20_000)] + [("cold", 2003, "c", "c1"), ("cold", None, "c", "c0"), ("split", 2000, "a", "s1"), ("split", 2000, "b", "s2")]
    entries, records = spark.createDataFrame(e, "key string, title string, year int"), spark.createDataFrame(r, "title string, year int, work string, source_id string")
    got = joins.one_work_by_title(entries, records)
    rows = {x.key: (x.source_id, x.gap) for x in got.collect()}
    assert len(rows) == 20_002 and rows["e44"] == ("r00039", 5) and rows["e3"] == ("r00003", 0)
    assert rows["none"] == ("r00000", None) and rows["cold"] == ("c1", 3) and "both" not in rows and "two" not in rows


def test_close_texts_are_all_there(spark, monkeypatch):
    """The bound by letter pairs against every two texts, in one block and in several, with texts of any letters and
    lengths beyond a machine word."""
    from biblion.functions.similarity import edit_distance

    rng = random.Random(11)
    texts = {"".join(rng.choice("ab é𝔸n") for _ in range(rng.choice([1, 2, 3, 5, 8, 20]))) for _ in range(60)}
    for n in (12, 63, 64, 65, 130):
        base = "".join(rng.choice("abcde fgh") for _ in range(n))
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, n // 3)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["x"], [t[at], "y"]])
            texts.add("".join(t) or "z")
    rows = [(rng.randint(0, 1), t) for t in sorted(texts)]
    classes = spark.createDataFrame([(b, t, i) for i, (b, t) in enumerate(rows)], "block int, t string, class long")
    for least in (0.85, 0.6):
        got = joins.blocked_pairs(classes, ["block"], "t", least).collect()
        close = lambda a, b: min(len(a), len(b)) >= least / (2 - least) * max(len(a), len(b)) and edit_distance(a, b) <= int((1 - least) * (len(a) + len(b)))  # noqa: B023, E731
        want = {(i, j, a, b) for i, (x, a) in enumerate(rows) for j, (y, b) in enumerate(rows) if i < j and x == y and close(a, b)}
        assert len(want) > 100 and len(got) == len(want) and {(r.a, r.b, r.text_a, r.text_b) for r in got} == want


def test_few_pairs_are_measured(monkeypatch):
    """Texts of one vocabulary in any order: the places of letter pairs leave few of all pairs to be measured, and every
    close one is among those found."""
    from biblion.functions.similarity import edit_distance

    rng = random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(150)] + ["the", "of"] * 20
    a = sorted({" ".join(rng.choice(words) for _ in range(12)) for _ in range(150)})
    b = sorted({" ".join(rng.choice(words) for _ in range(12)) for _ in range(130)} | {t[: 9 * i % 50] + "xyz"[: i % 4] + t[9 * i % 50 + i % 7 :] for i, t in enumerate(a[:60])})
    measured = []

    def counted(f):
        return lambda self, i, j, *more: measured.append(len(i)) or f(self, i, j, *more)

    for name in ("edits", "near"):
        monkeypatch.setattr(grams.Letters, name, counted(getattr(grams.Letters, name, None)), raising=False)
    got = {(int(i), int(j)) for p, q in grams.within(a, b, 0.85, 2) for i, j in zip(p, q)}
    close = lambda x, y: min(len(x), len(y)) >= 0.85 / 1.15 * max(len(x), len(y)) and edit_distance(x, y) <= int(0.15 * (len(x) + len(y)))
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if len((set(x.split()) & set(y.split()))) > 1 and close(x, y)}
    assert len(want) >= 60 and want <= got and all(close(a[i], b[j]) for i, j in got)
    assert sum(measured) < 0.1 * len(a) * len(b), sum(measured) / len(a) / len(b)


def test_checks_are_made_once_for_every_two_that_meet(spark, monkeypatch):
    made = {}
    written = scoring.stash
    monkeypatch.setattr(scoring, "stash", lambda df, name: made.setdefault(name, []).append(written(df, name)) or made[name][-1])
    person = lambda name: [{"family": name, "given": "Ann", "literal": None}]
    none, no = F.lit(None).cast("string"), F.lit(False)
    entries = spark.createDataFrame([(f"e{i}", f"A study of {'useful' if i % 2 else 'other'} things", person("Lee" if i % 3 else "Roe")) for i in range(60)] + [("e0", None, None)], "key string, title string, authors array<struct<family:string,given:string,literal:string>>")
    entries = entries.select("*", no.alias("truncated"), F.lit(2001).alias("year"), F.lit("Journal of Things").alias("venue"), no.alias("venue_named"), no.alias("journal"), none.alias("volume"), none.alias("first_page"), F.array().cast("array<string>").alias("issns"), none.alias("doi"), F.lit("article").alias("entry_type"))
    records = spark.createDataFrame([("crossref", f"r{i}", "A study of useful things", person("Lee")) for i in range(20)], "source string, source_id string, title string, authors array<struct<family:string,given:string,literal:string>>")
    records = records.select("*", F.array().cast("array<string>").alias("alt_titles"), F.lit(True).alias("authors_complete"), F.lit(True).alias("authors_ordered"), F.array(F.lit(2001)).alias("years"), F.lit("Journal of Things").alias("venue"), none.alias("work_type"), none.alias("volume"), none.alias("doi"), no.alias("reissue"), F.array().cast("array<string>").alias("issns"))
    pairs = entries.select("key").distinct().crossJoin(records.select("source", "source_id")).withColumn("role", F.lit("candidate"))
    rows = scoring.score_pairs(pairs, entries, records, 2024).collect()
    # a key of two entries meets each record with both, the one without a title too
    assert len(rows) == 61 * 20 and sum(r.t.status == "unknown" for r in rows) == 20
    assert all((r.t.status, r.a.status) == ("match" if "useful" in r.title else "mismatch", "match" if r.authors[0].family == "Lee" else "mismatch") for r in rows if r.title)
    assert [t.count() for t in made["checks"]] == [3, 3]


def test_equal_texts_are_one_class(spark):
    """Pairs of classes do not grow with the copies of a text."""
    rows = [(i, 1, "large ring") for i in range(5000)] + [(9000 + i, 1, "large rings") for i in range(5000)] + [(20_000, 2, "large ring"), (20_001, None, "large ring")]
    classes = joins.text_classes(spark.createDataFrame(rows, "id long, block int, t string"), "id", ["block"], "t")
    assert {(r.block, r.t, r["class"]) for r in classes.collect()} == {(1, "large ring", 0), (1, "large rings", 9000), (2, "large ring", 20_000)}
    assert [(r.a, r.b) for r in joins.blocked_pairs(classes, ["block"], "t", 0.85).collect()] == [(0, 9000)]


def test_search_by_title_of_many(spark):
    """Entries and records of one title: the first records of each source, once for each entry; near titles too."""
    entry = [(f"e{i}", "A study of useful things and others") for i in range(3000)] + [("near", "A study of useful thing and others"), ("far", "Nothing of the kind")]
    record = [("s", f"r{i:05}", "A study of useful things and others") for i in range(3000)] + [("t", "q1", "A study of useful things and others: more")]
    got = resolve.search(spark.createDataFrame(entry, "key string, title string"), spark.createDataFrame(record, "source string, source_id string, title string"), spark.createDataFrame([], "key string"), 3)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.key, set()).add((r.source, r.source_id, r.role))
    first = {("s", f"r0000{i}", "candidate") for i in range(3)} | {("t", "q1", "candidate")}
    assert len(rows) == 3001 and all(v == first for v in rows.values())
