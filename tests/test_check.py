"""A project end to end."""

from pyspark.sql import functions as F

from biblion.operators.lookup import lookup
from biblion.plans.check import check
from biblion.sources import passages, registries

BIB = """@article{good, author = {Lee, Ann and Kim, Bo}, title = {A Careful Study of Many Interesting Things}, journal = {Journal of Things}, year = {2010}, doi = {10.1234/good}}
@article{wrong, author = {Lee, Ann and Kim, Bo}, title = {A Careful Study of Many Interesting Things}, journal = {Journal of Things}, year = {2010}, doi = {10.1234/other}}
% refcheck: ignore CIT003 -- kept
@article{lost, author = {Roe, Ann and Poe, Bo}, title = {Nothing Whatsoever Is Known About This One}, journal = {Journal of Things}, year = {2011}}
@article{year, author = {May, Sue}, title = {On the Years of Publication of Various Works}, journal = {Journal of Things}, year = {1999}, doi = {10.1234/year}}
@misc{pre, author = {Fox, Al}, title = {Preprints and What Becomes of Them Later}, year = {2015}, eprint = {1501.00001}, archiveprefix = {arXiv}}
"""
WORKS = [
    ("10.1234/good", "A careful study of many interesting things", [("Ann", "Lee"), ("Bo", "Kim")], 2010), ("10.1234/other", "Entirely different matters in another field", [("Zoe", "Xu")], 1990), ("10.1234/year", "On the Years of Publication of Various Works", [("Sue", "May")], 2005), ("10.1234/pub", "Preprints and What Becomes of Them Later", [("Al", "Fox")], 2016)
]


def records(spark):
    rows = [(d, [t], [(g, f, None) for g, f in a], ([[y]],)) for d, t, a, y in WORKS]
    df = spark.createDataFrame(rows, "DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>, issued struct<`date-parts`:array<array<int>>>").withColumns({"type": F.lit("journal-article"), "container-title": F.array(F.lit("Journal of Things"))})
    df = df.withColumn("updated-by", F.when(F.col("DOI") == "10.1234/good", F.array(F.struct(F.lit("retraction").alias("type")))))
    preprint = spark.createDataFrame([("1501.00001", 1, "Preprints and what becomes of them later", ["Al Fox"], "2015-01-01", "2015-01-02", None, None, None)], "id string, version int, title string, names array<string>, published string, updated string, comment string, journal_ref string, doi string")
    return registries.normalise_json(df.select(F.to_json(F.struct("*")).alias("payload")), "crossref").unionByName(registries.arxiv(preprint))


def test_project(spark, tmp_path):
    (tmp_path / "refs.bib").write_text(BIB)
    (tmp_path / "main.tex").write_text("\\cite{good,wrong,year} and \\cite{gone} \\bibliography{refs}")
    report = check(spark, f"file://{tmp_path}", records(spark))
    assert {r.key: r.verdict for r in report.assessments.collect()} == {"good": "verified", "wrong": "identifier_conflict", "lost": "not_found", "year": "metadata_mismatch", "pre": "verified"}
    got = {(r.rule, r.key) for r in report.findings.collect()}
    assert {("CIT001", "gone"), ("REF001", "wrong"), ("REF003", "lost"), ("REF013", "year"), ("CIT004", "wrong"), ("REF004", "good"), ("REF015", "pre")} <= got and ("CIT003", "lost") not in got
    down = spark.createDataFrame([("crossref", False, "SOURCES_UNAVAILABLE")], "source string, available boolean, reason string")
    again = {r.key: (r.verdict, r.reasons) for r in check(spark, f"file://{tmp_path}", records(spark), down).assessments.collect()}
    assert again["lost"] == ("cannot_determine", ["SOURCES_UNAVAILABLE"]) and again["good"][0] == "verified"


def test_lookup(spark):
    q = spark.createDataFrame([("https://doi.org/10.1234/GOOD",), ("On the years of publication of various works",), ("nothing like this",)], "query string")
    got = {r.query: (r.status, r.source_id) for r in lookup(q, records(spark)).collect()}
    assert got == {"https://doi.org/10.1234/GOOD": ("found", "10.1234/good"), "On the years of publication of various works": ("found", "10.1234/year"), "nothing like this": ("not_found", None)}
    assert lookup(q.where("query like 'nothing%'"), records(spark), available=False).first().status == "unavailable"


def test_passages():
    assert [t[a:b] for t in ["As Smith et al. show, e.g. in Fig. 2, it works. So it does! (Yes.)"] for a, b in passages.sentences(t)] == ["As Smith et al. show, e.g. in Fig. 2, it works.", "So it does!", "(Yes.)"]
    assert [len(p.split()) for p in passages.passages("One two three. " * 10, 9)] == [9, 9, 9, 3]
    (c,) = passages.claims("\\begin{document}\nFirst one. BERT~\\cite{devlin} works well.\n")
    assert (c["key"], c["name"], c["previous"], c["sentence"]) == ("devlin", "BERT", "First one.", "BERT works well.")
    assert passages.unmojibake("GÃ¶del") == "Gödel" and passages.unmojibake("Gödel") == "Gödel"
    assert passages.jats("<article><abstract><p>one two three four</p></abstract><body><p>x</p><p>five <i>six</i> seven eight</p></body></article>") == ["one two three four", "five six seven eight"]


def test_project_with_all_evidence(spark, tmp_path):
    from biblion.plans.check import Evidence

    (tmp_path / "refs.bib").write_text(BIB + """@article{dead, author = {Lee, Ann}, title = {A Reference Whose Identifier Does Not Exist}, journal = {Journal of Things}, year = {2012}, doi = {10.1234/nowhere}}
@article{live, author = {Lee, Ann}, title = {A Reference Whose Identifier Is Only Registered}, journal = {Journal of Things}, year = {2012}, doi = {10.9999/live}}
@article{chinese, author = {Wang, Li}, title = {A study of something [in Chinese]}, journal = {Acta Nihil}, year = {2012}}
@misc{code, author = {Lee, Ann}, title = {Gadget software}, year = {2012}, howpublished = {https://github.com/lee/gadget}}
@misc{page, author = {Lee, Ann}, title = {A page about many interesting things}, year = {2012}, url = {https://things.example/gone}}
@inproceedings{odd, author = {Fox, Al}, title = {Preprints and What Becomes of Them Later}, booktitle = {Symposium on Nothing Known}, year = {2015}, eprint = {1501.00001}, archiveprefix = {arXiv}}
""")
    (tmp_path / "main.tex").write_text("\\cite{good,wrong,year,dead,live} \\include{absent} \\bibliography{refs,none}")
    (tmp_path / "bad.tex").write_bytes(b"\0\1\2 binary")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    evidence = Evidence(
        agencies=table([("10.1234/nowhere", "crossref", False), ("10.9999/live", "crossref", True), ("10.1234/year", "crossref", True)], "doi string, agency string, exists boolean"),
        catalogues=(table([("Journal of Things",)], "name string"),), software=table([("github", "lee/gadget", False)], "kind string, name string, exists boolean"),
        pages=table([("https://things.example/gone", 404)], "url string, code int"), substitutes=table([("pre", "arxiv", "datacite")], "key string, source string, substitute string"),
    )
    sources = table([("crossref", True, None), ("arxiv", False, "SOURCES_UNAVAILABLE")], "source string, available boolean, reason string")
    report = check(spark, f"file://{tmp_path}", records(spark), sources, evidence=evidence)
    got = {(r.rule, r.key) for r in report.findings.collect()}
    want = {("REF002", "dead"), ("REF019", "code"), ("REF020", "odd"), ("REF021", "page"), ("RUN001", None), ("RUN002", None), ("TEX001", None), ("TEX004", None), ("CIT005", None)}
    assert want <= got and ("REF002", "live") not in got and ("REF020", "good") not in got, want - got
    whole = table([("crossref", True, None)], "source string, available boolean, reason string")
    rows = {r.key: (r.verdict, r.reasons) for r in check(spark, f"file://{tmp_path}", records(spark), whole, evidence=evidence).assessments.collect()}
    assert "IDENTIFIER_EXISTS_NO_METADATA" in rows["live"][1] and "TRANSLATED_CHINESE_WORK" in rows["chinese"][1]
