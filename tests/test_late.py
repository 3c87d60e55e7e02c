"""Lookups of the entries that are left."""

from pyspark.sql import functions as F

from biblion.operators import late


def test_software(spark):
    e = spark.createDataFrame([("a", "spaCy: natural language processing", [("github", "x/other"), ("github", "explosion/spaCy")]), ("b", "Gone tool", [("github", "me/gone")]), ("c", "Tool", [("pypi", "unknown")])], "key string, title string, links array<struct<kind:string,name:string>>")
    r = spark.createDataFrame([("github", "explosion/spaCy", True), ("github", "x/other", True), ("github", "me/gone", False)], "kind string, name string, exists boolean")
    assert {(x.key, x.name, x.status) for x in late.software(e, r).collect()} == {("a", "explosion/spaCy", "confirmed"), ("b", "me/gone", "missing"), ("c", "unknown", "unknown")}


def test_books(spark):
    e = spark.createDataFrame([("a", "The Art of Things", "Lee", 2000), ("b", "The Art of Things", "Roe", 2000), ("c", "The Art of Things", "Lee", 1980)], "key string, title string, family string, year int")
    f = spark.createDataFrame([("r", "the art of things", "LEE", 2001)], "source_id string, title string, family string, year int")
    assert [x.key for x in late.books(e, f).collect()] == ["a"]


def test_issue_years(spark):
    p = spark.createDataFrame([("a", "j", "1", "2", 2001, [2000]), ("b", "j", "1", "2", 2005, [2000])], "key string, journal string, volume string, issue string, year int, years array<int>")
    i = spark.createDataFrame([("j", "1", "2", 2001)], "journal string, volume string, issue string, year int")
    assert [(x.key, x.years) for x in late.issue_years(p, i).collect()] == [("a", [2000, 2001])]


def test_unclear_pages_are_not_gone(spark):
    links = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3")], "key string, url string")
    status = spark.createDataFrame([("u1", 404), ("u2", 503), ("u3", 410)], "url string, code int")
    assert [x.key for x in late.gone_pages(links, status, links.where(F.col("url") == "u3").select("url")).collect()] == ["a"]
