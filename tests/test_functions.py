"""Tables of cases for the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblion.functions import idents, names, text, venues
from biblion.functions.similarity import changed_words, common_length, edit_distance, indel_ratio, key_words, swapped
from biblion.operators import scoring


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_title_key(spark):
    cases = {"Attention Is All You Need": "attention is all you need", "Über die Größe": "uber die grosse", "1 M(solar) stars": "1 m sun stars", "M_⋆ of stars": "m of stars", "16×16 words": "16x16 words", "networks. Part II. More": "networks ii more", "A Can0nical Form": "a canonical form", "at 2 lsimz": "at 2 z"}
    assert column(spark, list(cases), text.title_key) == list(cases.values())
    assert [" ".join(key_words(t)) for t in cases] == list(cases.values())


def test_word_count(spark):
    assert column(spark, ["a b c", "深度学习", ""], text.word_count) == [3, 4, 0]


def test_doi(spark):
    cases = {"https://doi.org/10.1000/ABC.": "10.1000/abc", "(see 10.1/x)": None, "10.1061/(ASCE)1084-0702(2008)13:1(6)": "10.1061/(asce)1084-0702(2008)13:1(6)", "10.48550/arXiv.2602.12139v1": "10.48550/arxiv.2602.12139", "(10.1234/x).": "10.1234/x", "none": None}
    assert column(spark, list(cases), idents.normalize_doi) == list(cases.values())


def test_checksums(spark):
    assert column(spark, ["978-3-16-148410-0", "0-306-40615-2", "0-306-40615-3"], idents.isbn) == ["9783161484100", "0306406152", None]
    assert column(spark, ["0378-5955", "2434-561X", "0378-5954"], idents.issn) == ["0378-5955", "2434-561X", None]


def test_arxiv(spark):
    got = column(spark, ["arXiv:1706.03762v2", "1706.03762", "arXiv hep-th/9901001"], idents.arxiv_id)
    assert [tuple(g) if g else None for g in got] == [("1706.03762", "v2"), None, ("hep-th/9901001", None)]


def test_links(spark):
    assert column(spark, ["https://www.Example.org:80/a", "ftp://x.y/z", "no"], idents.host) == ["example.org", "x.y", ""]
    assert column(spark, ["http://10.0.0.1/", "https://example.org/x", "http://localhost/", "https://u:p@example.org/"], idents.public_url) == [False, True, False, False]
    got = column(spark, ["see https://github.com/a/b.git and https://pypi.org/project/numpy/"], idents.software_links)[0]
    assert [(x.kind, x.name) for x in got] == [("github", "a/b"), ("pypi", "numpy")]


def test_venues(spark):
    assert column(spark, ["Proceedings of NAACL-HLT", "Annual Meeting of the Association for Computational Linguistics", "CoRR", "Nature"], venues.canonical) == ["naacl", "acl", "arxiv", None]


def test_american(spark):
    assert column(spark, ["optimisation", "behaviour", "modelling", "centre"], text.american) == ["optimization", "behavior", "modeling", "center"]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row[0] = row[:], 0
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    assert common_length(a, b) == row[-1] == common_length(b, a)
    assert 0 <= indel_ratio(a, b) <= 1
    # the bounds used before the ratio never lose a pair
    if a or b:
        assert indel_ratio(a, b) <= 1 - edit_distance(a, b) / (len(a) + len(b)) + 1e-9


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_key_is_stable(t):
    assert key_words(" ".join(key_words(t))) == key_words(" ".join(key_words(" ".join(key_words(t)))))


def test_changed_words():
    assert changed_words("Modelling of colour", "Modeling of color") == []
    assert changed_words("Part II of it", "Part 2 of it") == []
    assert changed_words("A Study of Cats", "A Study of Dogs") == [("cats", "dogs")]
    assert changed_words("An Improved Method", "Improved Method") == []
    assert swapped("varnavksi", "varnavski") and not swapped("abc", "abc")


@pytest.mark.parametrize(
    ("value", "people", "more"),
    [
        ("Knuth, Donald E. and Lamport, Leslie", [("Knuth", "Donald E."), ("Lamport", "Leslie")], False),
        ("Ludwig van Beethoven and others", [("van Beethoven", "Ludwig")], True),
        ("{The LIGO Collaboration}", [("", "")], False),
        ("King, Jr, Martin Luther", [("King", "Martin Luther")], False),
    ],
)
def test_author_lists(value, people, more):
    got, others = names.parse_authors(value)
    assert [(p.family, p.given) for p in got] == people and others == more


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [(("Müller", "K."), ("Mueller", "Karl"), True), (("Smith IV", "David"), ("Smith", "David"), True), (("Lee", "A."), ("Le", "B."), False), (("Varnavksi", "Oleg"), ("Varnavski", "Oleg"), True), (("Long", "Do"), ("Do", "Long"), True)],
)
def test_same_person(a, b, same):
    assert names.same_person(names.Person(*a), names.Person(*b)) is same


def test_given_names():
    p = lambda g: names.Person("Smith", g)
    assert not names.given_names_differ(p("William"), p("Bill")) and not names.given_names_differ(p("J."), p("John")) and not names.given_names_differ(p("Johann"), p("Ivan"))
    assert names.given_names_differ(p("Alice"), p("Robert"))


def test_author_check():
    people = lambda *x: [names.Person(*n.split(",")) for n in x]
    ours = people("Knuth,Donald", "Lamport,Leslie")
    assert names.check_authors(ours, False, ours)["status"] == "match"
    assert names.check_authors(ours, False, people("Turing,Alan"))["disjoint"]
    assert names.check_authors(ours[:1], False, ours)["note"] == "some authors omitted"
    assert names.check_authors(ours[:1], True, ours)["status"] == "match"
    assert names.check_authors(people("Knuth,Donald", "Nobody,Ann"), False, ours)["missing"] == ["Ann Nobody"]
    assert names.check_authors([], False, ours)["status"] == "unknown"


@pytest.mark.parametrize(
    ("ours", "theirs", "status"),
    [
        ("Attention Is All You Need", "Attention is all you need", "match"), ("Deep Learning: A Survey of Methods and Tools in Use", "Deep Learning: a survey of methods and tools in use", "match"),
        ("An Image is Worth 16x16 Words: Transformers for Image Recognition", "An Image is Worth 16x16 Words", "variant"), ("NTIRE 2026 Challenge Report", "NTIRE 2025 Challenge Report", "mismatch"), ("Cats", "Quantum Field Theory", "mismatch"),
        ("", "x", "unknown"), ("深度学习", "Deep learning", "unknown"), ("Statistical Analysis with Missing Data", "Statistical Analysis with Missing Data, Third Edition", "match"),
    ],
)
def test_title_check(ours, theirs, status):
    got = scoring.check_title(ours, theirs)
    assert got["status"] == status, got


def test_year_status(spark):
    rows = [("a", 2020, [2020], "", "", "article"), ("b", 2019, [2020], "", "", "preprint"), ("c", 2015, [2020], "", "", "article"), ("d", None, [2020], "", "", "article"), ("e", 2019, [2018, 2020], "", "", "article"), ("f", 2005, [2020], "", "", "book")]
    df = spark.createDataFrame(rows, "k string, y int, ys array<int>, v string, rv string, t string")
    got = df.select("k", scoring.year_status(F.col("y"), F.col("ys"), F.col("v"), F.col("rv"), F.col("t"), 2024).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == ["match", "variant", "mismatch", "unknown", "match", "variant"]


@pytest.mark.parametrize(
    "ours,theirs,status",
    [
        ("A study of parsing (Zur Theorie der Sprache)", "A study of parsing", "match"),
        ("Learning of useful things (FastThing2)", "Learning of useful things", "variant"),
        ("Learning of useful things, in Handbook of Many Methods", "Learning of useful things", "variant"),
        ("Collected works on algebra, vol. 3: groups", "Collected works on algebra", "variant"),
        ("Chapter 4: Learning of useful things", "Learning of useful things", "match"),
        ("Learning of useful things", "Learning of useful things (2nd edition)", "match"),
        ("Learning of useful things", "Learning of useful things, second edition", "match"),
        ("Learning of useful things", "Learning of useful things. Plates.", "match"),
        ("Learning of useful things", "Learning of useful things (with discussion)", "match"),
        ("Learning of useful things", "Learning of useful things [in French]", "match"),
        ("Networks that learn", "Networks that learn (NTL)", "match"),
        ("Learning of useful things", "Forgetting of useless things", "mismatch"),
    ],
)
def test_title_additions(ours, theirs, status):
    from biblion.operators.scoring import check_title

    assert check_title(ours, theirs)["status"] == status


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.unescape_identifier(F.lit(r"{10.1162/tacl\_a\_00276} "))) == "10.1162/tacl_a_00276"
    assert one(text.bibtex_value(F.lit(r"A & B \x {C} 50%"))) == r"A \& B  x (C) 50\%" and one(text.bibtex_value(F.lit("10.1/a_b"), True)) == "10.1/a_b"
    assert one(text.strip_language_mark(F.lit("On Systems (in Chinese)"))) == "On Systems" and one(text.strip_language_mark(F.lit("Living in Chinese Towns"))) == "Living in Chinese Towns"
    for name, title, there in (("BERT", "BERT: Pre-training", True), ("GELU", "Units (GELUs)", True), ("Adam", "Adam: A Method", True), ("Adam", "The Story of Adam and Eve", False), ("Adam", "A Method (Adam)", True), ("GPT-4", "GPT-4 Report", True), ("", "x", False)):
        assert one(text.name_in_title(F.lit(name), F.lit(title))) is there, name
    assert one(text.fill(F.lit("{a} and {b} and {c}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("{b}")))).startswith("1 and ")


def test_entities_and_denylist(spark, tmp_path):
    from biblion.operators import resolve
    from biblion.sources.bibtex import decode_entities

    assert decode_entities("A &amp; B &#233;&#xe9; &lt;i&gt; AT&T; &nonsense; &") == r"A \& B éé <i> AT&T; &nonsense; &"
    (tmp_path / "d.toml").write_text('[[source]]\ndoi_prefix = "10.9"\n')
    df = spark.createDataFrame([("a", "10.9/x", None), ("b", "10.99/x", 54718), ("c", None, None)], "source_id string, doi string, member long")
    assert [r.source_id for r in resolve.suspicious(df, resolve.denylist(str(tmp_path / "d.toml"))).collect()] == ["a"]
    assert [r.source_id for r in resolve.suspicious(df).collect()] == ["b"]
    near = spark.createDataFrame([("k", f"r{i}", i / 10) for i in range(8)], "key string, source_id string, score double")
    assert {r.source_id for r in resolve.closest(near).collect()} == {"r3", "r4", "r5", "r6", "r7"}
    rows = spark.createDataFrame([("x", "12", "3", 2000, ["a"], True), ("A whole title", "12", "3", 2000, ["a"], True), (None, None, "3", 2000, ["a"], True)], "title string, volume string, page string, year int, people array<string>, journal boolean")
    c = F.col
    assert [r.u for r in rows.select(resolve.untitled_article(c("title"), c("journal"), c("volume"), c("page"), c("year"), c("people")).alias("u")).collect()] == [True, False, False]
