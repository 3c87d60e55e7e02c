"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from biblion.llm import bpe, ctw, decontaminate, exact_dedup, license_scan, near_dedup, pii, quality, token_files, url_filter
from biblion.llm.shared import fresh_path

LONG = "some words that go on and on " * 9000
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (None, "one two three four five six"), (None, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "x" * 100_000), (7, "ÉÈ ß 日本語 \u0000 😀"), (8, "ab"), (8, "a b"), (9, "mail a.b@c.org")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = ("row", "digest", "text_key", "kept", "kind", "n", "id", "run", "norm", "label", "node", "band", "key", "window", "fp", "ids", "n_tokens", "chars", "lang", "said", "start", "grade", "fold", "host")
    return df.withColumns({c: F.lit("clash") for c in clash})


def benchmark(spark):
    return spark.createDataFrame([(1, "words that go on and on some words that go on"), (2, None), (None, "two three"), (3, "two three"), (4, "...")], "item_id long, text string")


def operators(spark):
    spec = bpe.vocabulary()

    def files(d):
        import public_tokenizers

        folder = fresh_path(spark, "tokens")
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            return token_files.read_tokens(token_files.write_tokens(d, f.read(), folder), folder)

    labels = lambda d: d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    known = license_scan.known_digests(spark, license_scan.NOTICES)
    return {
        "exact": exact_dedup.exact_groups, "pii": pii.replace_entities, "files": files, "quality": lambda d: quality.grade(d, quality.train(d, labels(d))), "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark(spark)),
        "license": lambda d: license_scan.scan(d, known, known), "ctw": ctw.score, "bpe": lambda d: bpe.encode(d, spec), "near": near_dedup.near_classes,
    }


NAMES = ("exact", "pii", "files", "quality", "decontaminate", "license", "ctw", "bpe", "near")


@pytest.mark.parametrize("name", NAMES)
def test_one_row_each(spark, docs, name):
    got = operators(spark)[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    assert operators(spark)[name](docs.limit(0)).count() == 0


def test_exact_groups_of_edges(spark, docs):
    got = {(r.doc_id, r.group_size, r.keep_id) for r in exact_dedup.exact_groups(docs).collect()}
    assert {(1, 3, 1), (None, 3, 1), (2, 4, 4), (3, 4, 4), (4, 4, 4), (None, 4, 4), (8, 2, 8)} <= got


def test_longest_text_stays(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "a\tb")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_groups(df, fan_in=2).collect()} == {2}


def test_many_runs_merge(spark):
    df = spark.range(0, 1000, 1, 37).select(F.col("id").alias("doc_id"), (F.col("id") % 10).cast("string").alias("text"))
    got = exact_dedup.exact_groups(df, fan_in=2).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(i, 100) for i in range(10)} and sum(r.kept for r in got) == 10


def test_decontaminate_edges(spark, docs):
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, benchmark(spark)).collect() if r.doc_id}
    assert got[1].items == ["3"] and got[1].n_hit == 2 and got[5].items == ["1"] and got[2].n_words == 0 and not got[3].contaminated


def test_stages_keep_columns_and_one_of_each(spark, docs):
    for stage in (exact_dedup.keep_one, near_dedup.keep_one):
        out = stage(docs)
        assert out.schema == docs.schema
    exact = exact_dedup.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in exact) == sorted(map(str, [1, 4, 5, 6, 7, 8, 9]))
    clean = decontaminate.drop_contaminated(docs, benchmark(spark))
    assert clean.schema == docs.schema and {r.doc_id for r in clean.collect()} == {2, None, 3, 4, 6, 7, 8, 9}
    model = quality.train(docs.limit(0), docs.limit(0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert quality.select_clean(docs, model).count() == len(ROWS)


def test_near_stage_keeps_a_row_of_repeated_ones(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(1, near, "x"), (1, near, "x"), (1, near, "x"), (2, near, "y"), (2, near, "y"), (3, "another text of some words here", "z"), (3, "another text of some words here", "z"),
            (None, "a text without an id", "w"), (None, "a text without an id", "w"), (4, "alone in this table", "v"), (5, "...", "u"), (5, "...", "u")]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.source) for r in got) == sorted({(i or 0, t, s) for i, t, s in rows if i != 2} | {(5, "...", "u")}) + [(5, "...", "u")]


def test_near_keeps_one_of_repeated_rows(spark, docs):
    assert sum(r.kept for r in near_dedup.near_classes(docs).collect() if r.doc_id in (1,)) == 1


def test_url_filter_edges(spark):
    listed = spark.createDataFrame([("block", "com", "/a"), ("allow", "x.com", "/a"), ("block", "", "/"), ("block", "COM", None)], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, None), (1, "no url"), (2, "http://X.com/ab"), (None, "ftp://y.com"), (3, "a://b://com/a"), (3, "http://.com/a?b#c"), (4, "http://xcom/a")], "page_id long, url string").withColumn("host", F.lit(1))
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter.filter_urls(pages, listed).collect())
    assert got == sorted([("1", "", "", "None", "allow"), ("1", "", "", "None", "allow"), ("2", "x.com", "/ab", "x.com/a", "allow"), ("None", "y.com", "", "com", "block"), ("3", "b:", "//com/a", "None", "allow"), ("3", ".com", "/a", "com/a", "block"), ("4", "xcom", "/a", "None", "allow")])
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0 and url_filter.filter_urls(pages, listed.limit(0)).count() == 7


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, small)
        assert after.schema == docs.schema and after.exceptAll(kept).count() == 0, name
        kept = after.cache()
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()} and len(rows) == kept.count()
    assert all(len(r.ids) == r.n_tokens for r in rows)
