"""Files as tables: whole files are read by Spark (any store it reaches) and parsed one a row by Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.sources import bibtex, latex, lists
from biblion.sources.textio import Lines, decode

FIELD = "struct<raw:string,value:string,text:string,line:int>"
ENTRIES = f"key string, entry_type string, fields map<string,{FIELD}>, file string, line int, raw string, suppressions array<struct<rules:array<string>,reason:string,line:int>>"
ISSUES = "kind string, file string, line int, key string, detail string"
CITES = "key string, command string, file string, line int, column int, nocite boolean"
RESOURCES = "file string, target string, kind string, line int"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, modified, content of every file below path whose name fits the glob."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "content")


def _readers() -> dict[str, Callable[[bytes, str], tuple[list[dict], list[dict]]]]:
    text = lambda f: lambda data, name: (f(decode(data)[0], name), [])
    return {
        "bib": lambda data, name: bibtex.parse(decode(data)[0], name), "bbl": text(lists.bbl), "ris": text(lists.ris), "json": text(lists.csl_json), "yaml": text(lists.yaml_list), "yml": text(lists.yaml_list),
        "txt": text(lambda t, n: lists.plaintext(lists.reference_section(t)[1], n)), "docx": lambda data, name: (lists.docx(data, name), []),
    }


def _parse(frames: Iterator[pd.DataFrame], part: int, columns: list[str]) -> Iterator[pd.DataFrame]:
    readers = _readers()
    for frame in frames:
        out: list[dict] = []
        for name, data in zip(frame["file"], frame["content"]):
            try:
                got = readers[name.rsplit(".", 1)[-1].lower()](data, name)
            except Exception as e:  # an unreadable file is a row of its own
                got = ([], [{"kind": "unreadable", "file": name, "line": 1, "key": None, "detail": f"{type(e).__name__}: {e}"[:200]}])
            out += got[part]
        yield pd.DataFrame(out, columns=columns)


def entries(found: DataFrame) -> DataFrame:
    """files -> entries; the reader goes by the name's suffix."""
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", ENTRIES)]
    return found.select("file", "content").mapInPandas(lambda it: _parse(it, 0, names), ENTRIES)


def issues(found: DataFrame) -> DataFrame:
    return found.select("file", "content").mapInPandas(lambda it: _parse(it, 1, ["kind", "file", "line", "key", "detail"]), ISSUES)


def cites(found: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """files of .tex, .md, .qmd, .Rmd, .typ -> citations with their places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["file"], frame["content"]):
                text, suffix = decode(data)[0], name.rsplit(".", 1)[-1].lower()
                got = latex.typst(text) if suffix == "typ" else latex.markdown(text) if suffix in ("md", "qmd", "rmd") else latex.citations(text, extra)
                lines = Lines(text)
                rows += [(c["key"], c["command"], name, *lines.place(c["offset"]), c["nocite"]) for c in got]
            yield pd.DataFrame(rows, columns=["key", "command", "file", "line", "column", "nocite"])

    return found.select("file", "content").mapInPandas(run, CITES)


def links(found: DataFrame) -> DataFrame:
    """file -> what it includes (kind include) and the bibliographies it declares (kind bib)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["file"], frame["content"]):
                text = decode(data)[0]
                lines = Lines(text)
                rows += [(name, t, kind, lines.place(at)[0]) for kind, got in (("include", latex.includes(text)), ("bib", latex.resources(text))) for t, at in got]
            yield pd.DataFrame(rows, columns=["file", "target", "kind", "line"])

    return found.select("file", "content").mapInPandas(run, RESOURCES)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def missing_targets(found: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """Links of a kind (file, target, line) whose target no file of found(file) is; remote targets are not looked for."""
    have = found.select(file_name(F.col("file")).alias("name")).distinct()
    wanted = links.where((F.col("kind") == kind) & ~F.lower("target").rlike("^https?://")).withColumn("name", file_name(F.col("target")))
    return wanted.join(have, "name", "left_anti").select("file", "target", "line")


def unreadable(found: DataFrame) -> DataFrame:
    """TEX004: source files that hold no text: bytes of value 0, which no text encoding here has."""
    return found.where(F.col("content").isNull() | (F.locate("00", F.hex("content")) > 0) & F.decode("content", "ISO-8859-1").contains("\0")).select("file")


def project_files(edges: DataFrame, main: DataFrame) -> DataFrame:
    """Files reached from each main file over include edges (file, target): file, root, depth. A cycle ends where a
    file comes again, so the rounds are no more than the files."""
    from itertools import count

    from biblion.tables import stash

    step = reached = stash(main.select(F.col("file"), F.col("file").alias("root"), F.lit(0).alias("depth")), "reached")
    for depth in count(1):
        got = step.select("file", "root").join(edges.select("file", "target"), "file").select(F.col("target").alias("file"), "root").distinct()
        step = stash(got.join(reached.select("file", "root"), ["file", "root"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not step.limit(1).count():
            return reached
        reached = reached.unionByName(step)


def cycles(edges: DataFrame) -> DataFrame:
    """TEX002: files that reach themselves."""
    start = edges.select(F.col("file").alias("start"), F.col("target").alias("file")).distinct()
    from biblion.tables import stash

    seen = step = stash(start, "walk")
    while step.limit(1).count():
        step = stash(step.join(edges.select("file", "target"), "file").select("start", F.col("target").alias("file")).distinct().join(seen, ["start", "file"], "left_anti"), "walk")
        seen = seen.unionByName(step)
    return seen.where("start = file").select("file").distinct()


def fresh_builds(builds: DataFrame, sources: DataFrame) -> DataFrame:
    """Build files (root, modified) no older than the newest source of their project (root, modified)."""
    newest = sources.groupBy("root").agg(F.max("modified").alias("newest"))
    return builds.join(newest, "root").where("modified >= newest").drop("newest")


def labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark lines without the canary ones."""
    schema = "bibtex_key string, bibtex_type string, label string, hallucination_type string, fields map<string,string>"
    return spark.read.schema(schema).json(path).where("bibtex_key is not null and label is not null")
