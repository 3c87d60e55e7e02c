"""Readers on small files, and the scans on a folder of them."""

import io
import json
import zipfile

import pytest

from biblion.sources import bibtex, latex, lists, scan
from biblion.sources.textio import Lines, decode

BIB = """@string{jml = "Journal of Learning"}
% refcheck: ignore REF013 -- known
@article{knuth84,
  author = {Knuth, Donald E. and G{\\"o}del, Kurt},
  title = {Literate {Programming} \\& more},
  journal = jml # { and Tests},
  year = 1984,
  year = 1985,
}
@book{knuth84, title = {Again}}
@misc{open, title = {never closed
"""


def test_bibtex():
    entries, issues = bibtex.parse(BIB, "a.bib")
    (e,) = entries
    assert e["key"] == "knuth84" and e["fields"]["journal"]["value"] == "Journal of Learning and Tests" and e["fields"]["year"]["value"] == "1984"
    assert e["fields"]["author"]["text"] == "Knuth, Donald E. and Gödel, Kurt" and e["fields"]["title"]["text"] == "Literate Programming & more"
    assert e["suppressions"] == [{"rules": ["REF013"], "reason": "known", "line": 2}]
    assert sorted(i["kind"] for i in issues) == ["duplicate_field", "duplicate_key", "syntax"]


def test_latex_values():
    assert bibtex.latex_to_text(r"\'Etienne \c{C}elik \o{} \ss{} \emph{it} $\alpha$--$\beta$ \url{http://x.y/a_b}") == "Étienne Çelik ø ß it α–β http://x.y/a_b"


def test_decode():
    assert decode("é".encode())[:2] == ("é", "utf-8") and decode("\ufeffa".encode())[2] and decode("中文".encode("gb18030"))[:2] == ("中文", "gb18030")
    assert Lines("ab\ncd").place(4) == (2, 2)


def test_ris_csl_yaml():
    (r,) = lists.ris("TY  - JOUR\nAU  - Knuth, Donald\nTI  - A title\n  that goes on\nPY  - 1984/01\nSP  - 1\nEP  - 9\nDO  - 10.1/x\nER  - \n")
    assert r["fields"]["title"]["value"] == "A title that goes on" and r["fields"]["pages"]["value"] == "1--9" and r["fields"]["year"]["value"] == "1984"
    item = {"id": "k", "type": "paper-conference", "title": "T", "author": [{"family": "A", "given": "B"}], "issued": {"date-parts": [[2020]]}, "container-title": "Proc"}
    a, b = lists.csl_json(json.dumps([item, item]))
    assert (a["key"], b["key"]) == ("k", "k-2") and a["fields"]["booktitle"]["value"] == "Proc" and a["entry_type"] == "inproceedings"
    (y,) = lists.yaml_list("smith:\n  type: article\n  title: X\n  author: Smith, Jo\n  date: 2001-02\n  serial-number: {doi: 10.1/y}\n  parent: {type: periodical, title: J}\n")
    assert y["key"] == "smith" and y["fields"]["author"]["value"] == "Smith, Jo" and y["fields"]["doi"]["value"] == "10.1/y" and y["fields"]["journal"]["value"] == "J"


def test_bbl():
    (e,) = lists.bbl("\\begin{thebibliography}{1}\n\\bibitem[Knuth(1984)]{knuth}\nD.~E. Knuth.\n\\newblock Literate programming.\n\\newblock \\emph{The Computer Journal}, 27\\penalty0 (2):97--111, 1984.\n\\end{thebibliography}")
    assert e["key"] == "knuth" and e["fields"]["title"]["value"] == "Literate programming" and e["fields"]["year"]["value"] == "1984"


def test_plain_references():
    apa = "Knuth, D. E., & Lamport, L. (1984). Literate programming in practice. The Computer Journal, 27(2), 97-111. https://doi.org/10.1093/comjnl/27.2.97"
    kind, f = lists.parse_reference(apa)
    assert kind == "article" and f["title"] == "Literate programming in practice" and f["year"] == "1984" and f["doi"] == "10.1093/comjnl/27.2.97" and f["author"] == "Knuth, D. E. and Lamport, L."
    kind, f = lists.parse_reference('D. E. Knuth and L. Lamport, "Literate programming," The Computer Journal, vol. 27, no. 2, pp. 97-111, 1984.')
    assert f["title"] == "Literate programming" and f["year"] == "1984" and f["author"] == "D. E. Knuth and L. Lamport"
    got = lists.split_references("[1] First one. 2000.\n[2] Second\ngoes on. 2001.\n")
    assert [t for _, t in got] == ["First one. 2000.", "Second goes on. 2001."]


def test_docx():
    data = io.BytesIO()
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + p("Text") + p("References") + p("[1] Knuth, D. E. (1984). Literate programming now. The Computer Journal, 27(2), 97-111.") + "</w:body></w:document>")
    (e,) = lists.docx(data.getvalue())
    assert e["fields"]["title"]["value"] == "Literate programming now"


def test_latex():
    text = "\\cite{a,b} % \\cite{no}\n\\verb|\\cite{no}| \\citep[see][p. 2]{c}\n\\iffalse \\cite{no} \\fi \\nocite{*}\\cites{d}[x]{e}\n\\begin{verbatim}\\cite{no}\\end{verbatim}\\input{part}\\bibliography{refs,more}"
    assert [c["key"] for c in latex.citations(text)] == ["a", "b", "c", "*", "d", "e"]
    assert [t for t, _ in latex.includes(text)] == ["part.tex"] and [t for t, _ in latex.resources(text)] == ["refs.bib", "more.bib"]
    assert len(latex.mask(text)) == len(text)
    assert [c["key"] for c in latex.markdown("See [@a; -@b] and `@no`, me@mail.org\n```\n@no\n```\n@c.")] == ["a", "b", "c"]
    assert [c["key"] for c in latex.typst("@a and #cite(<b>) @fig\n= Fig <fig>\n")] == ["a", "b"]
    assert latex.aux("\\citation{a,b}\\citation{*}\\bibdata{refs}")["keys"] == ["a", "b"]


def test_scans(spark, tmp_path):
    (tmp_path / "refs.bib").write_text(BIB)
    (tmp_path / "main.tex").write_text("\\cite{knuth84,gone}\n\\input{a}\\bibliography{refs}")
    (tmp_path / "a.tex").write_text("\\cite{knuth84}\\input{main}")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    entries = scan.entries(scan.files(spark, f"file://{tmp_path}", "*.bib"))
    assert [r.key for r in entries.collect()] == ["knuth84"]
    assert scan.issues(scan.files(spark, f"file://{tmp_path}", "*.docx")).first().kind == "unreadable"
    cites = scan.cites(scan.files(spark, f"file://{tmp_path}", "*.tex"))
    assert sorted(r.key for r in cites.collect()) == ["gone", "knuth84", "knuth84"]
    from biblion.operators.hygiene import undefined_citations

    assert [r.key for r in undefined_citations(cites, entries).collect()] == ["gone"]
    edges = spark.createDataFrame([("m", "a"), ("a", "b"), ("b", "a")], "file string, target string")
    assert {r.file for r in scan.cycles(edges).collect()} == {"a", "b"}
    assert {(r.file, r.depth) for r in scan.project_files(edges, spark.createDataFrame([("m",)], "file string")).collect()} == {("m", 0), ("a", 1), ("b", 2)}


STYLED = [
    ("Knuth, D. E. (1984a). Is programming literate? The Computer Journal, 27(2), 97-111.", "article", "Knuth, D. E.", "Is programming literate", "1984", {"journal": "The Computer Journal", "volume": "27", "number": "2", "pages": "97-111"}),
    ("Abbott, B. P., Smith, J., 2016, ApJ, 818, L22", "article", "Abbott, B. P. and Smith, J.", None, "2016", {}),
    ("Knuth, D. E., Lamport, L.: Literate programming in practice. In: Proceedings of the Great Conference, pp. 97–111. Springer (1984)", "inproceedings", "Knuth, D. E. and Lamport, L.", "Literate programming in practice", "1984", {"booktitle": "Proceedings of the Great Conference"}),
    ("Knuth DE, Lamport L. Literate programming in practice. Comput J. 1984;27(2):97-111.", "article", "Knuth, D. E. and Lamport, L.", "Literate programming in practice", "1984", {"volume": "27", "number": "2", "pages": "97-111"}),
    ("Donald Knuth and Leslie Lamport. 1984. Literate programming in practice. The Computer Journal 27, 2 (1984), 97–111.", "article", "Donald Knuth and Leslie Lamport", "Literate programming in practice", "1984", {"journal": "The Computer Journal"}),
    ("Donald Knuth and Leslie Lamport. Literate programming in practice. The Computer Journal, 27(2):97–111, 1984.", "article", "Donald Knuth and Leslie Lamport", "Literate programming in practice", "1984", {"journal": "The Computer Journal", "volume": "27", "number": "2", "pages": "97–111"}),
    ("D. E. Knuth, L. Lamport, Literate programming in practice, The Computer Journal 27 (2) (1984) 97–111.", "article", "D. E. Knuth and L. Lamport", "Literate programming in practice", "1984", {"journal": "The Computer Journal", "volume": "27", "number": "2"}),
    ("Vaswani, A. et al. Attention is all you need. arXiv:1706.03762 (2017).", "misc", "Vaswani, A. and others", "Attention is all you need", "2017", {"eprint": "1706.03762"}),
]


@pytest.mark.parametrize("text,kind,author,title,year,more", STYLED)
def test_styles(text, kind, author, title, year, more):
    got_kind, f = lists.parse_reference(text)
    assert (got_kind, f.get("author"), f.get("title"), f.get("year")) == (kind, author, title, year)
    assert {k: f.get(k) for k in more} == more


def test_bibitems_with_brackets_in_their_labels():
    text = "\\bibitem[{Smith [2]}]{a} A. Smith.\n\\newblock One title.\n\\newblock Some Journal, 3(1):1--2, 2001.\n\\bibitem{b} \\bibinfo{author}{B. Jones}, \\bibinfo{title}{Two {T}itles}, \\bibinfo{year}{2002}."
    one, two = lists.bbl(text)
    assert (one["key"], one["fields"]["title"]["value"], one["fields"]["year"]["value"], one["fields"]["volume"]["value"]) == ("a", "One title", "2001", "3")
    assert (two["key"], two["fields"]["title"]["value"], two["fields"]["author"]["value"], two["fields"]["year"]["value"]) == ("b", "Two Titles", "B. Jones", "2002")


def test_appendix_ends_the_references():
    line, text = lists.reference_section("Text\nReferences\n[1] One. 2000.\nAppend it later. 2001.\nA. Supplementary material\nmore")
    assert line == 3 and text == "[1] One. 2000.\nAppend it later. 2001."


def test_titles_of_few_letters_in_plain_text():
    for title in ("On a", "On É", "On 7", "On O", "On to", "On a bc", "On "):
        (e,) = lists.plaintext(f"Author, A. B., & Other, C. (1999). {title}. Journal of Things, 1(2), 3-4.\n")
        assert (e["fields"]["title"]["value"], e["fields"]["year"]["value"], e["fields"]["journal"]["value"]) == (title, "1999", "Journal of Things")
