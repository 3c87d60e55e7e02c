"""Reference lists in other formats: RIS, CSL (JSON and YAML), Hayagriva, .bbl, Word documents and plain text.

Each reader gives the entries of a file in the shape of the BibTeX reader.
"""

from __future__ import annotations

import base64
import io
import json
import re
import zipfile
from xml.etree import ElementTree as ET

from biblion.sources.bibtex import latex_to_text
from biblion.sources.latex import group

# Types and fields of the formats.
RIS_TYPES = {"JOUR": "article", "JFULL": "article", "MGZN": "article", "NEWS": "article", "CONF": "inproceedings", "CPAPER": "inproceedings", "BOOK": "book", "EBOOK": "book", "CHAP": "incollection", "ECHAP": "incollection", "THES": "phdthesis", "RPRT": "techreport", "COMP": "software", "DATA": "dataset", "ELEC": "online", "WEB": "online"}
RIS_FIELDS = {"TI": "title", "T1": "title", "PY": "year", "Y1": "year", "DA": "date", "JO": "journal", "JF": "journal", "T2": "journal", "JA": "journal", "VL": "volume", "IS": "number", "DO": "doi", "UR": "url", "SN": "issn", "PB": "publisher", "AB": "abstract", "N1": "note", "SP": "pages", "EP": "endpage"}
CSL_TYPES = {"article-journal": "article", "article-magazine": "article", "article-newspaper": "article", "article": "misc", "paper-conference": "inproceedings", "book": "book", "chapter": "incollection", "thesis": "phdthesis", "report": "techreport", "webpage": "online", "post-weblog": "online", "software": "software", "dataset": "dataset"}
CSL_FIELDS = {"title": "title", "volume": "volume", "issue": "number", "page": "pages", "DOI": "doi", "URL": "url", "ISBN": "isbn", "ISSN": "issn", "publisher": "publisher", "note": "note", "PMID": "pmid", "PMCID": "pmcid", "language": "language"}


def _entry(key: str, kind: str, fields: dict, file: str, line: int, raw: str = "") -> dict:
    own = {k: {"raw": str(v), "value": str(v), "text": latex_to_text(str(v)) if "\\" in str(v) or "{" in str(v) else str(v), "line": line} for k, v in fields.items() if v not in (None, "")}
    return {"key": key, "entry_type": kind, "fields": own, "file": file, "line": line, "raw": raw, "suppressions": []}


def _keyed(found: list[tuple], file: str) -> list[dict]:
    """Entries from (key or None, type, fields, line, raw): missing keys are ref1, ref2, ...; a taken one gets a suffix."""
    taken: set[str] = set()
    out = []
    for n, (key, kind, fields, line, raw) in enumerate(found, 1):
        key = own = str(key) if key else f"ref{n}"
        k = 2
        while own in taken:
            own, k = f"{key}-{k}", k + 1
        taken.add(own)
        out.append(_entry(own, kind, fields, file, line, raw))
    return out


def ris(text: str, file: str = "") -> list[dict]:
    """Tags at the line's start, continuation lines, and records without an ER that end at the next TY."""
    found, now = [], None
    for n, line in enumerate(text.splitlines(), 1):
        m = re.match(r"^([A-Z][A-Z0-9])  ?-\s?(.*)$", line.rstrip())
        if m and m[1] == "TY":
            now = {"kind": RIS_TYPES.get(m[2].strip(), "misc"), "fields": {}, "authors": [], "line": n, "id": None, "last": None}
            found.append(now)
        elif now is None:
            continue
        elif m and m[1] == "ER":
            now = None
        elif m:
            tag, value = m[1], m[2].strip()
            if tag in ("AU", "A1"):
                now["authors"].append(value)
            elif tag == "ID":
                now["id"] = value
            elif tag in RIS_FIELDS and value and RIS_FIELDS[tag] not in now["fields"]:
                now["fields"][RIS_FIELDS[tag]] = value
            now["last"] = RIS_FIELDS.get(tag)
        elif line.strip() and now["last"] in now["fields"]:
            now["fields"][now["last"]] += " " + line.strip()
    rows = []
    for r in found:
        f = r["fields"]
        if end := f.pop("endpage", None):
            f["pages"] = f"{f.get('pages', '')}--{end}"
        if y := re.match(r"\d{4}", f.get("year", f.get("date", ""))):
            f["year"] = y[0]
        if r["kind"] in ("inproceedings", "incollection") and "journal" in f:
            f["booktitle"] = f.pop("journal")
        rows.append((r["id"], r["kind"], {"author": " and ".join(r["authors"])} | f, r["line"], ""))
    return _keyed(rows, file)


def _csl_names(names) -> str:
    return " and ".join(f"{{{n['literal']}}}" if n.get("literal") else ", ".join(x for x in (n.get("family", ""), n.get("given", "")) if x) for n in names or [])


def csl_fields(item: dict) -> tuple[str, dict]:
    kind = CSL_TYPES.get(item.get("type", ""), "misc")
    f = {b: item[a] for a, b in CSL_FIELDS.items() if item.get(a)}
    f["author"], f["editor"] = _csl_names(item.get("author")), _csl_names(item.get("editor"))
    parts = (item.get("issued") or {}).get("date-parts") or [[]]
    year = re.search(r"\d{4}", str(parts[0][0] if parts[0] else (item.get("issued") or {}).get("literal") or (item.get("issued") or {}).get("raw") or ""))
    f["year"] = year[0] if year else None
    if item.get("container-title"):
        f["booktitle" if kind in ("inproceedings", "incollection") else "journal"] = item["container-title"]
    return kind, {k: v for k, v in f.items() if v}


def csl_json(text: str, file: str = "") -> list[dict]:
    data = json.loads(text)
    items = data if isinstance(data, list) else data.get("items", data.get("references", [data]))
    return _keyed([(i.get("id") or i.get("citation-key"), *csl_fields(i), 1, "") for i in items if isinstance(i, dict)], file)


def hayagriva_item(key: str, entry: dict) -> dict:
    """A Hayagriva entry as a CSL item."""
    kinds = {"article": "article-journal", "book": "book", "chapter": "chapter", "thesis": "thesis", "report": "report", "web": "webpage", "repository": "software", "conference": "paper-conference"}
    parent = entry.get("parent") or {}
    parent = parent[0] if isinstance(parent, list) and parent else parent
    people = entry.get("author") or []
    names = []
    for p in [people] if isinstance(people, (str, dict)) else people:
        p = p if isinstance(p, dict) else dict(zip(("family", "given"), (x.strip() for x in str(p).split(",", 1))))
        names.append({"family": p.get("family", p.get("name", "")), "given": p.get("given", p.get("given-name", ""))})
    serial = entry.get("serial-number") or {}
    serial = serial if isinstance(serial, dict) else {}
    kind = "paper-conference" if str(parent.get("type", "")).lower() in ("proceedings", "conference") else kinds.get(str(entry.get("type", "")).lower(), "")
    title = entry.get("title")
    year = re.match(r"\d{4}", str(entry.get("date", parent.get("date", ""))))
    url = entry.get("url")
    return {"id": key, "type": kind, "title": title.get("value") if isinstance(title, dict) else title, "author": names, "issued": {"date-parts": [[int(year[0])]]} if year else {}, "container-title": parent.get("title"), "volume": entry.get("volume", parent.get("volume")),
            "issue": entry.get("issue", parent.get("issue")), "page": entry.get("page-range"), "DOI": serial.get("doi"), "ISBN": serial.get("isbn"), "ISSN": serial.get("issn"), "URL": url.get("value") if isinstance(url, dict) else url, "publisher": entry.get("publisher")}


def yaml_list(text: str, file: str = "") -> list[dict]:
    """CSL YAML (a list, or a mapping with references) or Hayagriva (a mapping of keys)."""
    import yaml

    data = yaml.safe_load(text)
    if isinstance(data, dict) and "references" in data:
        data = data["references"]
    items = data if isinstance(data, list) else [hayagriva_item(k, v) for k, v in (data or {}).items() if isinstance(v, dict)]
    return _keyed([(i.get("id"), *csl_fields(i), 1, "") for i in items if isinstance(i, dict)], file)


# --- .bbl -----------------------------------------------------------------------------------------------


def bbl(text: str, file: str = "") -> list[dict]:
    """biblatex records if there are any, else bibitems."""
    found = []
    for m in re.finditer(r"\\entry\{([^{}]*)\}\{([^{}]*)\}\{[^{}]*\}(.*?)\\endentry", text, re.S):
        fields = {k: v for k, v in re.findall(r"\\field\{([^{}]*)\}\{((?:[^{}]|\{[^{}]*\})*)\}", m[3])}
        fields |= {k: v.strip() for k, v in re.findall(r"\\verb\{(doi|eprint|url)\}\s*\\verb (.*?)\s*\\endverb", m[3], re.S)}
        people = re.search(r"\\name\{author\}\{\d+\}\{[^{}]*\}\{(.*?)\n\s*\}\s*\n", m[3], re.S)
        names = re.findall(r"family=\{?([^{},]*)\}?,.*?(?:given=\{?([^{},]*)\}?,|\}\})", people[1], re.S) if people else []
        fields["author"] = " and ".join(f"{a}, {b}".strip(", ") for a, b in names)
        for a, b in (("journaltitle", "journal"),):
            if a in fields:
                fields.setdefault(b, fields[a])
        found.append((m[1], m[2], fields, text.count("\n", 0, m.start()) + 1, m[0]))
    if found:
        return _keyed(found, file)
    starts = bibitems(text)
    for (at, key, body), after in zip(starts, [*starts[1:], None]):
        block = text[body : after[0] if after else len(text)].split("\\end{thebibliography}")[0]
        kind, fields = _bibitem(block)
        found.append((key, kind, fields, text.count("\n", 0, at) + 1, text[at:body] + block))
    return _keyed(found, file)


def bibitems(text: str) -> list[tuple[int, str, int]]:
    """(start, key, start of what follows) of each bibitem, with or without a label."""
    out, command = [], "\\bibitem"
    at = text.find(command)
    while at >= 0:
        end = at + len(command)
        label = group(text, end, "[]")
        key = group(text, label[1] if label else end, "{}")
        if key:
            out.append((at, key[0], key[1]))
            end = key[1]
        at = text.find(command, end)
    return out


def bibinfos(block: str) -> dict[str, str]:
    """What the bibinfo commands of a bibitem name."""
    out, at = {}, block.find("\\bibinfo")
    while at >= 0:
        name = group(block, at + len("\\bibinfo"), "{}")
        value = group(block, name[1], "{}") if name else None
        if value:
            out[name[0].lower()] = latex_to_text(value[0])
        at = block.find("\\bibinfo", at + 1)
    return out


def _bibitem(block: str) -> tuple[str, dict]:
    """Fields of a bibitem: what bibinfo names, else the blocks authors, title, venue."""
    named = bibinfos(block)
    blocks = [latex_to_text(b) for b in block.split("\\newblock")]
    fields = {k: v for k, v in named.items() if k in ("title", "journal", "year", "volume", "pages", "publisher", "booktitle", "doi", "author")}
    if not fields and len(blocks) < 2:
        return parse_reference(blocks[0])
    if blocks and "author" not in fields:
        fields["author"] = names_text(blocks[0].rstrip(". "))
    if len(blocks) > 1:
        fields.setdefault("title", blocks[1].strip().rstrip("."))
    rest = " ".join(blocks[2:])
    if y := re.findall(r"\b((?:19|20)\d\d)[a-z]?\b", rest or blocks[-1]):
        fields.setdefault("year", y[-1])
    kind, more = venue(rest)
    fields = more | fields
    fields |= {k: v for k, v in running_ids(block).items() if k not in fields}
    return kind, fields


# --- Word -----------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(data: bytes, file: str = "") -> list[dict]:
    """Reference manager fields (CSL, EndNote), Word's own sources, else the list that is typed under its heading."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
        sources = [ET.fromstring(z.read(n)) for n in z.namelist() if re.fullmatch(r"customXml/item\d+\.xml", n)]
    paragraphs, codes, open_ = [], [], None
    for p in root.iter(_W + "p"):
        said = ""
        for node in p.iter():
            if node.tag == _W + "fldChar":
                kind = node.get(_W + "fldCharType")
                if kind == "begin":
                    open_ = ""
                elif kind == "separate" and open_:
                    codes.append(open_)
                    open_ = None
                elif kind == "end":
                    open_ = None
            elif node.tag == _W + "instrText" and open_ is not None:
                open_ += node.text or ""
            elif node.tag == _W + "t":
                said += node.text or ""
        style = p.find(f"{_W}pPr/{_W}pStyle")
        paragraphs.append((said.strip(), style.get(_W + "val", "") if style is not None else ""))
    items = []
    for code in codes:
        if "CSL_CITATION" in code and (m := re.search(r"\{.*\}", code, re.S)):
            for c in json.loads(m[0]).get("citationItems", []):
                items.append(c.get("itemData", {}) | ({"id": c["id"]} if "id" in c else {}))
    found = {str(i.get("id")): (None, *csl_fields(i), 1, "") for i in items}
    for code in codes:
        if "EN.CITE" in code:
            for r in _endnote(code):
                found[str(len(found))] = r
    for s in sources:
        for src in s.iter():
            if src.tag.endswith("}Source"):
                found[str(len(found))] = _word_source(src)
    if found:
        return _keyed(list(found.values()), file)
    return _keyed([(None, *parse_reference(t), n, t) for n, t in typed_list(paragraphs)], file)


def _endnote(code: str) -> list[tuple]:
    xml = code[code.index("<EndNote") : code.rindex("</EndNote>") + 10] if "<EndNote" in code and "</EndNote>" in code else ""
    if not xml and (m := re.search(r"EN\.CITE\.DATA\s+([A-Za-z0-9+/=\s]+)", code)):
        xml = base64.b64decode(re.sub(r"\s", "", m[1])).decode("utf-8", "replace").strip("\x00")
    out = []
    for r in ET.fromstring(xml).iter("record") if xml else []:
        text = lambda path: "".join(r.find(path).itertext()).strip() if r.find(path) is not None else ""
        kind = {"17": "article", "10": "inproceedings", "47": "inproceedings", "6": "book", "5": "incollection", "32": "phdthesis", "27": "techreport"}.get(text("ref-type"), "misc")
        fields = {"author": " and ".join("".join(a.itertext()) for a in r.findall("contributors/authors/author")), "title": text("titles/title"), "year": text("dates/year"), "volume": text("volume"), "number": text("number"), "pages": text("pages"), "doi": text("electronic-resource-num"),
                  "booktitle" if kind == "inproceedings" else "journal": text("titles/secondary-title") or text("periodical/full-title")}
        out.append((None, kind, fields, 1, ""))
    return out


def _word_source(src: ET.Element) -> tuple:
    text = lambda name: next(("".join(x.itertext()).strip() for x in src.iter() if x.tag.endswith("}" + name)), "")
    people = []
    for p in src.iter():
        if p.tag.endswith("}Person"):
            part = {x.tag.rsplit("}", 1)[1]: (x.text or "").strip() for x in p}
            people.append(", ".join(v for v in (part.get("Last", ""), part.get("First", "")) if v))
    kind = {"JournalArticle": "article", "ConferenceProceedings": "inproceedings", "Book": "book", "BookSection": "incollection", "Report": "techreport"}.get(text("SourceType"), "misc")
    return text("Tag") or None, kind, {"author": " and ".join(people), "title": text("Title"), "year": text("Year"), "journal": text("JournalName"), "booktitle": text("ConferenceName") or text("BookTitle"), "publisher": text("Publisher"), "volume": text("Volume"), "pages": text("Pages"), "doi": text("DOI")}, 1, ""


HEADING = re.compile(r"^\W*(?:\d+\.?\s*)?(references|bibliography|works cited|literature cited|literatur|références|referencias|参考文献)\W*$", re.I)


def typed_list(paragraphs: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """Paragraphs after the last heading of a reference list, up to the next heading."""
    at = max((i for i, (t, _) in enumerate(paragraphs) if HEADING.match(t)), default=None)
    out = []
    for i, (t, style) in enumerate(paragraphs[at + 1 :] if at is not None else [], (at or 0) + 2):
        if style.lower().startswith("heading") or re.match(r"^(appendix|supplement|acknowledg)", t, re.I):
            break
        if t:
            out.append((i, re.sub(r"^\s*(?:\[\d+\]|\d+[.)])\s*", "", t)))
    return out


# --- plain text -----------------------------------------------------------------------------------------


def drop_running_lines(lines: list[str], least: int = 3, longest: int = 90) -> list[str]:
    """Without short lines that come again and again, page numbers aside."""
    key = lambda x: re.sub(r"\s*\d+$", "", x.strip())
    seen: dict[str, int] = {}
    for x in lines:
        seen[key(x)] = seen.get(key(x), 0) + 1
    return [x for x in lines if not key(x) or len(key(x)) >= longest or seen[key(x)] < least]


def starts_appendix(line: str) -> bool:
    """A heading such as "Appendix A" or "B. Supplementary material"."""
    words = [w.strip(".:").lower() for w in line.split()]
    if len(words) > 1 and len(words[0]) == 1 and words[0].isalpha():
        words = words[1:]
    return words[:1] in (["appendix"], ["appendices"]) or words[:2] == ["supplementary", "material"]


def reference_section(text: str) -> tuple[int, str]:
    """(line, text) after the last reference heading, up to an appendix."""
    lines = text.split("\n")
    at = max((i for i, x in enumerate(lines) if HEADING.match(x)), default=-1)
    out = []
    for x in lines[at + 1 :]:
        if out and starts_appendix(x):
            break
        out.append(x)
    return at + 2, "\n".join(drop_running_lines(out))


def split_references(text: str) -> list[tuple[int, str]]:
    """(line, reference): numbered ones whose numbers count up, else blocks between blank lines, else one a line."""
    lines = text.split("\n")
    starts, want = [], 1
    for i, x in enumerate(lines):
        m = re.match(r"^\s*(?:\[(\d+)\]|(\d+)[.)])\s+\S", x)
        if m and int(m[1] or m[2]) == want:
            starts.append(i)
            want += 1
    if len(starts) < 2:
        filled = [bool(x.strip()) for x in lines]
        starts = [i for i, f in enumerate(filled) if f and (i == 0 or not filled[i - 1])]
        if len(starts) < 2 and sum(filled) > 1:
            ends = sum(bool(re.search(r"(\.|\d|/\S+)\s*$", x)) for x in lines if x.strip())
            heads = [i for i, x in enumerate(lines) if x.strip() and (ends >= 0.6 * sum(filled) or re.match(r"^\s*[A-Z][\w'’-]+,\s+[A-Z]", x))]
            starts = heads or starts
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        whole = join_lines(lines[a:b])
        whole = re.sub(r"^\s*(?:\[\d+\]|\d+[.)])\s+", "", whole).strip()
        if whole:
            out.append((a + 1, whole))
    return out


def join_lines(lines: list[str]) -> str:
    """Lines as one text: a DOI or link that a line end cut goes on without a space, a hyphenated word too."""
    out = ""
    for x in (y.strip() for y in lines):
        if re.search(r"(?:https?://\S*|10\.\d{4,9}/\S*)[/.\-_]$", out) and re.match(r"^[\w./-]+", x):
            out += x
        elif re.search(r"[a-z]-$", out) and re.match(r"^[a-z]", x):
            out = out[:-1] + x
        else:
            out = f"{out} {x}" if out and x else out + x
    return out


def running_ids(text: str) -> dict:
    """Identifiers in running text."""
    out = {}
    if m := re.search(r"\b(10\.\d{4,9}/[^\s\"<>{}]+?)[.,;)]*(?:\s|$)", text):
        out["doi"] = m[1]
    if m := re.search(r"arxiv[:\s./a-z]*?(\d{4}\.\d{4,5})(v\d+)?", text, re.I):
        out |= {"eprint": m[1], "archiveprefix": "arXiv"}
    if m := re.search(r"https?://[^\s{}<>\"]+", text):
        out["url"] = m[0].rstrip(".,;)")
    if m := re.search(r"\bPMID:?\s*(\d{4,9})", text):
        out["pmid"] = m[1]
    return out


def looks_like_names(text: str) -> bool:
    """Surnames with initials or given names, separated by commas and "and"."""
    parts = [p.strip() for p in re.split(r",\s+|\s+and\s+|\s*&\s*|;\s*", re.sub(r"\bet al\.?", "", text)) if p.strip()]
    named = sum(bool(re.fullmatch(r"(?:[A-Z]\.?[\s-]?){1,4}|(?:[\w.’'-]+\s){0,3}[A-Z][\w’'-]+(?:\s[A-Z]{1,3})?", p)) for p in parts)
    return bool(parts) and named >= 0.8 * len(parts) and len(text) < 600 and not re.search(r"\d{4}", text)


def names_text(text: str) -> str:
    """Author text in any common style as a BibTeX list."""
    others = bool(re.search(r"\bet\s+al\b|\bothers\b|…", text))
    text = re.sub(r",?\s*(?:et\s+al\.?|and\s+others)", "", text).strip(" ,;")
    text = re.sub(r"(?<![A-Z])\.$", "", text)
    text = re.sub(r"\s*(?:,\s*)?(?:&|\band\b)\s*", ", ", text)
    if ";" in text:
        people = [p.strip() for p in text.split(";")]
    elif re.match(r"^[^,]+,\s*(?:[A-Z]\.[\s-]?)+(?:,|$)", text):  # Family, I. I., Family, I.
        parts = [p.strip() for p in text.split(",") if p.strip()]
        people = [f"{a}, {b}" for a, b in zip(parts[::2], parts[1::2])]
    elif re.match(r"^[\w’' -]+\s[A-Z]{1,3}(?:,|$)", text) and not re.match(r"^[A-Z][a-z]+\s[A-Z][a-z]+", text):  # Family IJ
        people = [re.sub(r"^(.*)\s([A-Z]{1,3})$", lambda m: f"{m[1]}, {'. '.join(m[2])}.", p.strip()) for p in text.split(",")]
    else:
        people = [p.strip() for p in text.split(",")]
    return " and ".join([p for p in people if p] + ["others"] * others)


PAGES = re.compile(r"[A-Za-z]?\d+(?:\s*[-–—]+\s*[A-Za-z]?\d+)?")
MEETINGS = ("proc.", "proceedings", "conference", "workshop", "symposium")
HOUSES = ("press", "publish", "springer", "wiley", "elsevier", "verlag")
PERIODICALS = ("j", "journal", "trans", "review", "letters", "nature", "science")


def _end_digits(text: str) -> str:
    bare = text.rstrip()
    return bare[len(bare.rstrip("0123456789")) :]


def _first_pages(text: str) -> str | None:
    """The pages that a text starts with, after ":", "," and "pp."."""
    text = text.lstrip(" :,")
    for mark in ("pp.", "pp", "p.", "pages"):
        if text.lower().startswith(mark):
            text = text[len(mark) :].lstrip()
            break
    m = PAGES.match(text)
    return m[0] if m else None


def numbering(rest: str) -> dict:
    """Volume, number and pages of what follows a journal's name: 12(3):45-67, vol. 12, 12, 45."""
    at = rest.find("(")
    while at >= 0:
        volume, close = _end_digits(rest[:at]), rest.find(")", at)
        inside = rest[at + 1 : close].strip() if close > 0 else ""
        if 0 < len(volume) < 5 and 0 < len(inside) < 9 and " " not in inside:
            return {"volume": volume, "number": inside, "pages": _first_pages(rest[close + 1 :])}
        at = rest.find("(", at + 1)
    out: dict = {}
    words = rest.replace(":", " : ").replace(",", " , ").split()
    for one, two, three in zip(words, [*words[1:], ""], [*words[2:], ""]):
        if one.lower().strip(".") in ("vol", "volume") and two.isdigit():
            out = {"volume": two}
            break
        if one.isdigit() and len(one) < 5 and two in (":", ",") and (PAGES.match(three) or three.lower().startswith("p")):
            out = {"volume": one}
            break
    for i, w in enumerate(words):
        pages = _first_pages(" ".join(words[i + 1 : i + 4])) if w == ":" or w.lower().strip(".") in ("p", "pp", "pages") else None
        if pages and any(c in pages for c in "-–—"):
            return out | {"pages": pages}
    return out


def _name_until(rest: str, ends: tuple[str, ...]) -> str:
    """The words of a name up to a number, a bracket or one of ends."""
    out = []
    for w in rest.split():
        if w[0].isdigit() or w[0] == "(" or w.lower().rstrip(".,") in ends:
            break
        out.append(w)
        if w[-1] in ".,;" and len(w) > 4 and w[-1] != ",":
            break
    return " ".join(out).strip(" .,")


def venue(rest: str) -> tuple[str, dict]:
    """Type and fields of what follows a title: the container, volume, number, pages, publisher."""
    rest = rest.strip(" .,")
    out = {k: v for k, v in numbering(rest).items() if v}
    words = rest.split()
    low = [w.lower() for w in words]
    start = 1 if low[:1] in (["in"], ["in:"]) else next((i for i, w in enumerate(low) if w.strip(",") in MEETINGS), None)
    if start is not None and len(words) > start:
        name = []
        for piece in " ".join(words[start:]).split(", "):
            first = piece.split()[0].lower().strip(".") if piece.split() else ""
            if name and (first[:1].isdigit() or first in ("page", "pages", "p", "pp", "vol", "volume")):
                break
            name.append(piece)
        return "inproceedings", {"booktitle": re.split(r"(?<=[a-z0-9)])\. ", ", ".join(name), maxsplit=1)[0].strip(" .,")} | out
    if "arxiv" in rest.lower():
        return "misc", {"howpublished": rest}
    name = _name_until(rest, ("vol", "volume", "p", "pp", "no"))
    if out.get("volume") and name:
        return "article", {"journal": name} | out
    if any(w.startswith(HOUSES) for w in low):
        return "book", {"publisher": name}
    if name and any(w.strip(".,") in PERIODICALS for w in low):
        return "article", {"journal": name}
    return "misc", {"howpublished": name} if name else {}


# Readers of a style: names, title, rest and, where the style says it, year; tried in this order.

QUOTES = {'"': '"', "“": "”", "‘": "’", "«": "»"}
YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")


def sentence(text: str, loose: bool = False) -> tuple[str, str] | None:
    """A first sentence of five characters or more, and what follows it; initials do not end one, or only where loose
    and nothing else does. Where loose and nothing else ends one, a shorter one counts too."""
    ends = [i for i in range(1, len(text) - 1) if text[i] in ".?!" and text[i + 1] == " "]
    long = [i for i in ends if i >= 5]
    whole = [i for i in long if not (text[i] == "." and text[i - 1].isupper() and not text[i - 2 : i - 1].isalpha())]
    at = next(iter(whole or ((long or ends) if loose else [])), None)
    return None if at is None else (text[:at], text[at + 1 :].strip())


def _quoted(text: str) -> dict | None:
    at = min((i for i in (text.find(q) for q in QUOTES) if i > 3), default=-1)
    close = text.find(QUOTES[text[at]], at + 1) if at > 0 else -1
    if close < at + 6:
        return None
    before = text[:at].rstrip(" ,.")
    year = None
    if before.endswith(")") and (m := YEAR.match(before, before.rfind("(") + 1)):
        year, before = m[0], before[: before.rfind("(")].rstrip(" ,.")
    return {"names": before, "title": text[at + 1 : close].rstrip(",.?!"), "rest": text[close + 1 :].lstrip(",. "), "year": year}


def _apa(text: str) -> dict | None:
    """Names (year). Title. Rest."""
    for m in YEAR.finditer(text):
        if text[m.start() - 1] == "(" and (close := text.find(")", m.end())) > 0:
            got = sentence(text[close + 1 :].lstrip(" .,:"), True)
            return {"names": text[: m.start() - 1].rstrip(), "year": m[0], "title": got[0], "rest": got[1]} if got else None
    return None


def _untitled(text: str) -> dict | None:
    """Names year, journal, volume, page."""
    pieces = [x.strip() for x in text.split(",")]
    for i, piece in enumerate(pieces[:-3]):
        head, _, last = piece.rpartition(" ")
        if YEAR.match(last) and len(last) < 6 and pieces[i + 2].isdigit() and PAGES.match(pieces[i + 3]) and pieces[i + 1][:1].isupper():
            return {"names": ", ".join([*pieces[:i], head]), "year": last[:4], "title": "", "rest": ", ".join(pieces[i + 1 :])}
    return None


def _is_initials(piece: str) -> bool:
    """J., J. R., J.-R. and so on."""
    letters = piece.replace("-", " ").replace(".", ". ").split()
    return 0 < len(letters) < 5 and all(len(x) == 2 and x[0].isupper() and x[1] == "." for x in letters)


def _family_first(text: str) -> dict | None:
    """Family, I. I., Family, I. Title. Rest with a year."""
    pieces = text.replace(";", ",").replace(" & ", ", ").replace(" and ", ", ").split(",")
    at = used = 0
    while at + 1 < len(pieces):
        words = pieces[at + 1].split()
        n = 0
        while n < len(words) and _is_initials(words[n].rstrip(":")):
            n += 1
        if not n or not pieces[at].strip()[:1].isalpha() or len(pieces[at].split()) > 4:
            break
        used = text.find(" ".join(words[:n]), used) + len(" ".join(words[:n]))
        at += 2
        if n < len(words):
            break
    names, tail = text[:used].rstrip(":"), text[used:].lstrip(" ,;:&")
    if tail.startswith("et al"):
        names, tail = names + " et al.", tail.removeprefix("et al").lstrip(" .,:")
    got = sentence(tail) if used and tail[:1].isupper() else None
    year = YEAR.findall(got[1]) if got else []
    return {"names": names, "title": got[0], "rest": got[1], "year": year[0]} if year else None


def _vancouver(text: str) -> dict | None:
    """Family IJ, Family K. Title. Rest with a year."""
    head, stop, tail = text.partition(". ")
    people = [p for p in (x.strip() for x in head.split(",")) if p and p != "et al"]
    short = lambda p: len(p.split()) > 1 and p.split()[-1].isalpha() and p.split()[-1].isupper() and len(p.split()[-1]) < 4
    got = sentence(tail) if stop and people and all(map(short, people)) else None
    year = YEAR.findall(got[1]) if got else []
    return {"names": head, "title": got[0], "rest": got[1], "year": year[0]} if year else None


def _year_after(text: str) -> dict | None:
    """Names. Year. Title. Rest."""
    for m in YEAR.finditer(text):
        if text[: m.start()].endswith(". ") and (after := re.match(r"[a-z]?\. ", text[m.end() :])):
            got = sentence(text[m.end() + after.end() :], True)
            return {"names": text[: m.start()].rstrip(" ."), "year": m[0], "title": got[0], "rest": got[1]} if got else None
    return None


def _sentences(text: str) -> dict | None:
    """Names. Title. Rest with a year."""
    first = sentence(text)
    second = sentence(first[1]) if first else None
    year = YEAR.findall(second[1]) if second else []
    return {"names": first[0], "title": second[0], "rest": second[1], "year": year[0]} if year else None


def _initials_first(text: str) -> dict | None:
    """I. Family, I. Family, Title, rest with a year."""
    pieces = text.split(", ")
    n = 0
    while n < len(pieces) and len(pieces[n].split()) > 1 and _is_initials(pieces[n].split()[0]):
        n += 1
    rest = ", ".join(pieces[n + 1 :])
    year = YEAR.findall(rest)
    return {"names": ", ".join(pieces[:n]), "title": pieces[n], "rest": rest, "year": year[0]} if n and year and pieces[n][:1].isupper() else None


STYLES = (_quoted, _apa, _untitled, _family_first, _vancouver, _year_after, _sentences, _initials_first)


def parse_reference(text: str) -> tuple[str, dict]:
    """Type and fields of one formatted reference: the first style whose names look like names."""
    text = re.sub(r"\s+", " ", text).strip()
    for style in STYLES:
        got = style(text)
        if not got or not looks_like_names(got["names"]):
            continue
        kind, fields = venue(" ".join(w for w in got["rest"].split() if "://" not in w and "10." not in w[:8].lower().removeprefix("doi:") and w.lower().rstrip(":") != "doi"))
        year = got.get("year") or next(iter(YEAR.findall(got["rest"])), None)
        # a space before the full stop of the title belongs to it, as in the .bbl reader
        title = got["title"].lstrip(" ,.").rstrip(",.") if style is _apa else got["title"].strip(" ,.")
        fields |= {"author": names_text(got["names"]), "title": title, "year": year}
        return kind, {k: v for k, v in (fields | running_ids(text)).items() if v}
    year = YEAR.findall(text)
    return "misc", {k: v for k, v in ({"note": text, "year": year[-1] if year else None} | running_ids(text)).items() if v}


def plaintext(text: str, file: str = "") -> list[dict]:
    """A list of references; a dash in place of the authors repeats those before."""
    rows, last = [], ""
    for line, ref in split_references(text):
        kind, fields = parse_reference(re.sub(r"^(?:[-–—_]{2,}|———)[.,]?\s*", (last + ". ") if last else "", ref))
        if ref[:1] in "-–—_" and last:
            fields["author"] = names_text(last)
        elif m := re.match(r"^(.{3,300}?)(?:\.\s|\s\()", ref):
            last = m[1] if looks_like_names(m[1]) else last
        rows.append((None, kind, fields, line, ref))
    return _keyed(rows, file)
