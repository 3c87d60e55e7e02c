"""LaTeX, Markdown and Typst sources: citations, bibliographies, includes; build files."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

# Citation commands by how they take keys.
SINGLE = "cite citet citep citealt citealp citeauthor citeyear citeyearpar parencite textcite autocite footcite smartcite supercite fullcite footfullcite citetitle citenum onlinecite Cite Citet Citep Parencite Textcite Autocite shortcite citeA citeN possessivecite".split()
MULTI = "cites parencites textcites autocites footcites smartcites supercites".split()
VERBATIM = ("verbatim", "Verbatim", "lstlisting", "minted", "comment", "filecontents", "filecontents*", "alltt")


def mask(text: str) -> str:
    """The text in the same length with comments, verbatim and switched-off parts blank."""
    out = list(text)

    def blank(a: int, b: int) -> None:
        for i in range(a, b):
            if out[i] != "\n":
                out[i] = " "

    for name in VERBATIM:
        for m in re.finditer(r"\\begin\{" + re.escape(name) + r"\}.*?(?:\\end\{" + re.escape(name) + r"\}|\Z)", text, re.S):
            blank(m.start(), m.end())
    for m in re.finditer(r"\\(?:verb\*?|lstinline)([^\sA-Za-z*{])(.*?)\1", text):
        blank(m.start(), m.end())
    for m in re.finditer(r"(?<!\\)(?:\\\\)*(%[^\n]*)", "".join(out)):
        blank(m.start(1), m.end(1))
    depth, at = 0, 0
    for m in re.finditer(r"\\(iffalse|if[a-zA-Z@]*|else|fi)(?![a-zA-Z@])", "".join(out)):
        word = m[1]
        if not depth and word == "iffalse":
            depth, at = 1, m.start()
        elif depth and word.startswith("if"):
            depth += 1
        elif depth and (word == "fi" or (word == "else" and depth == 1)):
            depth -= 1
            if not depth:
                blank(at, m.end())
    return "".join(out)


def group(text: str, i: int, pair: str) -> tuple[str, int] | None:
    """The group that opens at i after spaces, and where it ends."""
    while i < len(text) and text[i].isspace():
        i += 1
    if text[i : i + 1] != pair[0]:
        return None
    depth = 0
    for j in range(i, len(text)):
        depth += (text[j] == pair[0]) - (text[j] == pair[1])
        if not depth:
            return text[i + 1 : j], j + 1
    return None


def citations(text: str, extra: tuple[str, ...] = ()) -> list[dict]:
    """Cited keys with command, offset and whether they are only listed (nocite); extra: own single-key commands."""
    masked, out = mask(text), []
    for m in re.finditer(r"\\([A-Za-z]+)(\*?)", masked):
        name, i = m[1], m.end()
        many = name in MULTI or (name.endswith("s") and name[:-1] in SINGLE)
        if name != "nocite" and name not in SINGLE and not many and name not in extra:
            continue
        while True:
            while (g := group(masked, i, "[]")) or (many and (g := group(masked, i, "()"))):
                i = g[1]
            got = group(masked, i, "{}")
            if not got:
                break
            at = got[1] - 1 - len(got[0])
            for k in re.finditer(r"[^,]+", got[0]):
                if key := k[0].strip():
                    out.append({"key": key, "command": name, "offset": at + k.start() + len(k[0]) - len(k[0].lstrip()), "nocite": name == "nocite"})
            i = got[1]
            if not many:
                break
    return out


def resources(text: str) -> list[tuple[str, int]]:
    """Bibliography files a source declares, with their offsets."""
    out = []
    for m in re.finditer(r"\\(bibliography|addbibresource|addglobalbib|addsectionbib)\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}", mask(text)):
        for name in m[2].split(","):
            name = name.strip()
            if name:
                out.append((name if "." in name.rsplit("/", 1)[-1] else name + ".bib", m.start()))
    return out


def includes(text: str) -> list[tuple[str, int]]:
    masked = mask(text)
    out = [(m[2].strip(), m.start()) for m in re.finditer(r"\\(input|include|subfile|subfileinclude)\s*\{([^{}]*)\}", masked)]
    out += [(m[1].rstrip("/") + "/" + m[2], m.start()) for m in re.finditer(r"\\(?:sub)?import\s*\{([^{}]*)\}\s*\{([^{}]*)\}", masked)]
    return [(n if n.endswith(".tex") else n + ".tex", at) for n, at in out if n]


def markdown(text: str) -> list[dict]:
    """Pandoc citations outside code; a leading - suppresses the author, the key stays."""
    hide = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = re.sub(r"(?ms)^(```|~~~).*?^\1", hide, text)
    text = re.sub(r"`[^`\n]*`|(?s:<!--.*?-->)", hide, text)
    return [{"key": (m[1] or m[2]).rstrip(".:"), "command": "@", "offset": m.start(), "nocite": False} for m in re.finditer(r"(?<![\w@.])-?@(?:\{([^{}\s]+)\}|([A-Za-z0-9_][\w:.#$%&+?<>~/-]*))", text)]


def typst(text: str) -> list[dict]:
    """#cite(<key>) and @key, without the labels that the document itself defines."""
    text = re.sub(r"//[^\n]*|(?s:/\*.*?\*/)|`[^`]*`", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    labels = set(re.findall(r"<([\w:.-]+)>\s*(?:\n|$)", text))
    found = [(m[1], m.start()) for m in re.finditer(r"#cite\(\s*<([\w:.-]+)>", text)] + [(m[1].rstrip(".:"), m.start()) for m in re.finditer(r"(?<![\w@])@([\w:.-]+)", text)]
    return [{"key": k, "command": "cite", "offset": at, "nocite": False} for k, at in sorted(found, key=lambda x: x[1]) if k not in labels]


def aux(text: str) -> dict:
    """Cited keys, bibliography files and further files of an .aux."""
    keys = [k.strip() for m in re.finditer(r"\\(?:citation|abx@aux@cite(?:\{\d+\})?)\{([^{}]*)\}", text) for k in m[1].split(",") if k.strip()]
    return {"keys": [k for k in dict.fromkeys(keys) if k != "*"], "all": "*" in keys, "bib": [b.strip() for m in re.finditer(r"\\bibdata\{([^{}]*)\}", text) for b in m[1].split(",")], "inputs": re.findall(r"\\@input\{([^{}]*)\}", text)}


def bcf(xml: str) -> dict:
    keys = [(e.text or "").strip() for e in ET.fromstring(xml).iter() if e.tag.endswith("citekey")]
    data = [(e.text or "").strip() for e in ET.fromstring(xml).iter() if e.tag.endswith("datasource")]
    return {"keys": [k for k in dict.fromkeys(keys) if k and k != "*"], "all": "*" in keys, "bib": data, "inputs": []}
