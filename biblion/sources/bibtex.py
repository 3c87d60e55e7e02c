"""BibTeX and BibLaTeX files: entries, fields, issues and suppressions, and LaTeX values as plain text."""

from __future__ import annotations

import re
import unicodedata

# TeX accents and letters.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "c": "\u0327", "k": "\u0328", "d": "\u0323", "b": "\u0331"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ", "dh": "ð", "th": "þ", "dj": "đ", "ng": "ŋ"}
MACROS = {"jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June", "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December"}
SYMBOLS = {"textendash": "–", "textemdash": "—", "textquoteright": "’", "textquoteleft": "‘", "ldots": "…", "dots": "…", "times": "×", "odot": "⊙", "star": "⋆", "copyright": "©", "S": "§", "P": "¶", "pounds": "£", "LaTeX": "LaTeX", "TeX": "TeX", "BibTeX": "BibTeX"}
_GREEK = {n: unicodedata.lookup(f"GREEK SMALL LETTER {n.upper()}") for n in "alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()}


def latex_to_text(value: str, keep_links: bool = False) -> str:
    """Plain text of a LaTeX value: accents, letters, symbols, styles and math without their markup."""
    s = re.sub(r"\\(?:url|path)\s*\{([^{}]*)\}", r"\1", value)
    s = re.sub(r"\\href\s*\{([^{}]*)\}\s*\{((?:[^{}]|\{[^{}]*\})*)\}", r"\2 \1" if keep_links else r"\2", s)

    def accent(m: re.Match) -> str:
        letter = m[2] or m[3]
        letter = {"\\i": "i", "\\j": "j", "ı": "i"}.get(letter, letter)
        return unicodedata.normalize("NFC", letter + ACCENTS[m[1]])

    s = re.sub(r"\\([`'^~=.\"])\s*(?:\{(\\?[^\W\d_])\}|(\\[ij](?![A-Za-z])|[^\W\d_]))", accent, s)
    s = re.sub(r"\\([uvHcdbkr])(?:\s*\{(\\?[^\W\d_])\}|\s+([^\W\d_]))", accent, s)
    s = re.sub(r"\\([A-Za-z]+)(?![A-Za-z])\s*(\{\})?", lambda m: LETTERS.get(m[1]) or SYMBOLS.get(m[1]) or _GREEK.get(m[1]) or ("" if m[1] in ("it", "bf", "em", "rm", "sc", "tt", "sf", "relax", "noopsort") else m[0]), s)
    for _ in range(4):
        s = re.sub(r"\\[A-Za-z]+\*?\s*\{((?:[^{}]|\{[^{}]*\})*)\}", r"\1", s)
    s = re.sub(r"\\[A-Za-z]+\*?\s?", "", s)
    s = s.replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”").replace("\\\\", " ")
    s = re.sub(r"\\([&%$#_{}])", r"\1", s)
    s = re.sub(r"(?<!\\)[{}$]", "", s).replace("~", " ").replace("\\", "")
    return unicodedata.normalize("NFC", re.sub(r"\s+", " ", s).strip())


def _value(raw: str, macros: dict[str, str]) -> str:
    """A field's value: braced or quoted parts, numbers and macros, joined by #."""
    parts, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(raw):
        if c == '"' and not depth and raw[i - 1 : i] != "\\":
            quoted = not quoted
        elif c in "{}" and raw[i - 1 : i] != "\\":
            depth += 1 if c == "{" else -1
        elif c == "#" and not depth and not quoted:
            parts.append(raw[at:i])
            at = i + 1
    out = []
    for p in (x.strip() for x in [*parts, raw[at:]]):
        if len(p) > 1 and p[0] + p[-1] in ("{}", '""'):
            out.append(p[1:-1])
        else:
            out.append(macros.get(p.lower(), p))
    return "".join(out)


def _close(text: str, start: int) -> int:
    """Where the block that opens before start closes; -1 if it does not."""
    closing = {"{": "}", "(": ")"}[text[start - 1]]
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == closing and not depth:
            return i
        elif c == "}":
            depth -= 1
            if depth < 0:
                return -1 if closing == ")" else i
        i += 1
    return -1


def _cut(body: str) -> list[str]:
    """body cut at commas outside braces and quotes."""
    parts, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(body):
        before = body[i - 1 : i]
        if c == '"' and not depth and before != "\\":
            quoted = not quoted
        elif c == "{" and before != "\\":
            depth += 1
        elif c == "}" and before != "\\":
            depth -= 1
        elif c == "," and not depth and not quoted:
            parts.append(body[at:i])
            at = i + 1
    return [*parts, body[at:]]


def _suppressions(lines: list[str], line: int) -> list[dict]:
    """Comments right above an entry: % refcheck: ignore RULE[, RULE] -- reason."""
    out = []
    n = line - 2
    while n >= 0 and lines[n].lstrip().startswith("%"):
        if m := re.match(r"\s*%+\s*[\w-]+:\s*ignore\s+([A-Z]{3}\d{3}(?:\s*,\s*[A-Z]{3}\d{3})*)\s*(?:(?:--|—|:)\s*(.*))?$", lines[n]):
            out.append({"rules": re.findall(r"[A-Z]{3}\d{3}", m[1]), "reason": (m[2] or "").strip(), "line": n + 1})
        n -= 1
    return out[::-1]


def parse(text: str, file: str = "") -> tuple[list[dict], list[dict]]:
    """(entries, issues) of a file. The first definition of a key and of a field counts; the others are issues."""
    macros, entries, issues, seen = dict(MACROS), [], [], {}
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    import bisect

    line_of = lambda at: bisect.bisect_right(starts, at)
    at = 0
    while m := re.compile(r"@\s*([A-Za-z]+)\s*([{(])").search(text, at):
        if text[: m.start()].rsplit("\n", 1)[-1].lstrip().startswith("%"):
            at = m.end()
            continue
        kind, line, end = m[1].lower(), line_of(m.start()), _close(text, m.end())
        if end < 0:
            issues.append({"kind": "syntax", "file": file, "line": line, "key": None, "detail": f"@{kind} is not closed"})
            at = m.end()
            continue
        body, at = text[m.end() : end], end + 1
        if kind in ("comment", "preamble"):
            continue
        parts = _cut(body)
        if kind == "string":
            name, _, raw = body.partition("=")
            macros[name.strip().lower()] = _value(raw.strip(), macros)
            continue
        key = parts[0].strip()
        if not key or "=" in key or re.search(r"\s", key):
            issues.append({"kind": "syntax", "file": file, "line": line, "key": None, "detail": f"@{kind} has no key"})
            continue
        fields: dict[str, dict] = {}
        offset = m.end() + len(parts[0]) + 1
        for part in parts[1:]:
            name, eq, raw = part.partition("=")
            own_line = line_of(offset + len(part) - len(part.lstrip()))
            offset += len(part) + 1
            if not part.strip():
                continue
            if not eq:
                issues.append({"kind": "syntax", "file": file, "line": own_line, "key": key, "detail": f"no value: {part.strip()[:40]}"})
                continue
            name, value = name.strip().lower(), _value(raw.strip(), macros)
            if name in fields:
                issues.append({"kind": "duplicate_field", "file": file, "line": own_line, "key": key, "detail": name})
                continue
            fields[name] = {"raw": raw.strip(), "value": value, "text": latex_to_text(value, name in ("note", "howpublished")), "line": own_line}
        if key in seen:
            issues.append({"kind": "duplicate_key", "file": file, "line": line, "key": key, "detail": str(seen[key])})
            continue
        seen[key] = line
        entries.append({"key": key, "entry_type": kind, "fields": fields, "file": file, "line": line, "raw": text[m.start() : at], "suppressions": _suppressions(lines, line)})
    return entries, issues


def decode_entities(text: str) -> str:
    """HTML entities as the characters that they stand for, escaped where LaTeX takes those for its own."""
    import html

    out, at = [], 0
    while (begin := text.find("&", at)) >= 0:
        end = text.find(";", begin, begin + 34)
        name = text[begin + 1 : end] if end > 0 else ""
        number = name[:1] == "#" and (name[1:].isdigit() or (name[1:2] == "x" and name[2:] != "" and all(c in "0123456789abcdefABCDEF" for c in name[2:])))
        char = html.unescape(text[begin : end + 1]) if number or (name.isascii() and name.isalpha()) else ""
        out.append(text[at:begin])
        if char and char != text[begin : end + 1]:
            out.append("\\" + char if char in "&%$#_" else char)
            at = end + 1
        else:
            out.append("&")
            at = begin + 1
    return "".join(out) + text[at:]
