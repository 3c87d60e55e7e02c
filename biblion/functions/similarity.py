"""String similarity that Spark has no expression for: Indel ratio, changed words. Arrow functions over pure Python."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from biblion.functions.text import SPECIAL, SPELLINGS, _WIDE

_SPECIAL = str.maketrans(SPECIAL | _WIDE)


def fold_text(s: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", s.translate(_SPECIAL)) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", bare).casefold()


def key_words(title: str) -> list[str]:
    """The words of a title's key, in Python (the column form is functions.text.title_key)."""
    return list(_key_words(title))


@lru_cache(8192)
def _key_words(title: str) -> tuple[str, ...]:
    # a title is compared with many others, several times each
    plain = re.sub(r"_\s*(?:[⋆★*]|star\b)", " ", title, flags=re.I).replace("_", " ").replace("×", "x")
    key = " ".join(re.findall(r"\w+", fold_text(plain)))
    for pattern, to in (
        (r"\b([mlr]) (?:sub )?(?:sun|solar)\b", r"\1 sun"), (r"\b[lg]sim(\w{0,3}?)(?:[lg]sim)?\b", r"\1"), (r"\b(\w{0,3}?)[lg]sim\b", r"\1"),
        (r"\bapproximately equal to\b", ""), (r"\bpart (?=(?:[ivx]+|\d+)\b)", ""), (r"(?<=[a-z])0(?=[a-z])", "o"), (r"\b(?:lambda ?)+(?=\d)", ""),
    ):
        key = re.sub(pattern, to, key)
    return tuple(key.split())


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine operation a character on whole bit rows."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * common / total length: 1 for equal strings, 0 for strings without a common character."""
    total = len(a) + len(b)
    return 1.0 if not total else 2 * common_length(a, b) / total


def ratio(a: Column, b: Column) -> Column:
    """Indel ratio of two string columns; equal ones need no Python, so keep them in a branch of their own."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y)])

    return run(a, b)


# Numerals, spellings and symbols under which words are the same.
ROMAN = {r: str(n) for n, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}
SYMBOLS = {"sun", "solar", "odot", "earth", "oplus", "jup", "jupiter"}
SYMBOL_SIGNS = {"⊙": " sun ", "☉": " sun ", "⊕": " earth ", "♁": " earth "}
_SPELL = [(re.compile(p.replace(r"[\p{L}\p{N}_]", r"\w")), to.replace("$", "\\")) for p, to in SPELLINGS]


def plain_word(w: str) -> str:
    """One form for the spellings of a word: digits for numerals, American, toward for towards."""
    w = ROMAN.get(w, w)
    if re.fullmatch(r"(?:to|after|back|for|up|down)wards", w):
        w = w[:-1]
    for pattern, to in _SPELL:
        w = pattern.sub(to, w)
    return w


def _benign(mine: list[str], theirs: list[str], before: str | None, last: bool) -> bool:
    """A difference that says nothing about the work: writing, symbols, math, articles, footnote marks."""
    a, b = "".join(mine), "".join(theirs)
    if a == b or (len(mine) == len(theirs) and all(plain_word(x) == plain_word(y) for x, y in zip(mine, theirs))):
        return True
    if sorted(a) == sorted(b) and any(map(str.isdigit, a)) and max(len(mine), len(theirs)) <= 2:
        return True  # an isotope, its mass number first or last
    if not theirs and len(mine) == 1 and mine[0] in SYMBOLS and before is not None and len(before) == 1 and before not in "ai":
        return True
    if last and len(theirs) == 1 and a and len(a) >= 3 and theirs[0][:-1] == a and theirs[0][-1] in "0123456789ab":
        return True
    if not (a + b).isascii() or (len(a) <= 1 and len(b) <= 1):
        return True
    return (not mine or not theirs) and not last and " ".join(mine or theirs) in {"a", "an", "the"}


def changed_words(entry_title: str, record_title: str) -> list[tuple[str, str]]:
    """(entry's words, record's words) at each place where two titles really differ."""
    record_title = re.sub(r"^\W*(?:retracted|withdrawn|retraction|expression of concern)(?: article)?\W*[:.]\s*", "", record_title, flags=re.I)
    sides = []
    for t in (entry_title, record_title):
        for sign, name in SYMBOL_SIGNS.items():
            t = t.replace(sign, name)
        sides.append(key_words(t.replace("&", " and ")))
    ours, theirs = sides
    out = []
    for what, i, j, k, m in difflib.SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes():
        if what != "equal" and not _benign(ours[i:j], theirs[k:m], ours[i - 1] if i else None, j == len(ours) or m == len(theirs)):
            out.append((" ".join(ours[i:j]), " ".join(theirs[k:m])))
    return out


def swapped(a: str, b: str) -> bool:
    """Equal but for two neighbouring letters that changed places."""
    off = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(a) == len(b) and len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]
