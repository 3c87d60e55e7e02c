"""Text normalisation as column expressions (Catalyst sees through all of them)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that canonical decomposition does not take apart.
SPECIAL = {"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ı": "i"}
# British spellings and their American forms, applied in order.
SPELLINGS = (
    (r"is(e|es|ed|ing|er|ers|ation|ations)$", "iz$1"),
    (r"ys(e|es|ed|ing)$", "yz$1"),
    (r"(?<=[\p{L}\p{N}_]{3})our(s|ed|ing|al|ite|able)?$", "or$1"),
    (r"ll(ed|ing|er|ers)$", "l$1"),
    (r"tre(s?)$", "ter$1"),
    (r"ogue(s?)$", "og$1"),
    (r"(?<=g)ement(s?)$", "ment$1"),
)


# What registries make of symbols in titles (pattern in a folded key, and what it stands for), in order.
REPAIRS = (
    (r"\b([mlr]) (?:sub )?(?:sun|solar)\b", "$1 sun"),
    (r"(?<![\p{L}\p{N}_])[lg]sim([\p{L}\p{N}_]{0,3}?)(?:[lg]sim)?(?![\p{L}\p{N}_])", "$1"),
    (r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]{0,3}?)[lg]sim(?![\p{L}\p{N}_])", "$1"),
    (r"\bapproximately equal to\b", ""),
    (r"\bpart (?=(?:[ivx]+|\d+)\b)", ""),
    (r"(?<=[a-z])0(?=[a-z])", "o"),
    (r"\b(?:lambda ?)+(?=\d)", ""),
)


def _plain_letters() -> tuple[str, str]:
    """Letters with marks and their bare letters, from the Unicode data: Latin, Greek and Cyrillic blocks."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c and c not in SPECIAL:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _plain_letters()
#: Ligatures of presentation forms, and fullwidth ASCII.
_WIDE = {chr(0xFB00 + k): v for k, v in enumerate(("ff", "fi", "fl", "ffi", "ffl"))}
_FULL = ("".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F))))


def deaccent(c: Column) -> Column:
    """Without diacritics, special letters folded, case kept."""
    for a, b in (SPECIAL | _WIDE).items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, _MARKED + _FULL[0], _BARE + _FULL[1])
    return F.regexp_replace(c, r"\p{Mn}", "")


def fold(c: Column) -> Column:
    """deaccent in lower case; Chinese, Japanese and Korean text passes through."""
    return F.lower(deaccent(c))


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def title_key(c: Column) -> Column:
    """Key under which titles compare: folded words joined by single spaces, with known registry damage repaired."""
    c = F.regexp_replace(c, r"(?i)_\s*(?:[⋆★*]|star\b)", " ")
    key = F.array_join(words_of(fold(F.translate(c, "_×", " x"))), " ")
    for pattern, to in REPAIRS:
        key = F.regexp_replace(key, pattern, to)
    return collapse(key)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_count(c: Column) -> Column:
    """Words of a title's key; a word with a Han character counts its characters."""
    words = F.split(title_key(c), " ")
    size = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(w == "", 0).when(w.rlike("[一-鿿]"), F.length(w)).otherwise(1))
    return size.cast("int")


def american(word: Column) -> Column:
    for pattern, to in SPELLINGS:
        word = F.regexp_replace(word, pattern, to)
    return word


def has_han(c: Column) -> Column:
    return c.rlike("[㐀-䶿一-鿿豈-﫿]")


def non_latin(c: Column) -> Column:
    """Under half of the letters are Latin, or there is a Han character."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return has_han(c) | ((letters > 0) & (F.regexp_count(c, F.lit(r"\p{IsLatin}")) < letters * 0.5))


def transliterated(word: Column) -> Column:
    """One spelling for the ways Cyrillic names are romanised."""
    for a, b in (("shch", "sch"), ("kh", "h"), ("zh", "j"), ("ts", "c"), ("yu", "iu"), ("ya", "ia"), ("ye", "e"), ("yo", "e"), ("ij$", "y"), ("iy$", "y"), ("ii$", "y"), ("ks", "x")):
        word = F.regexp_replace(word, a, b)
    return word


def umlauts(key: Column) -> Column:
    """ae, oe and ue (transcribed umlauts) read as the bare letters, ss stays."""
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("aa", "a")):
        key = F.replace(key, F.lit(a), F.lit(b))
    return key


# Words without weight in a claim.
STOPWORDS = tuple(
    "a an the of in on for to and or with by from as at is are was were be been being this that "
    "these those it its we our they their which who whom such than then there here can may might "
    "also not no but if into over under between using use used based via et al cited work".split()
)
TOKEN = r"([0-9]+(?:[.,][0-9]+)*%?(?![\p{L}\p{N}])|[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*)"


def tokens(c: Column) -> Column:
    """Lower-case words and numbers ("93.5%" is one) without stopwords."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), 1), lambda w: F.lower(w)), lambda w: ~w.isin(*STOPWORDS))


def is_number(token: Column) -> Column:
    return token.rlike(r"^[0-9]+(?:[.,][0-9]+)*%?$")


def clip(c: Column, limit: int) -> Column:
    """At most limit characters, cut at a word's end, with an ellipsis where something went."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit(" ...")))


def inverted_to_text(index: Column) -> Column:
    """map(word -> places) -> the words in the order of their places."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def listing(names: Column, last: str) -> Column:
    """A, B and C."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n < 1, "").when(n == 1, F.element_at(names, 1)).otherwise(F.concat(head, F.lit(f" {last} "), F.element_at(names, -1)))


def claim_kind(c: Column) -> Column:
    """result, method or background, by the claim's own wording."""
    low = F.lower(c)
    return (
        F.when(low.rlike(r"\d+(\.\d+)?\s*%|\b(outperform|improv|achiev|reach|show|found|report|demonstrat|observ)\w*"), "result")
        .when(low.rlike(r"\b(propos|introduc|present|develop|use[sd]?|using|method|algorithm|architecture|dataset|approach|model)\w*"), "method")
        .otherwise("background")
    )


def escape_bibtex(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)([&%$#_])", r"\\$1")


def protect_capitals(c: Column) -> Column:
    """Braces around words with a capital beyond their first letter, or a digit next to one."""
    return F.regexp_replace(c, r"(?<![{\p{L}\p{N}])((?:\p{Ll}|\p{N})*\p{Lu}?[\p{Ll}\p{N}]*\p{Lu}[\p{L}\p{N}]*|\p{Lu}\p{N}+)(?![}\p{L}\p{N}])", r"{$1}")


def unescape_identifier(c: Column) -> Column:
    """An identifier or link without the backslashes and braces that LaTeX wants."""
    return F.trim(F.translate(c, "\\{}", ""))


def bibtex_value(c: Column, identifier: bool = False) -> Column:
    """Plain text as a BibTeX value: no backslashes, braces as brackets, and special characters escaped, but not in
    identifiers, which are read as they are."""
    plain = F.translate(F.replace(c, F.lit("\\"), F.lit(" ")), "{}", "()")
    return plain if identifier else F.regexp_replace(plain, "([&%#_$])", r"\\$1")


def strip_language_mark(title: Column) -> Column:
    """A title without "(in Chinese)" or "[in Chinese]" at its end."""
    return F.trim(F.regexp_replace(title, r"(?i)[\[(]\s*in chinese\s*[\])]\s*$", ""))


def name_in_title(name: Column, title: Column) -> Column:
    """Whether a title has the name that a citation stands after: a name with digits or several capitals as a word of it
    (or its plural), any other only as the title's own name ("Adam: ...", "... (Adam)")."""
    words = F.regexp_extract_all(title, F.lit(r"([\p{L}\p{N}][\p{L}\p{N}-]*)"), 1)
    special = (F.regexp_count(name, F.lit(r"\p{Lu}")) >= 2) | name.rlike(r"\p{N}")
    as_word = F.array_contains(words, name) | F.array_contains(words, F.concat(name, F.lit("s")))
    rest = F.ltrim(F.substr(title, F.length(name) + 1))
    leads = title.startswith(name) & rest.rlike("^[:–—-] ")
    own = leads | F.contains(title, F.concat(F.lit("("), name, F.lit(")")))
    return F.when((F.coalesce(name, F.lit("")) == "") | (F.coalesce(title, F.lit("")) == ""), False).otherwise(F.when(special, as_word).otherwise(own))


def fill(template: Column, values: Column) -> Column:
    """A template with each {name} of the map values put in; names that the map lacks stay as they are."""
    put = lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("")))
    return F.aggregate(F.map_entries(values), template, put)
