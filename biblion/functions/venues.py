"""Venue names: the canonical venue they mean, their words, and whether two names are related."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblion.functions.text import fold
from biblion.tables import let

# Venues with the names that mean them; the first that fits wins.
VENUES = (
    ("naacl", ("naacl", "north american chapter of the association for computational linguistics")),
    ("eacl", ("eacl", "european chapter of the association for computational linguistics")),
    ("aacl", ("aacl", "asia-pacific chapter of the association for computational linguistics")),
    ("tacl", ("tacl", "transactions of the association for computational linguistics")),
    ("emnlp", ("emnlp", "empirical methods in natural language processing")),
    ("coling", ("coling", "international conference on computational linguistics")),
    ("acl", ("acl", "association for computational linguistics")),
    ("neurips", ("neurips", "nips", "neural information processing systems")),
    ("iclr", ("iclr", "international conference on learning representations")),
    ("icml", ("icml", "international conference on machine learning")),
    ("cvpr", ("cvpr", "computer vision and pattern recognition")),
    ("iccv", ("iccv", "international conference on computer vision")),
    ("eccv", ("eccv", "european conference on computer vision")),
    ("aaai", ("aaai", "national conference on artificial intelligence")),
    ("ijcai", ("ijcai", "international joint conference on artificial intelligence")),
    ("kdd", ("kdd", "sigkdd", "knowledge discovery and data mining", "knowledge discovery in data mining")),
    ("sigir", ("sigir",)),
    ("jmlr", ("jmlr", "journal of machine learning research")),
    ("tpami", ("tpami", "pattern analysis and machine intelligence")),
    ("ijcv", ("ijcv", "international journal of computer vision")),
    ("tmlr", ("tmlr", "transactions on machine learning research")),
    ("aistats", ("aistats", "artificial intelligence and statistics")),
    ("uai", ("uai", "uncertainty in artificial intelligence")),
    ("colt", ("colt", "conference on learning theory", "computational learning theory")),
    ("corl", ("corl", "conference on robot learning")),
    ("colm", ("colm", "conference on language modeling")),
    ("www", ("www", "web conference", "world wide web")),
    ("wsdm", ("wsdm", "web search and data mining")),
    ("cikm", ("cikm", "information and knowledge management")),
    ("icassp", ("icassp", "acoustics speech and signal processing")),
    ("interspeech", ("interspeech",)),
    ("miccai", ("miccai", "medical image computing")),
    ("icra", ("icra", "international conference on robotics and automation")),
    ("iros", ("iros", "intelligent robots and systems")),
    ("wacv", ("wacv", "winter conference on applications of computer vision")),
    ("bmvc", ("bmvc", "british machine vision conference")),
    ("arxiv", ("arxiv", "corr")),
)
# Words that any venue's name may have.
FILLER = tuple(
    "proceedings proc conference conf international intl annual journal transactions trans symposium symp workshop workshops meeting the and for ieee acm cvf advances volume vol part series lecture notes "
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth twenty thirtieth thirty fortieth forty fiftieth fifty sixtieth sixty".split()
)


def venue_text(c: Column) -> Column:
    """A venue's name as lower-case words, links dropped and & read as and."""
    plain = F.replace(F.regexp_replace(c, r"(?i)(?:https?://|www\.)\S+", " "), F.lit("&"), F.lit(" and "))
    return F.array_join(F.regexp_extract_all(fold(plain), F.lit(r"([\p{L}\p{N}_-]+)"), 1), " ")


def _named(name: Column, pattern: tuple[str, ...]) -> Column:
    return name.rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(pattern) + r")(?![\p{L}\p{N}_])")


def canonical(c: Column, venues=VENUES) -> Column:
    """The first venue that a name means; null if it means none."""
    return F.get(all_canonical(c, venues), F.lit(0))


def all_canonical(c: Column, venues=VENUES) -> Column:
    """Every venue that a name means, in the order of the table."""
    return let(venue_text(c), lambda name: F.array_compact(F.array(*[F.when(_named(name, patterns), key) for key, patterns in venues])))


def features(c: Column) -> Column:
    """What comparisons need of a name, computed once per entry or record."""
    return F.struct(c.alias("name"), all_canonical(c).alias("all"), venue_words(c).alias("words"), F.lower(F.regexp_replace(c, r"[^A-Za-z]", "")).alias("letters"))


def venue_words(c: Column) -> Column:
    found = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*FILLER)))


def related(a: Column, b: Column) -> Column:
    """A word of one list begins a word of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: x.startswith(y) | y.startswith(x)))


def initials(c: Column) -> Column:
    return F.array_join(F.transform(venue_words(c), lambda w: F.substring(w, 1, 1)), "")


def venue_core(c: Column) -> Column:
    """A name without years, numbers, ordinals and filler: what catalogues are searched for."""
    return F.array_join(F.filter(F.split(venue_text(F.regexp_replace(c, r"\b(?:19|20)\d\d\b|\b\d+(?:st|nd|rd|th)?\b", " ")), " "), lambda w: (w != "") & ~w.isin(*FILLER)), " ")


def names_year(venue: Column, year: Column) -> Column:
    return F.coalesce(F.array_contains(F.regexp_extract_all(venue, F.lit(r"((?:19|20)\d\d)"), 1), year.cast("string")), F.lit(False))
