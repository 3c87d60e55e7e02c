"""Operator 2: personal data replaced by keyed surrogates (DataFrame operations only).

One pattern finds e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment cards, bank accounts (IBAN),
national numbers (3-2-4 digits), access keys, private keys, secrets, and names after a form of address or with a
common given name. Card numbers count if they pass the Luhn test. A found entity is taken apart into parts: some stay
(the form of address, "@", the top-level domain, a country code, "password="), the others are mapped. A part's
surrogate comes from SHA-256 over a key, its kind, its canonical form and an attempt number, and keeps the type and
the format: digits give digits, letters give letters of their script and case, octets stay octets, cards keep their
first digit and pass the Luhn test, accounts get right check digits if they had them, names come from lists of the same
gender and script. Equal canonical forms get equal surrogates everywhere (coreference: a family name or a mail
domain is mapped as such), and a collision check makes different ones differ: while two parts of a kind share a
surrogate, or a surrogate is some real part of the corpus, all but the first of them make another attempt. From
attempt LONGER on, surrogates grow by a character each time, so a format with few values never runs out.

Work. One pass over the texts marks the entities and writes the texts; all that follows reads the marks. Entities
of equal texts are found once for the text's digest, and the part table has a row for each distinct part, so a hot
entity or a hot text is pre-aggregated. Only texts with entities are joined; nothing is per pair. Entities and
surrogates are made in many tasks and written in few files.

Edge cases. Null text stays null, with no entity; empty and very long texts are treated alike, the pattern
has no nested repetition. Parts without a letter or digit get letters. Letters of scripts that have no list
here become Latin ones. The noncharacters U+FDD0 to U+FDD3 of a text are kept. Repeated rows each get the same
text. Null doc_ids pass through. An empty table gives an empty result. Further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.llm.shared import stash, table

KEY = "biblion"
#: Attempt from which on surrogates get longer.
LONGER = 5
#: Tasks whose narrow rows go to one file.
TASKS_A_FILE = 16

# Forms of address by gender, and what names are made of.
MALE, FEMALE, NEUTRAL = ("Mr.", "Mister", "Herr", "Monsieur", "Señor", "Sr.", "г-н"), ("Mrs.", "Ms.", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "г-жа"), ("Dr.", "Prof.", "Mx.")
GIVEN = {
    ("latin", "m"): "Adrian Bruno Casper Daniel Edgar Felix Gustav Hugo Ivan Jonas Karl Leon Marco Nils Oscar Pablo Quentin Robert Simon Tomas Ulrich Victor Walter Xavier",
    ("latin", "f"): "Alice Bettina Clara Diana Elena Flora Greta Helena Ines Julia Katrin Laura Marta Nadia Olivia Paula Rosa Sofia Teresa Ursula Vera Wanda Xenia Yvonne",
    ("latin", "n"): "Alex Billie Charlie Dana Eden Francis Gray Harper Indigo Jamie Kim Lou Morgan Noel Paris Quinn Robin Sam Toni Val",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Семён",
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья",
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура Тоня",
    ("greek", "m"): "Αλέξης Βασίλης Γιάννης Δημήτρης Ηλίας Κώστας Λευτέρης Μάνος Νίκος Πέτρος",
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Νίκη Σοφία Χριστίνα",
    ("greek", "n"): "Άγγελος Χάρις Φώτης",
}
FAMILY = {
    "latin": ("Ber Cal Dor Fen Gar Hal Kel Lin Mar Nor Pel Ras Sal Tor Vel Wes", "an ber den el for gan is lo min nor", "der man son ton well wick field ski sen ner"),
    "cyrillic": ("Бор Вас Гор Дан Зим Кол Лав Мор Ник Пет Рог Сав", "ан ен ин ол ор", "ов ев ин енко ский"),
    "greek": ("Αλεξ Γεωρ Δημ Καρ Λαμ Μαρ Νικ Παπ Σταμ", "αν ελ ιν ορ", "άκης όπουλος ίδης άτος"),
}
#: Common given names by gender; with a capitalised word after it, such a name needs no form of address.
COMMON = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Matthew Anthony Steven Andrew Kenneth Kevin Brian George Edward Peter Paul Frank Henry Hans Jürgen Wolfgang Stefan Andreas Pierre Jean François Philippe Carlos José Juan Miguel Antonio Pedro Luis Giovanni Marco Иван Александр Дмитрий Сергей",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Nancy Lisa Betty Sandra Ashley Emily Donna Michelle Carol Amanda Anna Maria Sabine Petra Monika Claudia Marie Catherine Nathalie Isabelle Carmen Dolores Lucía Giulia Francesca Мария Ольга Наталья Татьяна",
}


def _block(first: int, last: int, step: int = 1) -> str:
    return "".join(map(chr, range(first, last + 1, step)))


#: Pattern of a character -> the characters that can stand for it; the first that fits.
ALPHABETS = {
    "[0-9]": "0123456789", "[a-z]": _block(97, 122), "[A-Z]": _block(65, 90), "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-ΩΆ-Ώ]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{IsHan}": _block(0x4E00, 0x9FA0, 32), r"\p{IsHiragana}": _block(0x304B, 0x3062, 2), r"\p{IsKatakana}": _block(0x30AB, 0x30C2, 2),
    r"\p{IsHangul}": _block(0xAC00, 0xD7A0, 28), r"\p{IsArabic}&&\p{L}": _block(0x628, 0x63A), r"\p{IsHebrew}": _block(0x5D0, 0x5EA), r"\p{IsDevanagari}&&\p{L}": _block(0x915, 0x939), r"\p{IsThai}&&\p{L}": _block(0xE01, 0xE2E),
    "[\u0660-\u0669]": _block(0x660, 0x669), "[\u06f0-\u06f9]": _block(0x6F0, 0x6F9), "[\u0966-\u096f]": _block(0x966, 0x96F), "[\uff10-\uff19]": _block(0xFF10, 0xFF19),
    r"\p{Lu}": _block(65, 90), r"\p{L}": _block(97, 122), r"\p{N}": "0123456789",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FORM = "|".join(x.replace(".", r"\.") for x in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))


def _branches(words: list[str]) -> str:
    """A pattern of the words that decides on their first letter first."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_first.items())


_GIVEN = _branches([y for x in (*COMMON["m"].split(), *COMMON["f"].split()) for y in (x, x.upper())])
_SECRET = r"(?i:password|passwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
# To the closing quote or to white space; something in it can be replaced.
_VALUE = "|".join(rf"{before}(?=[^\s{end}]*[0-9\p{{Ll}}\p{{Lu}}])[^\s{end}]{{6,}}+" for before, end in ((r"(?<=\")", r"\""), ("(?<=')", "'"), (r"(?<![\"'])", r"\"'")))
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)*(?<=\.[\p{L}]{2,24})",
    "secret": rf"(?<!\p{{L}}){_SECRET}(?:{_VALUE})",
    "key": r"(?<![\p{L}\p{N}])AKIA[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "hex": r"(?<![\p{L}\p{N}])(?=[0-9]*+[a-fA-F])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){2,6}(?::[0-9a-fA-F]{1,4}){1,5}|(?:[0-9a-fA-F]{1,4}:){1}(?::[0-9a-fA-F]{1,4}){3,6})(?![\p{L}\p{N}:])",
    "national": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\p{L}\p{N}])\d{13,19}(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}})(?:{_FORM})\s(?:\p{{Lu}}[\p{{L}}'’-]{{1,30}})(?: \p{{Lu}}[\p{{L}}'’-]{{1,30}}){{0,2}}",
    "bare": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{_GIVEN}) \p{{Lu}}[\p{{L}}'’-]{{1,30}}+",
}
#: All but addresses begin where no letter is before; that is tested once.
ENTITY = r"(?<!\p{L})(?:" + "|".join(p for kind, p in PATTERNS.items() if kind != "ip") + ")|" + PATTERNS["ip"]
#: Every entity has one of these characters, a form of address or a given name; one scan for them spares many texts the pattern.
HINT = rf"[0-9@=:]|(?=[\p{{Lu}}г])(?<!\p{{L}})(?:(?:{_FORM})\s|(?:{_GIVEN}) \p{{Lu}})|-----BEGIN"
#: Stands before and after an entity; where a text has it itself, it is written as two characters.
MARK, ESCAPED = "\ufdd0", (("\ufdd1", "\ufdd1\ufdd2"), ("\ufdd0", "\ufdd1\ufdd3"))


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        # look-arounds that need the text around it are left out: the entity is all there is
        out = F.when(entity.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _part(kind, canon: Column | None, raw: Column) -> Column:
    return F.struct((F.lit(kind) if not isinstance(kind, Column) else kind).alias("kind"), (F.lit(None).cast("string") if canon is None else canon).alias("canon"), raw.alias("raw"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _one_case(c: Column) -> Column:
    """Hex digits written in capitals throughout are the same number in small letters."""
    return F.when(c.rlike("^[0-9A-F]+$"), F.lower(c)).otherwise(c)


def parts_of(entity: Column, kind: Column) -> Column:
    """array of (kind, canon, raw); parts with a null canon stay as they are."""
    tld = F.regexp_extract(entity, r"\.\p{L}+$", 0)
    host = F.regexp_extract(entity, r"@(.*)\.\p{L}+$", 1)
    email = F.array(_part("mailbox", F.lower(entity), F.substring_index(entity, "@", 1)), _part("glue", None, F.lit("@")), _part("domain", F.lower(host), host), _part("glue", None, tld))
    head = F.regexp_extract(entity, rf"^{_SECRET}", 0)
    value = F.regexp_replace(entity, rf"^{_SECRET}", "")
    secret = F.array(_part("glue", None, head), _part("secret", _one_case(value), value))
    key = F.array(_part("glue", None, F.lit("AKIA")), _part("key", F.substring(entity, 5, 200), F.substring(entity, 5, 200)))
    code = F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.regexp_replace(entity, r"^\+\d{1,3}(?=[ .(-])", "")
    phone = F.array(_part("glue", None, code), _part("phone", _digits(rest), rest))
    form = F.regexp_extract(entity, rf"^(?:{_FORM})\s", 0)
    words = F.split(F.regexp_replace(entity, rf"^(?:{_FORM})\s", ""), " ")
    bare = F.trim(form)
    gender = F.when(bare.isin(*MALE), "given_m").when(bare.isin(*FEMALE), "given_f").otherwise("given_n")
    named = F.flatten(F.transform(words, lambda w, i: F.array(
        _part("glue", None, F.when(i > 0, " ").otherwise("")), _part(F.when(i == F.size(words) - 1, "family").otherwise(gender), F.lower(w), w),
    )))
    name = F.concat(F.array(_part("glue", None, form)), named)
    first, last = F.substring_index(entity, " ", 1), F.substring_index(entity, " ", -1)
    woman = F.initcap(first).isin(*COMMON["f"].split())
    bare = F.array(_part(F.when(woman, "given_f").otherwise("given_m"), F.lower(first), first), _part("glue", None, F.lit(" ")), _part("family", F.lower(last), last))
    begin, end = F.regexp_extract(entity, "^-----BEGIN [A-Z ]{0,30}-----", 0), F.regexp_extract(entity, "-----END [A-Z ]{0,30}-----$", 0)
    body = F.substr(entity, F.length(begin) + 1, F.length(entity) - F.length(begin) - F.length(end))
    pem = F.array(_part("glue", None, begin), _part("pem", body, body), _part("glue", None, end))
    plain = F.array(_part(kind, F.when(kind.isin("card", "national"), _digits(entity)).when(kind == "hex", _one_case(entity)).when(kind == "ipv6", F.lower(entity)).when(kind == "iban", F.replace(entity, F.lit(" "))).otherwise(entity), entity))
    return F.when(kind == "email", email).when(kind == "bare", bare).when(kind == "pem", pem).when(kind == "secret", secret).when(kind == "key", key).when(kind == "phone", phone).when(kind == "name", name).otherwise(plain)


def _number(digest: Column, i: Column) -> Column:
    """A number below 65536 out of the digest, another for each i up to 64."""
    return F.conv(F.substr(digest, (i % 64) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, v: Column) -> Column:
    return F.substr(F.lit(letters), v % len(letters) + 1, F.lit(1))


def _scramble(template: Column, digest: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(ALPHABETS.items()):
            out = F.when(c.rlike(f"^{pattern}$"), _pick(letters, _number(digest, i))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(template, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    doubled = lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x)


def _remainder(account: Column) -> Column:
    """An account number with its first four characters moved to the end, letters as two digits, modulo 97."""
    one = lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), ""), F.lit(0), one)


def _from(words: str, v: Column) -> Column:
    choice = words.split()
    return F.element_at(F.array(*map(F.lit, choice)), v % len(choice) + 1)


def _middle(words: str, digest: Column, attempt: Column):
    return lambda i: F.when(i < attempt, _from(words, _number(digest, i + 2))).otherwise("")


def _name(kind: Column, template: Column, digest: Column, attempt: Column) -> Column:
    script = F.when(template.rlike(r"\p{IsCyrillic}"), "cyrillic").when(template.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = F.lit("")
    for name, (stems, mids, ends) in FAMILY.items():
        # later attempts take longer names, so the choice never runs out
        mid = F.array_join(F.transform(F.sequence(F.lit(0), attempt), _middle(mids, digest, attempt)), "")
        family = F.concat(_from(stems, _number(digest, F.lit(0))), mid, _from(ends, _number(digest, F.lit(1))))
        given = F.lit("")
        for g in "mfn":
            given = F.when(kind == f"given_{g}", F.concat(_from(GIVEN[name, g], _number(digest, F.lit(0))), F.when(attempt > 0, mid).otherwise(""))).otherwise(given)
        out = F.when(script == name, F.when(kind == "family", family).otherwise(given)).otherwise(out)
    return F.lower(out)


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """parts (kind, canon, attempt) with own, the canonical form that stands for canon."""
    kind, canon, attempt, plain = (F.col(c) for c in ("kind", "canon", "attempt", "plain"))
    more = F.greatest(attempt - (LONGER - 1), F.lit(0))
    number = lambda i: _number(F.col("digest"), i)
    # each column is made once: the ones after it name it
    parts = parts.withColumn("seed", F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")))
    parts = parts.withColumn("digest", F.concat(*[F.sha2(F.concat("seed", F.lit(f"|{k}")), 256) for k in range(4)]))
    parts = parts.withColumn("local", F.when(kind == "mailbox", F.substring_index(canon, "@", 1)).otherwise(canon))
    # where nothing can be replaced, letters; from attempt LONGER on some more
    parts = parts.withColumn("local", F.when(F.col("local").rlike(r"[\p{L}\p{N}]"), F.col("local")).otherwise(F.repeat(F.lit("x"), F.greatest(F.length("local"), F.lit(4)))))
    parts = parts.withColumn("local", F.concat("local", F.repeat(F.when(kind.isin("phone", "card", "national", "iban"), "0").otherwise("x"), more)))
    parts = parts.withColumn("plain", _scramble(F.col("local"), F.col("digest")))
    octets = F.transform(F.split(canon, r"\."), lambda o, i: F.when(attempt >= LONGER, number(i) % 256).when(F.length(o) == 1, number(i) % 9 + 1).when(F.length(o) == 2, number(i) % 90 + 10).otherwise(number(i) % 156 + 100).cast("string"))
    groups = F.when(attempt >= LONGER, F.regexp_replace(canon, "[0-9a-f]+", "ffff")).otherwise(canon)
    sixes = F.array_join(F.transform(F.split(groups, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick("123456789abcdef", number(i)))), "")
    hexed = F.array_join(F.transform(F.split(F.concat(canon, F.repeat(F.lit("a"), more)), ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), _pick("0123456789abcdef", number(i))).otherwise(_pick("0123456789ABCDEF", number(i)))), "")
    body = F.concat(F.substring(canon, 1, 1), F.substr(plain, F.lit(2), F.length(plain) - 2))
    parts = parts.withColumn("body", F.when(kind == "card", body).when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.lit("00"), F.substr(plain, F.lit(5)))))
    card = F.concat("body", F.pmod(-_luhn_sum(F.concat("body", F.lit("0"))), F.lit(10)).cast("string"))
    checked = F.concat(F.substring(canon, 1, 2), F.lpad((98 - _remainder(F.col("body"))).cast("string"), 2, "0"), F.substr(plain, F.lit(5)))
    account = F.when(_remainder(canon) == 1, checked).otherwise(F.concat(F.substring(canon, 1, 2), F.substr(plain, F.lit(3))))
    own = (
        F.when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card).when(kind == "ipv6", sixes).when(kind == "iban", account)
        .when(kind.isin("given_m", "given_f", "given_n", "family"), _name(kind, canon, F.col("digest"), attempt))
        .when((kind == "phone") & ~canon.startswith("0"), F.concat(_pick("23456789", number(F.lit(0))), F.substr(plain, F.lit(2))))
        .when(kind.isin("secret", "hex") & canon.rlike("^[0-9a-fA-F]+$"), hexed).otherwise(plain)
    )
    return parts.withColumn("own", own).drop("seed", "digest", "local", "plain", "body")


def _render(kind: Column, raw: Column, own: Column) -> Column:
    """The surrogate own in the format of raw."""
    digit = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(own, F.length(_digits(F.substr(raw, F.lit(1), i))) + 1, F.lit(1))).otherwise(c)
    spaced = lambda c, i: F.when(c == " ", c).otherwise(F.substr(own, F.length(F.replace(F.substr(raw, F.lit(1), i), F.lit(" "))) + 1, F.lit(1)))
    # a longer surrogate goes on after the last digit
    numbers = F.concat(F.array_join(F.transform(F.split(raw, ""), digit), ""), F.substr(own, F.length(_digits(raw)) + 1))
    account = F.concat(F.array_join(F.transform(F.split(raw, ""), spaced), ""), F.substr(own, F.length(F.replace(raw, F.lit(" "))) + 1))
    shout = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1)
    cased = F.when(shout, F.upper(own)).when(F.substring(raw, 1, 1) != F.lower(F.substring(raw, 1, 1)), F.concat(F.upper(F.substring(own, 1, 1)), F.substr(own, F.lit(2), F.length(own)))).otherwise(own)
    capital = kind.isin("secret", "hex") & raw.rlike("^[0-9]*[A-F][0-9A-F]*$") | (kind == "ipv6") & (raw == F.upper(raw))
    return F.when(capital, F.upper(own)).when(kind.isin("phone", "card", "national"), numbers).when(kind == "iban", account).when(kind.isin("mailbox", "domain", "given_m", "given_f", "given_n", "family"), cased).otherwise(own)


def _few(rows: DataFrame, tasks: int, name: str) -> DataFrame:
    """Narrow rows that many tasks have made, in few files: each costs a folder and, on local disks, three processes that an executor forks."""
    return stash(rows.repartition(max(1, tasks // TASKS_A_FILE)), name)


def part_map(parts: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct parts (kind, canon) -> (kind, canon, own), own distinct within a kind and never a real part."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, real, done = parts.distinct().withColumn("attempt", F.lit(0)), None, None
    while True:
        # a number of tasks is named, else few narrow rows would be put together in one, and a surrogate is long work
        tried = _few(surrogates(todo.repartition(tasks, "kind", "canon"), key), tasks, "surrogates")
        real = real or tried.select("kind", F.col("canon").alias("own"))
        taken = real.where("kind <> 'mailbox'").union(real.where("kind = 'mailbox'").select("kind", F.substring_index("own", "@", 1)))
        if done is not None:
            taken = taken.union(done.select("kind", "own"))
        first = tried.groupBy("kind", "own").agg(F.min("canon").alias("first"))
        free = first.join(taken.distinct(), ["kind", "own"], "left_anti")
        ok = F.coalesce(F.col("canon") == F.col("first"), F.lit(False))
        # only those that try again are written, most often few
        todo = stash(tried.join(free, ["kind", "own"], "left").where(~ok).select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "again")
        ended = not todo.limit(1).count()
        good = (tried if ended else tried.join(todo, ["kind", "canon"], "left_anti")).select("kind", "canon", "own")
        done = good if done is None else done.unionByName(good)
        if ended:
            return done


def marked(text: Column) -> Column:
    """The text cut at its entities: pieces with an even index are text between entities, the others are entities."""
    for a, b in ESCAPED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.when(text.rlike(HINT), F.split(F.regexp_replace(text, f"(?:{ENTITY})", f"{MARK}$0{MARK}"), MARK, -1)).otherwise(F.array(text))


def _plain(piece: Column) -> Column:
    for a, b in reversed(ESCAPED):
        piece = F.replace(piece, F.lit(b), F.lit(a))
    return piece


def replace_entities(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities, kinds (sorted, comma-joined)."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(id_col, marked(F.col("text")).alias("pieces")).select(id_col, "pieces", F.when(F.size("pieces") > 1, F.sha2(F.array_join("pieces", MARK), 256)).alias("digest"))
    rows = stash(rows, "pieces")
    clean = rows.where("digest is null").select(id_col, _plain(F.col("pieces")[0]).alias("text"), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    dirty = rows.where("digest is not null")
    found = dirty.select("digest", F.posexplode("pieces").alias("pos", "entity")).where("pos % 2 = 1").distinct()
    # taking an entity apart is long work for a short row, so a number of tasks is named here too
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(tasks, "digest", "pos")
    found = found.withColumn("kind", F.coalesce(kind_of(F.col("entity")), F.lit("hex")))
    found = found.where((F.col("kind") != "card") | (_luhn_sum(_digits(F.col("entity"))) % 10 == 0))
    found = found.select("digest", "pos", F.col("kind").alias("entity_kind"), F.posexplode(parts_of(F.col("entity"), F.col("kind"))).alias("part", "p"))
    found = _few(found.select("digest", "pos", "entity_kind", "part", "p.*"), tasks, "entities")
    own = part_map(found.where("canon is not null").select("kind", "canon"), key)
    said = found.join(own, ["kind", "canon"], "left")
    said = said.withColumn("said", F.when(F.col("canon").isNull(), F.col("raw")).otherwise(_render(F.col("kind"), F.col("raw"), F.col("own"))))
    one = said.groupBy("digest", "pos").agg(F.array_sort(F.collect_list(F.struct("part", "said"))).alias("s"), F.min("entity_kind").alias("entity_kind"))
    one = one.select("digest", "pos", "entity_kind", F.array_join(F.col("s.said"), "").alias("said"))
    text = one.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("pos", "said"))).alias("said"), F.array_join(F.sort_array(F.collect_set("entity_kind")), ",").alias("kinds"))
    woven = F.array_join(F.transform("pieces", lambda x, i: F.coalesce(F.try_element_at("said", i), _plain(x))), "")
    replaced = dirty.join(text, "digest", "left").select(
        id_col, F.when(F.col("said").isNull(), F.array_join(F.transform("pieces", _plain), "")).otherwise(woven).alias("text"),
        F.coalesce(F.size(F.map_keys("said")), F.lit(0)).cast("long").alias("n_entities"), F.coalesce("kinds", F.lit("")).alias("kinds"),
    )
    return clean.unionByName(replaced)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))
