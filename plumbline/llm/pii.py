"""Surrogates for personal data and secrets, in DataFrame functions only.

Detection. One pattern finds e-mail addresses (of any script), IPv4 and IPv6
addresses, phone numbers (of North America's form, or international with a
plus sign), card numbers (whole, in fours, or in 4, 6 and 5), bank accounts (IBAN), social security numbers,
access keys, web tokens, private key blocks, bearer tokens, values after words
such as ``password=``, and names after a title. Texts without any character
that an entity needs skip it. Not looked for: names without a title or
after one in capitals, further family names after a name's second word, phone
numbers in national form, hardware addresses, and secrets that are announced
in prose. After a title a second capitalised word is taken for the family name
unless it is a word of the calendar; four numbers with dots are taken for an
address, whatever they number.

Surrogates. An entity's identity is its canonical form: e-mails and names
without case, numbers by their digits, so that two spellings of one number are
one entity. A name has two identities, a family name and, where it has one, a
first name of the title's gender: "Mr. John Smith" and "Mr. Smith" keep one
family. A surrogate is drawn from a keyed hash of kind and identity and laid
into the entity's own format: the same digit groups and separators, valid check
digits of cards and accounts, letters for letters of the same case, a first
name of the title's gender, names in the name's script (those of
``SYLLABLES``; Latin for any other).

Distinctness and coreference. The identities of the whole corpus are gathered
in a table (never at the driver); a surrogate that two identities drew, or
that is itself an identity of the corpus, goes to the least identity only, and
the rest draw again with the next attempt, until all stand alone, in the form
that is laid into texts. Surrogates get longer with the attempts (addresses
leave the private range instead), so rounds end however many entities there
are. So equal entities get equal surrogates in every document, and different
ones differ. The table is joined back by text; only texts that hold entities
are shuffled, and they are searched once.

A null or empty text stays as it is; long texts are searched whole. Repeated
rows get the same text. Further columns are passed on; names that start with
``__pl_`` are reserved. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut

#: Attempts that keep a surrogate's length; every further one makes it longer, so that no corpus fills the space.
SAME_LENGTH = 4
#: Parts of names, by script.
SYLLABLES = {
    "latin": "ba de fi go ka le mi no pa ra se ti va we zo lu".split(),
    "cyrillic": "ба де ги ко ла ме ни по ра се ти ву за жу фо ше".split(),
    "greek": "βα δε γι κο λα με νι πα ρα σε τι φα θε χα ζω λυ".split(),
    "han": list("林陈周吴郑杨朱何高罗梁宋唐许韩冯"),
    "hangul": list("김이박최정강조윤장임한오서신권황"),
    "kana": list("あかさたなはまやらいきしちにみり"),
    "arabic": list("ابتجحدرزسشعفقكلم"),
    "hebrew": list("אבגדהוזחטיכלמנסע"),
}
_SCRIPT = {
    "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}",
    "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}",
}
#: First names by gender and script, for the first draw.
NAMES = {
    ("male", "latin"): "Adam Brian Carlos David Emil Frank Georg Henri Ivan Jonas Karl Louis Marco Nils Oscar Paul".split(),
    ("female", "latin"): "Anna Berta Clara Diana Elena Fiona Greta Helen Ines Julia Karin Laura Maria Nora Olga Paula".split(),
    ("any", "latin"): "Alex Billie Charlie Dana Eden Francis Gale Harper Indigo Jules Kim Lee Morgan Noel Quinn Robin".split(),
    ("male", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Захар Игорь".split(),
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина".split(),
    ("any", "cyrillic"): "Саша Женя Валя Слава".split(),
    ("family", "latin"): "Abel Berg Costa Dietz Evans Faber Grau Hahn Ibarra Jensen Keller Lang Moreau Novak Ortiz Perez".split(),
    ("family", "cyrillic"): "Шевченко Бондаренко Ткач Мельник Дзюба Гриценко Петренко Лысенко".split(),
}
#: Titles and the gender that they tell.
TITLES = {"male": "Mr Herr Monsieur Señor г-н", "female": "Mrs Ms Miss Frau Madame Mme Señora г-жа", "any": "Dr Prof Professor"}

_LOCAL, _HOST = r"[\p{L}\p{N}._%+\-]", r"[\p{L}\p{N}\-]"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+@{_HOST}{{1,63}}(?:\.{_HOST}{{1,63}}){{0,6}}\.\p{{L}}{{2,24}}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around a double colon if the first has a digit, so that code with scopes isn't taken for one.
IPV6 = (
    rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f]{{0,3}}[0-9]){_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}}))"
    r"(?![0-9A-Za-z:])"
)
CARD = r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{4}(?:(?:[ \-][0-9]{4}){3}|[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3,4}[ .\-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+(?=(?:[ .\-/()]{0,2}[0-9]){8,15}(?![ .\-/()]{0,2}[0-9]))[1-9][0-9]{0,2}(?:[ .\-/]?\(?[0-9]{1,12}\)?){1,6}(?![0-9A-Za-z])"
)
#: How published access keys begin.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "AIza")
KEY = rf"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}|(?:{'|'.join(KEY_STARTS[2:])})[A-Za-z0-9_\-]{{20,}}+)(?![A-Za-z0-9])"
JWT = r"(?<![A-Za-z0-9_\-.])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{4,}+(?:\.[A-Za-z0-9_\-]++)?"
_ARMOUR = r"-----{}\x20(?:[A-Z]{{1,12}}\x20){{0,3}}PRIVATE\x20KEY-----"
PEM = _ARMOUR.format("BEGIN") + r"[^\-]*+" + _ARMOUR.format("END")
SECRET_WORD = (
    r"(?i:(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?(?:bearer[ ]{1,2})?|bearer[ ]{1,2}(?=[^\s]{16})(?=[^\s]{0,200}[0-9]))"
)
#: A run up to white space, quotes, brackets or list marks, without the marks that end a sentence.
_STOP = r"\s\"'<>,;&()\[\]{}|"
_RUN = rf"(?:[^{_STOP}.!?:]|[.!?:]+(?![{_STOP}.!?:]|\z))"
#: A value that is of another kind as a whole is of that kind; marks alone are a line to fill in, no secret.
SECRET = (
    SECRET_WORD + rf"(?:{PEM}|(?:{JWT}|{EMAIL}|{KEY}|{IBAN}|{CARD}|{SSN}|{IPV6}|{IP}|{PHONE})(?!{_RUN})"
    rf"|(?=[^{_STOP}]{{0,200}}?[\p{{L}}0-9]){_RUN}{{6,}}+)"
)
WORD = r"(?:\p{Lu}[\p{L}\p{M}'’\-]{1,40}|\p{Lo}{2,12})"
_TITLE = "|".join(sorted((t for v in TITLES.values() for t in v.split()), key=len, reverse=True))
_FIRST = "".join(sorted({t[0] for v in TITLES.values() for t in v.split()}))
#: Words of the calendar, which are written with a capital and are no second part of a name.
CALENDAR = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai Juni Juli Oktober Dezember "
    "Lundi Mardi Mercredi Jeudi Vendredi Samedi Dimanche Janvier Février Mars Avril Juin Juillet Août Septembre Octobre Novembre Décembre "
    "Lunes Martes Miércoles Jueves Viernes Sábado Domingo Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Octubre Noviembre Diciembre"
)
_NO_NAME = "|".join(sorted(set(CALENDAR.split())))
NAME = rf"(?<!\p{{L}})(?=[{_FIRST}])(?:{_TITLE})\.?\x20{WORD}(?:\x20(?!(?:{_NO_NAME})(?![\p{{L}}\p{{M}}'’\-])){WORD})?"
#: In the order in which an entity's kind is told.
KINDS = {
    "pem": PEM, "jwt": JWT, "email": EMAIL, "key": KEY, "iban": IBAN, "card": CARD, "ssn": SSN, "ip": IP, "ipv6": IPV6,
    "phone": PHONE, "name": NAME,
}
ANY = "|".join([PEM, JWT, EMAIL, KEY, SECRET, IBAN, CARD, SSN, IP, IPV6, PHONE, NAME])
#: Cheap test, first: what every entity has one of.
HINT = rf"[0-9@=:]|A[KS]IA|-----BEGIN|eyJ|[_\-][A-Za-z]{{20}}|AIza|[{_FIRST}](?:{'|'.join(sorted({re.escape(t[1:]) for v in TITLES.values() for t in v.split()}))})[. ]"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def value_of(entity: Column) -> Column:
    """The entity without the word that announces it."""
    return F.regexp_replace(entity, f"^{SECRET_WORD}", "")


def kind_of(entity: Column) -> Column:
    """The kind of the entity's value; a value that is no other kind is a secret, so is an announced number of wrong check digit."""
    value = value_of(entity)
    out = F.lit("secret")
    for kind, p in reversed(KINDS.items()):
        whole = F.regexp_extract(value, f"^(?:{p})$", 0) == value
        if kind == "card":
            whole &= (value == entity) | (luhn_sum(_digits(value)) % 10 == 0)
        if kind == "iban":
            whole &= (value == entity) | (mod97(_plain(value)) == 1)
        out = F.when(whole, kind).otherwise(out)
    return out


def _plain(x: Column) -> Column:
    return F.regexp_replace(x, r"\x20", "")


def mod97(account: Column) -> Column:
    """An account number's remainder, its first four characters moved to the end and letters counting from 10."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))
    digits = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda k: F.conv(F.substr(turned, k, F.lit(1)), 36, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: F.pmod(a * F.when(d > 9, 100).otherwise(10) + d, F.lit(97)))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last counted once."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: (
            lambda d: F.when((n - k) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        )(F.substr(digits, k, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def gender_of(title: Column) -> Column:
    out = F.lit("any")
    for gender, titles in TITLES.items():
        out = F.when(title.isin(titles.split()), gender).otherwise(out)
    return out


def name_words(entity: Column) -> Column:
    """A name's words, its title first and without its dot."""
    return F.split(F.regexp_replace(entity, r"\.\x20", " "), " ")


def identity(kind: Column, entity: Column) -> Column:
    """The canonical form of an entity that is no name: what makes two spellings one; null for what is no entity after all."""
    entity = value_of(entity)
    digits = _digits(entity)
    abroad = entity.startswith("+") & ~digits.startswith("1")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "card", F.when(luhn_sum(digits) % 10 == 0, digits))
        .when(kind == "iban", F.when(mod97(_plain(entity)) == 1, _plain(entity)))
        .when(kind == "ssn", digits)
        .when((kind == "phone") & abroad, F.concat(F.lit("+"), digits))
        .when(kind == "phone", F.when(F.length(digits) > 10, F.substr(digits, F.length(digits) - 9, F.lit(10))).otherwise(digits))
        .otherwise(entity)
    )


def identities(kind: Column, entity: Column) -> Column:
    """(kind, who) of each identity: a name's family and first name, one of anything else, none of what is no entity."""
    words = name_words(value_of(entity))
    part = lambda k, w: F.struct(k.alias("kind"), w.alias("who"))
    family = part(F.lit("family"), F.lower(F.element_at(words, -1)))
    given = part(F.concat(F.lit("given "), gender_of(F.element_at(words, 1))), F.lower(F.get(words, F.lit(1))))
    names = F.when(F.size(words) > 2, F.array(family, given)).otherwise(F.array(family))
    one = F.array(part(kind, identity(kind, entity)))
    return F.filter(F.when(kind == "name", names).otherwise(one), lambda p: p["who"].isNotNull())


def _stream(key: str, kind: Column, who: Column, attempt: Column) -> Column:
    """128 hex digits of the keyed hash; longer entities repeat them shifted by their own length."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, who, attempt.cast("string")).cast("binary"), 512)


def _number(stream: Column, at: Column | int, width: int = 4) -> Column:
    """A number of ``width`` hex digits at place ``at`` (from 0), going round."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(stream, (at * width) % (128 - width) + 1, F.lit(width)), 16, 10).cast("int")


def _respell(text: Column, stream: Column, hexed: bool = False) -> Column:
    """Each digit by a digit, each letter by a letter of its case; all else stays."""
    letters = F.lit("abcdef" if hexed else "abcdefghijklmnopqrstuvwxyz")
    size = 6 if hexed else 26

    def one(s, c, k):
        n = _number(s, k + 1, 3)
        letter = F.substr(letters, n % size + 1, F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), (n % 10).cast("string"))
            .when(c.rlike(r"^\p{Lu}$"), F.upper(letter))
            .when(c.rlike(r"^\p{L}$"), letter)
            .otherwise(c)
        )

    characters = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))  # once, so that long secrets cost no more than their length
    spelt = lambda s: F.array_join(F.transform(characters, lambda c, k: one(s, c, k)), "")
    return F.get(F.transform(F.array(stream), spelt), F.lit(0))  # the stream, a hash of the whole identity, is computed once


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _name(kind: Column, who: Column, stream: Column, attempt: Column) -> Column:
    """A name in the script of ``who``: from the lists at first, then of syllables, one more with each attempt."""
    out = None
    for script in [*_SCRIPT, "latin"]:
        parts = F.transform(F.sequence(F.lit(4), attempt + 5), lambda k: _pick(SYLLABLES[script], _number(stream, k)))  # noqa: B023
        made = F.initcap(F.array_join(parts, ""))
        for name in ("family", "male", "female", "any"):
            if (name, script) in NAMES:
                own = F.when(attempt == 0, _pick(NAMES[name, script], _number(stream, 2))).otherwise(made)
            else:
                own = made
            test = who.rlike(_SCRIPT.get(script, "")) & (kind == ("family" if name == "family" else f"given {name}"))
            out = F.when(test, own) if out is None else out.when(test, own)
    return out


def form(kind: Column, drawn: Column) -> Column:
    """What tells a surrogate from others and from identities: itself, of e-mails and names without case."""
    return F.when((kind == "email") | kind.startswith("family") | kind.startswith("given"), F.lower(drawn)).otherwise(drawn)


def draw(key: str, kind: Column, who: Column, attempt: Column) -> Column:
    """The surrogate of an identity, in canonical form."""
    s = _stream(key, kind, who, attempt)
    local, domain = F.element_at(F.split(who, "@"), 1), F.element_at(F.split(who, "@"), 2)
    host = _stream(key, F.lit("host"), domain, F.lit(0))
    label = F.regexp_replace(F.substring(F.substring_index(domain, ".", 1), 1, 8), "^-+|-+$", "")  # the domain's first label, or its start
    label = F.when(label == "", "x").otherwise(label)
    email = F.concat(_respell(local, s), F.lit("@"), _respell(label, host), F.lit(".example.org"))
    email = F.when(attempt > 0, F.concat(F.substr(s, F.lit(1), 3 + attempt), email)).otherwise(email)
    longer = F.greatest(F.lit(0), attempt - SAME_LENGTH)
    digits = F.translate(F.substr(s, F.lit(1), longer), "abcdef", "012345")
    octets = [(_number(s, k) % 254 + 1).cast("string") for k in range(3)]
    first = F.when(attempt < 2, F.lit("10")).when(
        attempt <= SAME_LENGTH, (_number(s, 4) % 14 + 241).cast("string")
    ).otherwise((_number(s, 4) % 254 + 1).cast("string"))  # private, then reserved, then any
    drawn = _respell(who, s)
    body = F.concat(F.substr(who, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), F.length(who) - 2), digits)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    phone = F.concat((_number(s, 30) % 8 + 2).cast("string"), F.substr(drawn, F.lit(2), F.length(who)), digits)
    abroad = F.concat(F.substr(who, F.lit(1), F.lit(3)), F.substr(drawn, F.lit(4), F.length(who)), digits)
    start = F.regexp_extract(who, f"^(?:{'|'.join(KEY_STARTS)}|eyJ)", 0)
    key_ = F.concat(start, F.substr(drawn, F.length(start) + 1, F.length(who)))
    head, tail = (F.regexp_extract(who, _ARMOUR.format(w), 0) for w in ("BEGIN", "END"))
    inner = F.substr(drawn, F.length(head) + 1, F.length(who) - F.length(head) - F.length(tail))
    rest = F.concat(F.substr(drawn, F.lit(5), F.length(who)), digits)
    account = F.concat(F.substr(who, F.lit(1), F.lit(2)), F.lit("00"), rest)
    account = F.concat(F.substr(who, F.lit(1), F.lit(2)), F.lpad((98 - mod97(account)).cast("string"), 2, "0"), rest)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", first, *octets))
        .when((kind == "ipv6") & (attempt > 2), F.concat_ws(":", *[F.substr(s, F.lit(4 * k + 1), F.lit(4)) for k in range(8)]))
        .when(kind == "ipv6", _respell(who, s, hexed=True))
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "iban", account)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(drawn, F.lit(2), F.length(who)), digits))
        .when((kind == "phone") & who.startswith("+"), abroad)
        .when(kind == "phone", phone)
        .when(kind.isin("key", "jwt"), F.concat(key_, digits))
        .when(kind == "pem", F.concat(head, inner, digits, tail))
        .when((kind == "family") | kind.startswith("given"), _name(kind, who, s, attempt))
        .otherwise(F.concat(F.when(who.rlike("^[0-9a-f]+$"), _respell(who, s, hexed=True)).otherwise(drawn), digits))
    )


def _fill(entity: Column, pattern: str, old: Column, new: Column) -> Column:
    """``new`` in the places of the characters of ``entity`` that match; further ones go to the end."""
    gaps = F.split(entity, pattern, -1)
    own = F.concat(F.substr(old, F.lit(1), F.greatest(F.lit(0), F.size(gaps) - 1 - F.length(new))), new)
    out = F.transform(gaps, lambda g, k: F.concat(F.when(k > 0, F.substr(own, k, F.lit(1))).otherwise(""), g))
    return F.concat(F.array_join(out, ""), F.substr(own, F.size(gaps), F.length(own)))


def lay(kind: Column, entity: Column, who: Column, drawn: Column) -> Column:
    """A canonical surrogate of ``who`` in the format of this spelling of an entity that is no name."""
    before, entity = F.regexp_extract(entity, f"^{SECRET_WORD}", 0), value_of(entity)
    digits = _digits(entity)
    prefix = F.substr(digits, F.lit(1), F.greatest(F.lit(0), F.length(digits) - F.length(_digits(who))))
    numbered = _fill(entity, "[0-9]", F.lit(""), F.concat(prefix, _digits(drawn)))
    laid = F.when(kind.isin("card", "phone", "ssn"), numbered)
    laid = laid.when(kind == "iban", _fill(entity, "[0-9A-Z]", F.lit(""), drawn)).otherwise(drawn)
    return F.concat(before, laid)


def lay_name(entity: Column, family: Column, given: Column) -> Column:
    """Title, first name where the entity has one, and family name; in capitals where they are."""
    before, entity = F.regexp_extract(entity, f"^{SECRET_WORD}", 0), value_of(entity)
    words = name_words(entity)
    cased = lambda w, own: F.when((F.upper(own) == own) & (F.lower(own) != own), F.upper(w)).otherwise(w)
    first = F.when(F.size(words) > 2, F.concat(cased(given, F.get(words, F.lit(1))), F.lit(" "))).otherwise("")
    return F.concat(before, F.regexp_extract(entity, r"^([^\x20]+\x20)", 1), first, cased(family, F.element_at(words, -1)))


def entities(texts: DataFrame, text_col: str) -> DataFrame:
    """Adds __pl_pieces (what stands between entities) and __pl_found (kind, entity, identities)."""
    matches = F.regexp_extract_all(F.col(text_col), F.lit(f"({ANY})"), F.lit(1))
    found = F.transform(
        matches,
        lambda e: (lambda kind: F.struct(kind.alias("kind"), e.alias("entity"), identities(kind, e).alias("ids")))(kind_of(e)),
    )
    return texts.withColumn("__pl_pieces", F.split(F.col(text_col), ANY, -1)).withColumn("__pl_found", found)


def surrogate_table(seen: DataFrame, key: str) -> DataFrame:
    """(kind, who, drawn) for the identities of ``seen`` (kind, who): distinct, and no identity of the corpus."""
    # drawing costs more than reading, so identities are dealt over as many tasks as a shuffle has, however few bytes they are
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = cut(seen.distinct().repartition(parts, "kind", "who"))
    left = real
    done = None
    for attempt in itertools.count():
        drawn = left.withColumn("drawn", draw(key, F.col("kind"), F.col("who"), F.lit(attempt)))
        drawn = drawn.withColumn("form", form(F.col("kind"), F.col("drawn")))
        first = drawn.groupBy("kind", "form").agg(F.min(F.struct("who", "drawn")).alias("least"))
        taken = real.select("kind", F.col("who").alias("form"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", form(F.col("kind"), F.col("drawn")).alias("form")))
        won = cut(first.join(taken, ["kind", "form"], "left_anti").select("kind", "least.who", "least.drawn"))
        done = won if done is None else done.unionByName(won)
        left = cut(left.join(won, ["kind", "who"], "left_anti").repartition(parts, "kind", "who"))
        if left.isEmpty():
            return done


def replace(docs: DataFrame, key: str = "corpus", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with each entity in ``text_col`` replaced by its surrogate."""
    has = F.coalesce(F.when(F.col(text_col).rlike(HINT), F.col(text_col).rlike(ANY)), F.lit(False))
    held, rest = docs.where(has), docs.where(~has)
    held = entities(held, text_col).withColumn("__pl_text", F.md5(F.col(text_col).cast("binary"))).drop(text_col)
    held = cut(held)  # texts with entities, cut into pieces; they are searched once
    each = held.select("__pl_text", F.explode(F.array_distinct(F.flatten("__pl_found.ids"))).alias("e"))
    each = cut(each.select("__pl_text", "e.kind", "e.who").distinct())
    table = surrogate_table(each.select("kind", "who"), key)
    by_text = each.join(table, ["kind", "who"]).groupBy("__pl_text").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "who"), "drawn"))).alias("__pl_map")
    )  # as many entries as one text has entities
    met = held.join(by_text.withColumnRenamed("__pl_text", "__pl_key"), F.col("__pl_text") == F.col("__pl_key"), "left")

    def swap(e):
        drawn = lambda part: F.element_at(F.col("__pl_map"), F.concat_ws("\x1f", part["kind"], part["who"]))
        one, two = F.get(e["ids"], F.lit(0)), F.get(e["ids"], F.lit(1))
        laid = F.when(e["kind"] == "name", lay_name(e["entity"], drawn(one), drawn(two))).otherwise(
            lay(e["kind"], e["entity"], one["who"], drawn(one))
        )
        return F.when((F.size(e["ids"]) > 0) & F.col("__pl_map").isNotNull(), F.coalesce(laid, e["entity"])).otherwise(e["entity"])

    swapped = F.transform("__pl_found", swap)
    glued = F.array_join(
        F.transform(
            F.col("__pl_pieces"), lambda p, k: F.concat(p, F.coalesce(F.get(F.col("__pl_swapped"), k), F.lit("")))
        ),
        "",
    )
    met = met.withColumn("__pl_swapped", swapped).withColumn(text_col, glued)
    return rest.unionByName(met.select(*docs.columns))


def surrogates(docs: DataFrame, key: str = "corpus", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_chars) with surrogates in place."""
    out = replace(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), key, text_col)
    return out.select(id_col, text_col, F.length(text_col).cast("long").alias("n_chars"))
