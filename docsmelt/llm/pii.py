"""Surrogates for personal data, in DataFrame functions only (operator 8).

Detected entities are e-mail addresses, phone numbers, IPv4 addresses, payment card
numbers, social security numbers, IBANs, secrets (long hexadecimal strings, prefixed
keys) and personal names (after a form of address or a phrase that gives a name, or a
listed given name before a capitalised word). The words of a name that is found are
replaced wherever they stand alone in the same text.

A surrogate is a keyed permutation of the entity's canonical form: two halves take turns
in shifting each other's characters within their alphabets, by amounts drawn from a keyed
hash; every character moves on by one; and the turns are taken back. So nothing is its own
surrogate, and as a permutation it never sends different entities of one shape to one
surrogate, while the same entity has the same one everywhere, without a table of entities,
a join or a shuffle. Letters stay letters of their script and kind of sound, digits digits,
signs and case stay, check digits stay right (or wrong), country codes and key prefixes
stay. Words of names are permuted as one set: listed given names along a keyed cycle of the
names of their gender and script, all others among the words that are not listed.
``replace_entities`` checks each text for collisions, ``surrogate_report`` a corpus.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsmelt.llm.common import kept_names

# Given names by gender and script.
GIVEN_NAMES = {
    ("female", "latin"): "Alice Amelia Ana Andrea Anna Anne Barbara Brigitte Camille Carla Carmen Carolina Caroline Catherine Charlotte Chloé Christine Clara Claire Elena Elisabeth Elizabeth Emily Emma Eva Frieda Greta Hannah Heidi Helena Ingrid Isabel Jennifer Jessica Johanna Julia Karin Laura Lena Linda Lucia Margaret Maria Marie Marta Mary Monika Nathalie Olivia Patricia Paula Petra Rachel Rosa Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("male", "latin"): "Alejandro Alexander Andreas Andrew Anthony Antoine Antonio Arthur Benjamin Bernard Brian Carlos Charles Christian Christopher Daniel David Diego Dieter Edward Felix Fernando Francisco Frank Franz François George Gerhard Hans Henri Henry Hugo Jacques James Javier Jean John Jonas Jorge José Joseph Juan Jürgen Karl Kevin Klaus Lars Laurent Lewis Louis Lukas Manuel Mark Markus Martin Matthew Michael Michel Miguel Nicolas Oliver Pablo Patrick Paul Pedro Peter Philippe Pierre Rafael Richard Robert Stefan Stephen Thomas Victor Walter William Wolfgang".split(),
    ("female", "cyrillic"): "Анастасия Анна Валентина Вера Галина Екатерина Елена Ирина Ксения Людмила Мария Наталья Надежда Ольга Светлана Татьяна Юлия".split(),
    ("male", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Сергей".split(),
}
# Forms of address.
ADDRESS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Господин Госпожа".split()
# Phrases after which a name stands.
PHRASES = ["my name is ", "My name is ", "Name: ", "Signed, ", "signed by ", "mein Name ist ", "Mein Name ist ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "меня зовут ", "Меня зовут "]
# Alphabets in which characters move, one for each script and kind.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "0123456789", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
# The same by kind of sound, so that words stay easy to say.
SOUNDS = ["aeiou", "bdgkpt", "lmnr", "cfhjqsvwxyz", "0123456789", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çñ", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ", "йъь", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
HEX = ["abcdef", "0123456789"]
# Country codes are 1 and 7, these of two digits, and others of three.
COUNTRY_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: What is looked for, in the order that wins where two begin together.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,12})",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[.\-])[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}[ .\-]?[0-9](?:[ .\-]?[0-9]{2}){4}(?![0-9])|(?<![0-9+.\-])0[1-9](?:[ .\-][0-9]{2}){4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|gho|AKIA)[_\-]?[A-Za-z0-9]{16,64})(?![A-Za-z0-9])",
}
_ADDRESS = r"(?:" + "|".join(ADDRESS) + r")\.? "
_GIVEN = "(?:" + "|".join(n for names in GIVEN_NAMES.values() for n in names) + ")"
_CAPITAL = r"(?=[A-ZÀ-ÞА-Я])(?<!\p{L})"  # the cheap test first
_PHRASE = "(?:" + "|".join(PHRASES) + ")"
PATTERNS["name"] = rf"{_CAPITAL}(?:{_ADDRESS}{_NAME_WORD}(?: {_NAME_WORD}){{0,2}}|{_GIVEN}(?: {_NAME_WORD}){{1,2}}|(?<={_PHRASE}){_NAME_WORD}(?: {_NAME_WORD}){{0,2}})(?!\p{{Ll}})"

DETECT = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these hold no entity, as each alternative of PATTERNS implies one; the cheap test spares them the patterns.
_GUARD = rf"[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|0[1-9][ .\-][0-9]{{2}}[ .\-]|[A-Z]{{2}}[0-9]{{2}}|@|[0-9a-fA-F]{{32}}|(?:sk|pk|ghp|gho|AKIA)[_\-A-Za-z0-9]{{16}}|{_PHRASE}\p{{Lu}}|{_CAPITAL}(?:{_ADDRESS}|{_GIVEN} )"

_ROUNDS = 4


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it in an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shifted(c: Column, amount: Column, alphabets: list[str]) -> Column:
    out = c
    for letters in reversed(alphabets):
        at = F.instr(F.lit(letters), c)
        moved = F.substring(F.lit(letters), F.pmod(at - 1 + amount, F.lit(len(letters))).cast("int") + 1, F.lit(1))
        out = F.when(at > 0, moved).otherwise(out)
    return out


def permuted(text: Column, key: str, kind: str, alphabets: list[str] = ALPHABETS) -> Column:
    """A keyed permutation of lower-case strings of one length and shape; none with a character of an alphabet stays as it is."""
    each = lambda part, by: F.array_join(F.transform(_chars(part), by), "")

    def shift(part: Column, other: Column, r: Column, sign: int) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other), 256)
        return _bind(seed, lambda h: each(part, lambda c, i: _shifted(c, sign * F.pmod(F.xxhash64(h, i), F.lit(1 << 30)), alphabets)))

    def run(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        begin = F.struct(F.substring(t, F.lit(1), half).alias("a"), F.substring(t, half + 1, F.length(t)).alias("b"))
        rounds = F.array(*[F.lit(r) for r in range(_ROUNDS)])
        turn = lambda s, r: F.struct(s["b"].alias("a"), shift(s["a"], s["b"], r, 1).alias("b"))
        back = lambda s, r: F.struct(shift(s["b"], s["a"], F.lit(_ROUNDS - 1) - r, -1).alias("a"), s["a"].alias("b"))
        on = lambda part: each(part, lambda c: _shifted(c, F.lit(1), alphabets))
        moved = F.aggregate(rounds, begin, turn, lambda s: F.struct(on(s["a"]).alias("a"), on(s["b"]).alias("b")))
        return F.aggregate(rounds, moved, back, lambda s: F.concat(s["a"], s["b"]))

    # a one-character string has an empty half: its amount comes from the key alone
    return _bind(text, run)


def _in_case_of(new: Column, old: Column) -> Column:
    """``new`` with upper case where ``old`` has it."""
    return F.array_join(F.zip_with(_chars(new), _chars(old), lambda n, o: F.when(o != F.lower(o), F.upper(n)).otherwise(n)), "")


def _filled(shape: Column, characters: Column, places: str = "[0-9]") -> Column:
    """``shape`` with what ``places`` matches, in order, replaced by ``characters``."""
    return _bind(F.split(shape, places, -1), lambda parts: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.substring(characters, i + 1, F.lit(1)))), ""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(first: Column) -> Column:
    """The check digit for the first 15 digits of a card number."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(_chars(first), lambda c, i: F.when(i % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _card(value: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        first = permuted(F.substring(d, 1, 15), key, "card")
        # the last digit stays as right or wrong, by as much, as it was
        off = F.substring(d, 16, 1).cast("int") - _luhn(F.substring(d, 1, 15))
        return _bind(first, lambda f: F.concat(f, F.pmod(_luhn(f) + off, F.lit(10)).cast("string")))

    return _filled(value, _bind(_digits(value), run))


def _phone(value: Column, key: str) -> Column:
    """A country code, or a leading zero that stands for it, stays; the digits after it move, so that both forms of a number agree."""
    code = F.length(F.regexp_extract(value, COUNTRY_CODE, 1))
    keep = F.when(F.startswith(value, F.lit("+")), code).when(F.startswith(value, F.lit("0")), 1).otherwise(0)

    def run(d: Column) -> Column:
        return F.concat(F.substring(d, F.lit(1), keep), permuted(F.substring(d, keep + 1, F.length(d)), key, "phone"))

    return _filled(value, _bind(_digits(value), run))


def _iban(value: Column, key: str) -> Column:
    """The country stays, the account moves, check digits stay right, or wrong by as much as they were."""
    code = lambda c: F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c)
    step = lambda a, c: F.pmod(F.when(code(c) > 0, a * 100 + code(c) + 9).otherwise(a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))), F.lit(97))
    right = lambda account, country: 98 - F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), step)

    def run(v: Column) -> Column:
        country, check, old = F.substring(v, 1, 2), F.substring(v, 3, 2), F.substring(v, F.lit(5), F.length(v))

        def join(new: Column) -> Column:
            moved = F.pmod(right(new, country) + check.cast("int") - right(old, country) - 2, F.lit(97)) + 2
            return F.concat(country, F.when(check.cast("int").between(2, 98), F.lpad(moved.cast("string"), 2, "0")).otherwise(check), new)

        return _bind(F.upper(permuted(F.lower(old), key, "iban")), join)

    return _filled(value, _bind(F.replace(value, F.lit(" "), F.lit("")), run), "[A-Z0-9]")


def _ip(value: Column, key: str) -> Column:
    """Halves of two octets take turns modulo 65536."""
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("int")
    begin = F.struct((part(1) * 256 + part(2)).alias("a"), (part(3) * 256 + part(4)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        amount = F.pmod(F.xxhash64(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip"), r.cast("string"), s["b"].cast("string")), 256)), F.lit(65536))
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + amount, F.lit(65536)).cast("int").alias("b"))

    join = lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for h in (s["a"], s["b"]) for x in (F.floor(h / 256), h % 256)])
    return F.aggregate(F.array(*[F.lit(r) for r in range(_ROUNDS)]), begin, turn, join)


def _email(value: Column, key: str) -> Column:
    """Local part and domain move apart, so that addresses of one domain share one; the last label stays."""
    cased = lambda t, kind: _in_case_of(permuted(F.lower(t), key, kind, SOUNDS), t)
    domain = F.split_part(value, F.lit("@"), F.lit(2))
    top = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    return F.concat(cased(F.split_part(value, F.lit("@"), F.lit(1)), "local"), F.lit("@"), cased(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), "domain"), top)


def most_of_one_shape(words: list[str]) -> int:
    """How many of some words have the same kinds of sounds in the same places, at most."""
    shape = lambda w: tuple(next((i for i, a in enumerate(SOUNDS) if c in a), c) for c in w)
    return max(Counter(map(shape, words)).values())


def _name(value: Column, key: str) -> Column:
    """A form of address at the beginning stays; each other word moves, listed given names among their like, others among the unlisted."""
    cycle, listed = [], []
    for (gender, script), names in GIVEN_NAMES.items():
        order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}|{gender}|{script}|{n}".encode()).digest())
        listed += order
        cycle += [F.lit(x) for pair in zip(order, [*order[1:], order[0]]) for x in pair]
    given = F.create_map(*cycle)
    address = F.array(*[F.lit(a) for a in ADDRESS])
    move = lambda w: permuted(w, key, "name", SOUNDS)
    # a word that lands on a listed name moves on; it meets at most all of its shape before one that isn't
    tries = F.array(*[F.lit(0)] * most_of_one_shape(listed))
    unlisted = lambda w: F.aggregate(tries, move(w), lambda at, _: F.when(F.map_contains_key(given, at), move(at)).otherwise(at))

    def word(w: Column, i: Column) -> Column:
        new = _bind(F.lower(w), lambda plain: F.when(F.map_contains_key(given, plain), F.initcap(given[plain])).otherwise(_in_case_of(unlisted(plain), w)))
        return F.when((i == 0) & F.array_contains(address, F.regexp_replace(w, r"\.$", "")), w).otherwise(new)

    return F.array_join(F.transform(F.split(value, " "), word), " ")


def kind_of(value: Column) -> Column:
    """The type of a detected string."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def surrogate(value: Column, key: str) -> Column:
    """The keyed, type-consistent replacement of a detected string."""
    cased = lambda part, kind, alphabets: _in_case_of(permuted(F.lower(part), key, kind, alphabets), part)
    prefix = F.regexp_extract(value, r"^(?:sk|pk|ghp|gho|AKIA)[_\-]?", 0)
    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    by_kind = {
        "email": _email(value, key),
        "ip": _ip(value, key),
        "card": _card(value, key),
        "ssn": _filled(value, permuted(_digits(value), key, "ssn")),
        "phone": _phone(value, key),
        "iban": _iban(value, key),
        "secret": F.when(hexadecimal, cased(value, "hex", HEX)).otherwise(F.concat(prefix, cased(F.substring(value, F.length(prefix) + 1, F.length(value)), "secret", ALPHABETS))),
        "name": _name(value, key),
    }

    def choose(kind: Column) -> Column:
        out = by_kind["name"]
        for k in [k for k in by_kind if k != "name"]:
            out = F.when(kind == k, by_kind[k]).otherwise(out)
        return out

    return _bind(kind_of(value), choose)


def entities(text: Column) -> Column:
    """All detected strings of a text in order; null and clean texts have none."""
    found = F.regexp_extract_all(text, F.lit(DETECT), F.lit(0))
    return F.when(text.rlike(_GUARD), found).otherwise(F.array().cast("array<string>"))


def name_words(found: Column) -> Column:
    """The words of the names among detected strings, without forms of address."""
    names = F.filter(found, lambda v: kind_of(v) == "name")
    address = F.array(*[F.lit(a) for a in ADDRESS])
    words = F.filter(F.flatten(F.transform(names, lambda v: F.split(v, " "))), lambda w: ~F.array_contains(address, F.regexp_replace(w, r"\.$", "")))
    return F.array_distinct(words)


def replace_entities(df: DataFrame, key: str = "docsmelt", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts with every entity, and every later mention of a name's words, replaced by its surrogate.

    Returns ``id_col``, text, n_entities, n_clashes, then ``keep``: one row for each input
    row, null ids and repeated rows included. n_clashes counts the surrogates in a text
    that are entities of the same text themselves (which have surrogates of their own);
    should two entities of a text ever have one surrogate, the query fails. A null text
    stays null, with no entities; empty and clean texts stay as they are. Input columns
    that clash with output names are left out unless named in ``keep``, and then end in
    ``_input``. No Python, no join and no shuffle; one pass in the JVM.
    """
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"), *[df[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    rows = rows.withColumn("_first", entities(F.col("_text")))
    rows = rows.withColumn("_words", F.when(F.size("_first") > 0, name_words(F.col("_first"))))
    # the words are letters and hyphens, which need no escape
    also = F.concat(F.lit(DETECT + r"|(?<!\p{L})(?:"), F.array_join("_words", "|"), F.lit(r")(?!\p{L})"))
    named = F.coalesce(F.size("_words") > 0, F.lit(False))
    rows = rows.withColumn("_found", F.when(named, F.regexp_extract_all("_text", also, F.lit(0))).otherwise(F.col("_first")))
    between = F.when(named, F.split("_text", also, -1)).otherwise(F.split("_text", DETECT, -1))  # one more than entities, for both come of one pattern
    rows = rows.withColumn("_new", F.transform("_found", lambda v: surrogate(v, key)))
    text = F.array_join(F.zip_with(between, F.concat("_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    some, distinct = F.size("_found") > 0, F.size(F.array_distinct("_found")) == F.size(F.array_distinct("_new"))
    checked = F.when(some & ~distinct, F.raise_error(F.lit("two entities of a text have one surrogate"))).when(some, text).otherwise(F.col("_text"))
    return rows.select(
        F.col("_id").alias(id_col),
        checked.cast("string").alias("text"),
        F.size("_found").cast("bigint").alias("n_entities"),
        F.when(some, F.size(F.array_intersect("_new", "_found"))).otherwise(0).cast("bigint").alias("n_clashes"),
        *[F.col(k).alias(c) for k, c in kept_names(keep, [id_col, "text", "n_entities", "n_clashes"]).items()],
    )


def surrogate_report(df: DataFrame, key: str = "docsmelt", text_col: str = "text") -> DataFrame:
    """The collision check: kind, entities, surrogates, clashes.

    Distinct written forms and distinct surrogates of each kind (equal, when none collide),
    and the surrogates that are entities of the corpus themselves.
    """
    found = df.select(F.explode(entities(df[text_col])).alias("value")).groupBy("value").count()
    mapped = found.select(kind_of(F.col("value")).alias("kind"), "value", surrogate(F.col("value"), key).alias("new"))
    real = mapped.select("kind", F.col("value").alias("new")).withColumn("real", F.lit(1))
    return mapped.join(real, ["kind", "new"], "left").groupBy("kind").agg(
        F.count("value").alias("entities"), F.countDistinct("new").alias("surrogates"), F.count("real").alias("clashes")
    )
