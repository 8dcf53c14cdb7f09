"""Typed values, units, scores and tolerant JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
NUMBER_WORDS |= {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
# Unit factors to the canonical unit.
UNIT_FACTORS = {("m", "cm"): 100.0, ("mm", "cm"): 0.1, ("inches", "cm"): 2.54, ("rad", "deg"): 57.2958, ("s", "ms"): 1000.0, ("m", "mm"): 1000.0, ("cm", "mm"): 10.0}
# Weight of the section a value was found in; others 0.9.
SECTION_WEIGHTS = {"methods": 1.0, "participants": 1.0, "procedure": 1.0, "abstract": 0.95, "results": 0.85, "discussion": 0.75, "introduction": 0.7}
TRUE_WORDS = ["true", "yes", "1", "on", "enabled"]


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def number_text(value: Column) -> Column:
    """Number words as digits (a leading one too, as in "sixty young adults"), then digits, signs and points only."""
    word = F.lower(F.regexp_extract(value, "^[ ]*([A-Za-z]+)", 1))
    spoken = lookup(NUMBER_WORDS, word).cast("string")
    return F.regexp_replace(F.coalesce(F.when(~value.rlike("[0-9]"), spoken), value), r"[^0-9.\-]", "")


def typed(value: Column, kind: Column) -> Column:
    """value_num, value_str, value_bool and the base confidence of a raw value.

    Integers truncate toward zero; what does not parse keeps its text at confidence 0.5.
    """
    number = number_text(value).try_cast("double")
    numeric = kind.isin("integer", "float")
    num = F.when(kind == "integer", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")).when(kind == "float", number)
    base = F.when(numeric & num.isNull(), 0.5).when(numeric | (kind == "boolean"), 0.85).otherwise(0.75)
    return F.struct(
        num.alias("value_num"),
        F.when(~numeric | num.isNull(), F.trim(value)).alias("value_str"),
        F.when(kind == "boolean", F.lower(F.trim(value)).isin(TRUE_WORDS)).alias("value_bool"),
        base.alias("base"),
    )


def convert(value: Column, unit: Column, canonical: Column) -> Column:
    """Value in the canonical unit; unknown pairs leave it as it is."""
    factor = lookup({f"{a}>{b}": f for (a, b), f in UNIT_FACTORS.items()}, F.concat_ws(">", unit, canonical))
    return value * F.coalesce(factor, F.lit(1.0))


def section_weight(section: Column) -> Column:
    return F.coalesce(lookup(SECTION_WEIGHTS, section), F.lit(0.9))


def pattern_quality(context: Column, unit_pattern: Column, keywords: Column) -> Column:
    """How well the words around a match support it, in [0.5, 1]; 0.7 without context.

    ``unit_pattern`` matches the units of the parameter's family (null: none), ``keywords``
    are the words of its name longer than three characters. Words are bounded by ASCII letters,
    digits and underscores only, and each character is lower-cased to one, as in the SQL.
    """
    c = F.lower(F.replace(context, F.lit("İ"), F.lit("i")))  # else a dot of its own would follow the i
    hits = F.size(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(c, k)))
    score = F.lit(0.6) + F.when(F.coalesce(c.rlike(unit_pattern) if isinstance(unit_pattern, str) else F.regexp_like(c, unit_pattern), F.lit(False)), 0.25).otherwise(0.0)
    score = score + F.when(hits >= 2, 0.2).when(hits == 1, 0.1).otherwise(0.0)
    score = score + F.when(c.rlike(r"(?<!\w)(was|were|is|are|set to|fixed at|consisted of)(?!\w)"), 0.05).otherwise(0.0)
    score = score - F.when(c.rlike(r"(?<!\w)(approximately|about|around|roughly|perhaps|maybe)(?!\w)"), 0.1).otherwise(0.0)
    score = F.when(c.rlike(r"^[ ]*[0-9.]+[ ]*$"), F.least(score, F.lit(0.6))).otherwise(score)
    return F.when(F.coalesce(F.trim(context), F.lit("")) == "", 0.7).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), score)))


def final_confidence(base: Column, quality: Column, section: Column, fallback: Column) -> Column:
    return F.round(base * quality * section_weight(section) * F.when(fallback, 0.8).otherwise(1.0), 6)


def plausible_trials(param: Column, number: Column) -> Column:
    """False for trial and participant counts beyond 10000."""
    return ~(F.lower(param).rlike("trial|participant") & (F.coalesce(number, F.lit(0.0)) > 10000))


def parse_json(text: Column) -> Column:
    """Text of the JSON object in a dirty answer, or null: as it is, fenced, or from first to last brace.

    A byte order mark, doubled braces and trailing commas are repaired.
    """
    plain = F.trim(F.regexp_replace(text, "^﻿", ""))
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?[ \t\r\n]*(\{.*?\}|\[.*?\])[ \t\r\n]*```", 1)
    sliced = json_slice(plain)
    single = F.regexp_replace(F.regexp_replace(sliced, r"^\{\{", "{"), r"\}\}$", "}")
    tries = [plain, fenced, sliced, repair_json(sliced), single, repair_json(single)]
    usable = [F.when(F.try_parse_json(t).isNotNull() & t.rlike(r"^[ \t\r\n]*[\{\[]"), t) for t in tries]
    return F.coalesce(*usable)


def json_slice(text: Column) -> Column:
    """From the first { to the last }; empty without both."""
    a, z = F.instr(text, "{"), F.instr(F.reverse(text), "}")
    return F.when((a > 0) & (z > 0), F.substring(text, a, F.length(text) - z + 2 - a)).otherwise("")


def repair_json(text: Column) -> Column:
    """Trailing commas off; raw line breaks inside strings become blanks."""
    return F.regexp_replace(F.regexp_replace(text, r",[ \t\r\n]*([\}\]])", "$1"), r"[\r\n]+", " ")


LEVELS = {"low": 1, "medium": 2, "high": 3}


def level_rank(level: Column) -> Column:
    """Ordinal of a level; unknown ones are 0."""
    return F.coalesce(lookup(LEVELS, F.lower(level)), F.lit(0))


def level_confidence(*levels: Column) -> Column:
    """Mean of level scores, 0.3, 0.6 or 0.9, unknown ones 0.5."""
    scores = [F.coalesce(lookup({"low": 0.3, "medium": 0.6, "high": 0.9}, F.lower(x)), F.lit(0.5)) for x in levels]
    return sum(scores[1:], scores[0]) / len(scores)


def has_keys(value_map: Column, keys: list[str]) -> Column:
    return F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.array_contains(F.map_keys(value_map), k))
