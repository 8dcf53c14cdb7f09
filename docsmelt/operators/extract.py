"""Pattern extraction: candidates, fallback library, best value per parameter, derived totals.

Candidates come from one projection over the texts (every pattern a literal, so each is
compiled once) and one explode: no join and no shuffle. The best candidate is a map-side
combined ``min_by`` over a key that is unique per candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsmelt.functions import values
from docsmelt.plans.libraries import Pattern

CANDIDATE = "struct<param:string,kind:string,value_raw:string,pattern_ord:int,match_ord:int,context:string>"


def matches(text: Column, p: Pattern, ordinal: int, ignore_case: bool = True) -> Column:
    """All matches of one pattern as candidate structs, with 50 characters around the first of each value."""
    flags = "(?im)" if ignore_case else ""
    found = F.regexp_extract_all(text, F.lit(flags + p.pattern), F.lit(p.group))

    def candidate(v: Column, i: Column) -> Column:
        at = F.instr(text, v)
        return F.struct(
            F.lit(p.param).alias("param"), F.lit(p.kind).alias("kind"), v.alias("value_raw"), F.lit(ordinal).alias("pattern_ord"), i.cast("int").alias("match_ord"),
            F.substring(text, F.greatest(F.lit(1), at - 50), F.length(v) + 100).alias("context"),
        )

    made = F.transform(found, candidate)
    test = F.contains(F.lower(text), F.lit(p.guard.lower())) if p.guard and ignore_case else F.contains(text, F.lit(p.guard)) if p.guard else None
    return made if test is None else F.when(test, made).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def candidates(docs: DataFrame, library: list[Pattern], scope: list[str], text: str = "text", section: str | None = None, lib: str = "main", ignore_case: bool = True) -> DataFrame:
    """One row for each match: scope columns, section, lib, and the candidate with its typed value and confidence."""
    rows = F.flatten(F.array(*[matches(F.col(text), p, k, ignore_case) for k, p in enumerate(library)]))
    where = F.col(section) if section else F.lit("full_text")
    out = docs.select(*scope, where.alias("section"), F.explode(rows).alias("c")).select(*scope, "section", F.lit(lib).alias("lib"), "c.*")
    return score(out, lib != "main")


def candidates_with_fallback(
    docs: DataFrame, library: list[Pattern], fallback: list[Pattern], scope: list[str], text: str = "text", section: str | None = None, ignore_case: bool = True
) -> DataFrame:
    """``candidates`` of the main library, and of the fallback library for parameters that the main one did not find in the row.

    Both are read in one projection, and what the fallback may add is decided within the
    row: no join, no shuffle, and no text is read twice.
    """
    all_of = lambda lib: F.flatten(F.array(*[matches(F.col(text), p, k, ignore_case) for k, p in enumerate(lib)]))
    plausible = lambda c: values.plausible_trials(c["param"], values.typed(c["value_raw"], c["kind"])["value_num"])
    where = F.col(section) if section else F.lit("full_text")
    rows = docs.select(*scope, where.alias("section"), F.filter(all_of(library), plausible).alias("_main"), all_of(fallback).alias("_short"))
    rows = rows.withColumn("_names", F.transform("_main", lambda c: c["param"]))
    added = F.filter("_short", lambda c: ~F.array_contains("_names", c["param"]))
    tagged = lambda found, lib: F.transform(found, lambda c: F.struct(F.lit(lib).alias("lib"), c.alias("c")))
    out = rows.select(*scope, "section", F.explode(F.concat(tagged(F.col("_main"), "main"), tagged(added, "fallback"))).alias("x"))
    return score(out.select(*scope, "section", "x.lib", "x.c.*"), F.col("lib") != "main")


def score(rows: DataFrame, fallback: bool | Column = False) -> DataFrame:
    """Typed value and confidence of candidates; implausible trial counts go."""
    words = F.filter(F.split("param", "_"), lambda w: F.length(w) > 3)
    unit = F.when(F.col("param").rlike("_deg$|rotation"), r"deg|°").when(F.col("param").rlike("_ms$|delay|interval|duration"), r"\b(ms|s|sec|seconds?|milliseconds?)\b").when(
        F.col("param").rlike("_cm$|size|distance"), r"\b(cm|mm|m|participants|subjects)\b"
    )
    typed = values.typed(F.col("value_raw"), F.col("kind"))
    rows = rows.withColumn("t", typed).where(values.plausible_trials(F.col("param"), F.col("t.value_num")))
    quality = values.pattern_quality(F.col("context"), unit, words)
    conf = values.final_confidence(F.col("t.base"), quality, F.col("section"), fallback if isinstance(fallback, Column) else F.lit(fallback))
    return rows.select("*", "t.value_num", "t.value_str", "t.value_bool", conf.alias("confidence"), F.substring("context", 1, 200).alias("evidence")).drop("t", "context")


def with_fallback(main: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of the fallback library only where the main one has none for the key."""
    found = main.select(*keys).distinct()
    return main.unionByName(fallback.join(found, keys, "left_anti"), allowMissingColumns=True)


# Sections that come first among candidates of equal confidence.
SECTION_ORDER = {"methods": 0, "participants": 1, "procedure": 2, "apparatus": 3}


def best(rows: DataFrame, keys: list[str], tie: list[str] = ("pattern_ord", "match_ord"), main_first: bool = False) -> DataFrame:
    """The most confident row of each key; ties by section order, then by ``tie``, first wins.

    ``main_first``: rows of the fallback library only for keys without any of the main one,
    also where several rows or sections of the input have one key.
    """
    place = F.coalesce(values.lookup(SECTION_ORDER, F.col("section")), F.lit(9)) if "section" in rows.columns else F.lit(0)
    rest = [c for c in rows.columns if c not in keys]
    late = [(F.col("lib") != "main").alias("late")] if main_first else []
    order = F.struct(*late, (-F.col("confidence")).alias("o0"), place.alias("o1"), *[F.col(t).alias(f"o{i}") for i, t in enumerate(tie, 2)])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def canonical(rows: DataFrame, aliases: dict[str, str], column: str = "param") -> DataFrame:
    """Names to canonical ones, rows with unknown names dropped."""
    plain = F.regexp_replace(F.trim(F.lower(F.col(column))), " ", "_")
    return rows.withColumn(column, values.lookup(aliases, plain)).where(F.col(column).isNotNull())


# How many groups a text that names them has.
GROUPS = {"three": 3, "3": 3, "four": 4, "4": 4}


def group_count(text: Column) -> Column:
    """Groups of a design: both numbers of levels multiplied for "2 x 3 factorial" (x, times sign, hyphens or "by"), else three or four groups.

    A "2x3 design" counts as factorial too, and any numbers of levels from 2 to 9; sizes
    ("2x2 cm") and other numbers of groups don't count.
    """
    crossed = r"(?i)(?<![0-9.])([2-9])\s*(?:[x×]|-?\s*by\s*-?|-)\s*([2-9])[\s-]+(?:factorial|(?:between-subjects? |within-subjects? |mixed )?design)\b"
    level = lambda i: F.regexp_extract(text, crossed, i).try_cast("int")
    named = F.lower(F.regexp_extract(text, r"(?i)\b(three|four|3|4)\s+(?:experimental\s+)?groups\b", 1))
    return F.coalesce(level(1) * level(2), values.lookup(GROUPS, named))


def derived_totals(wide: DataFrame, text: str = "text") -> DataFrame:
    """Total sample size from the size per group and the number of groups.

    ``wide`` has n_total, n_total_conf, sample_size_per_group, sample_size_n and a text;
    the total is replaced where it is missing, equals one group, or is below 0.85 confident.
    """
    groups = group_count(F.col(text))
    total = F.col("sample_size_per_group") * groups
    weak = F.col("n_total").isNull() | (F.col("n_total") == F.col("sample_size_per_group")) | (F.coalesce("n_total_conf", F.lit(0.0)) < 0.85)
    use = total.isNotNull() & weak
    return wide.withColumns({
        "n_total": F.when(use, total).otherwise(F.col("n_total")),
        "n_total_conf": F.when(use, 0.95).otherwise(F.col("n_total_conf")),
        "sample_size_n": F.when(use & (F.col("sample_size_n").isNull() | (F.col("sample_size_n") == F.col("sample_size_per_group"))), total).otherwise(F.col("sample_size_n")),
    })
