"""Conflicts between sources, merging of two extractions, deduplication of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsmelt.functions.text import paper_id
from docsmelt.functions.values import level_rank, lookup

# Sources, most trusted first, and names that other parts use for them.
SOURCES = ["trial_logs", "config_files", "code", "pdf_methods", "llm_inference"]
SOURCE_ALIASES = {"config": "config_files", "json": "config_files", "yaml": "config_files", "python": "code", "pdf": "pdf_methods", "regex": "pdf_methods", "llm": "llm_inference"}
# Parameters with a policy of their own; tolerance in percent.
POLICIES = {"instruction_awareness": ("manual", 5.0), "feedback_delay_ms": ("tolerance", 5.0), "trial_duration_ms": ("tolerance", 10.0), "inter_trial_interval_ms": ("tolerance", 10.0)}


def source_rank(source: Column, order: list[str] = SOURCES) -> Column:
    """Place of a source; unknown ones come last."""
    name = F.coalesce(lookup(SOURCE_ALIASES, source), source)
    return F.coalesce(lookup({s: i for i, s in enumerate(order)}, name), F.lit(len(order)))


def _combined(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of one value, confidence and source as one, dealt by key once; windows and aggregates by key need no other shuffle."""
    once = rows.groupBy(*keys, "value", "confidence", "source_type").agg(F.min("ord").alias("ord"), F.count("*").alias("_rows")).repartition(*keys)
    number = F.col("value").cast("string").try_cast("double")
    return once.withColumns({
        "_rank": source_rank(F.col("source_type"), order), "_number": number,
        "_below": F.lag("confidence").over(Window.partitionBy(*keys).orderBy("confidence", "ord")), "_rows_at": F.sum("_rows").over(Window.partitionBy(*keys, "confidence")),
        "_votes": F.sum("_rows").over(Window.partitionBy(*keys, "value")), "_seen": F.min("ord").over(Window.partitionBy(*keys, "value")),
    })


def _precedence(gap: float) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates over combined rows, and what follows from them."""
    whole = F.struct("value", "confidence", "source_type")
    aggregates = [
        F.min_by(whole, F.struct((-F.col("confidence")).alias("a"), F.col("ord").alias("b"))).alias("_top"),
        F.min_by(whole, F.struct(F.col("_rank").alias("a"), F.col("ord").alias("b"))).alias("_first"),
        F.sum("_rows").alias("n"), F.countDistinct("value").alias("distinct_values"), F.max("confidence").alias("_max"),
        # the second confidence: the largest again where two rows have it, else the largest below
        F.max_by("_rows_at", "confidence").alias("_at_max"), F.max_by("_below", F.struct("confidence", "ord")).alias("_under"),
    ]
    second = F.when(F.col("_at_max") > 1, F.col("_max")).otherwise(F.col("_under"))
    use_top = (F.col("n") == 1) | (F.round(F.col("_max") - second, 9) > gap)
    chosen = F.when(use_top, F.col("_top")).otherwise(F.col("_first"))
    return aggregates, {c: chosen[c] for c in ("value", "confidence", "source_type")}


def by_precedence(rows: DataFrame, keys: list[str], order: list[str] = SOURCES, gap: float = 0.2) -> DataFrame:
    """The most confident row where it leads by more than ``gap``; else the best source's, ties to the smaller ``ord``."""
    aggregates, chosen = _precedence(gap)
    return _combined(rows, keys, order).groupBy(*keys).agg(*aggregates).select(*keys, *[c.alias(n) for n, c in chosen.items()], "n", "distinct_values")


def by_tolerance(rows: DataFrame, keys: list[str], percent: Column) -> DataFrame:
    """Mean of the values where all are numbers within ``percent`` of it; null value otherwise."""
    number = F.col("value").cast("string").try_cast("double")
    agg = rows.groupBy(*keys).agg(F.avg(number).alias("m"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n"), F.count(number).alias("numbers"), F.first(percent).alias("p"))
    within = (F.col("n") == F.col("numbers")) & (F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")) <= F.abs("m") * F.col("p") / 100)
    return agg.select(*keys, F.when(within, F.col("m")).alias("mean"), "n")


def by_consensus(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """The value that most rows have, ``least`` at least; of equal counts the one that came first. Null otherwise."""
    votes = rows.groupBy(*keys, "value").agg(F.count("*").alias("votes"), F.min("ord").alias("first"))
    top = votes.groupBy(*keys).agg(F.min_by(F.struct("value", "votes"), F.struct((-F.col("votes")).alias("a"), F.col("first").alias("b"))).alias("t"))
    return top.select(*keys, F.when(F.col("t.votes") >= least, F.col("t.value")).alias("value"), F.col("t.votes").alias("votes"))


def resolve(rows: DataFrame, scope: list[str], policies: dict[str, tuple[str, float]] = POLICIES, default: str = "precedence", least: int = 2) -> DataFrame:
    """One row for each (scope, param): value, conflict_detected, alternatives, policy.

    Policies: precedence, manual (flagged, no value), tolerance, consensus; unknown names
    mean precedence, and what tolerance or consensus leave open goes to precedence. A
    single value passes through.
    """
    keys = [*scope, "param"]
    policy = F.coalesce(lookup({p: v[0] for p, v in policies.items()}, F.col("param")), F.lit(default)) if policies else F.lit(default)
    percent = F.coalesce(lookup({p: float(v[1]) for p, v in policies.items()}, F.col("param")), F.lit(5.0)) if policies else F.lit(5.0)
    aggregates, chosen = _precedence(0.2)
    vote = F.min_by(F.struct("value", "_votes"), F.struct((-F.col("_votes")).alias("a"), F.col("_seen").alias("b")))
    out = _combined(rows, keys, SOURCES).groupBy(*keys).agg(
        *aggregates, vote.alias("_vote"), F.array_sort(F.collect_set("value")).alias("seen"), F.min("_number").alias("_lo"), F.max("_number").alias("_hi"),
        F.try_divide(F.sum(F.col("_number") * F.col("_rows")), F.sum(F.when(F.col("_number").isNotNull(), F.col("_rows")))).alias("_mean"), F.sum(F.when(F.col("_number").isNull(), F.col("_rows")).otherwise(0)).alias("_words"),
    )
    within = (F.col("_words") == 0) & (F.greatest(F.col("_hi") - F.col("_mean"), F.col("_mean") - F.col("_lo")) <= F.abs("_mean") * percent / 100)
    out = out.select(*keys, "seen", "n", "distinct_values", *[c.alias(n) for n, c in chosen.items()], F.when(within, F.col("_mean")).alias("mean"), F.when(F.col("_vote._votes") >= least, F.col("_vote.value")).alias("vote"))
    out = out.withColumn("policy", policy)
    value = (
        F.when(F.col("n") == 1, F.col("value"))
        .when(F.col("policy") == "manual", F.when(F.col("distinct_values") == 1, F.col("value")))
        .when(F.col("policy") == "tolerance", F.coalesce(F.col("mean").cast("string"), F.col("value")))
        .when(F.col("policy") == "consensus", F.coalesce("vote", "value"))
        .otherwise(F.col("value"))
    )
    out = out.withColumn("value", value)
    return out.select(*keys, "value", "confidence", "source_type", (F.col("distinct_values") > 1).alias("conflict_detected"), F.filter("seen", lambda v: F.coalesce(v != F.col("value"), F.lit(True))).alias("alternatives"), "policy")


def auto_merge(regex: DataFrame, model: DataFrame, keys: list[str], accept: float = 0.7) -> DataFrame:
    """Full outer merge of two extractions with a status for each parameter."""
    r = regex.select(*keys, F.col("value").alias("r_value"), F.col("confidence").alias("r_conf"))
    m = model.select(*keys, F.col("value").alias("m_value"), F.col("confidence").alias("m_conf"))
    j = r.join(m, keys, "full")
    status = (
        F.when(F.col("m_conf").isNull(), "regex_only")
        .when(F.col("r_conf").isNull() & (F.col("m_conf") >= accept), "auto_accepted")
        .when(F.col("r_conf").isNull(), "requires_review")
        .when(F.col("r_value") == F.col("m_value"), "agreed")
        .otherwise("conflict")
    )
    lead = F.round(F.col("m_conf") - F.col("r_conf"), 9) > 0.2  # the model comes last in precedence
    value = F.when(F.col("r_conf").isNull() | ((status == "conflict") & lead), F.col("m_value")).otherwise(F.col("r_value"))
    return j.select(*keys, value.alias("value"), F.greatest("r_conf", "m_conf").alias("confidence"), status.alias("status"))


def dedup(rows: DataFrame, strategy: str = "most_params", name: str = "paper_name", order: str = "ord", params: str = "n_params", success: str = "success") -> DataFrame:
    """One result for each normalised paper name: ``first``, ``last`` or ``most_params`` (failures count none; first of equals)."""
    if strategy not in ("first", "last", "most_params"):
        raise ValueError(f"unknown strategy: {strategy}")
    n = F.when(F.col(success), F.col(params)).otherwise(0) if strategy == "most_params" else F.lit(0)
    key = F.struct((-n).alias("a"), (-F.col(order) if strategy == "last" else F.col(order)).alias("b"))
    return rows.withColumn("paper_key", paper_id(F.col(name))).groupBy("paper_key").agg(F.min_by(F.struct(*rows.columns), key).alias("w"), F.count("*").alias("copies")).select("paper_key", "copies", "w.*")


def weighted_score(source: Column, weights: dict[str, float]) -> Column:
    """Weight of a source under the weighted-average policy; unknown ones weigh nothing."""
    return F.coalesce(lookup(weights, F.coalesce(lookup(SOURCE_ALIASES, source), source)), F.lit(0.0))


def consolidate(proposals: DataFrame) -> DataFrame:
    """Proposals by name: occurrences, first description, most frequent importance and prevalence (first seen of equals), sources."""
    out = proposals.groupBy("name").agg(F.count("*").alias("occurrences"), F.min_by("description", "ord").alias("description"), F.array_sort(F.collect_set("source")).alias("sources"))
    for level in ("importance", "prevalence"):
        votes = proposals.groupBy("name", level).agg(F.count("*").alias("c"), F.min("ord").alias("f"))
        out = out.join(votes.groupBy("name").agg(F.min_by(level, F.struct((-F.col("c")).alias("a"), F.col("f").alias("b"))).alias(level)), "name")
    return out.orderBy(level_rank(F.col("importance")).desc(), level_rank(F.col("prevalence")).desc(), "name")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of both tables, the new one's where a key is in both.

    Of rows of one table with one key, that with the largest ``order`` column stays; without
    one, that with the largest hash of its values, so that the outcome doesn't depend on how
    rows are dealt.
    """
    place = lambda df: F.col(order) if order else F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    both = old.withColumns({"_gen": F.lit(0), "_ord": place(old)}).unionByName(new.withColumns({"_gen": F.lit(1), "_ord": place(new)}), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_gen"), F.desc("_ord")))
    return both.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_gen", "_ord")
