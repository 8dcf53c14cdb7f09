"""Coverage, batch summaries, status counts and reviews over extracted parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsmelt.functions.values import level_rank, lookup


def coverage(params: DataFrame, scopes: DataFrame, scope: str, param: str = "param", value: str = "value", confidence: str | None = "confidence") -> DataFrame:
    """Per parameter: scopes that have it, of how many, percent, distinct values, mean confidence.

    The total is a scalar subquery.
    """
    aggs = [F.countDistinct(scope).alias("n"), F.countDistinct(F.col(value).cast("string")).alias("distinct_values")]
    if confidence:
        aggs.append(F.round(F.avg(confidence), 6).alias("avg_confidence"))
    total = scopes.select(scope).distinct().agg(F.count("*").alias("total"))
    out = params.groupBy(param).agg(*aggs).withColumn("total", total.scalar())
    return out.withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 6))


def tier(pct: Column) -> Column:
    return F.when(pct >= 80, "high").when(pct >= 50, "medium").when(pct >= 25, "low").otherwise("very_low")


def priority(pct: Column) -> Column:
    """Order of work on a parameter: none found, below 25, below 50, others."""
    return F.when(pct <= 0, "CRITICAL").when(pct < 25, "HIGH").when(pct < 50, "MEDIUM").otherwise("LOW")


def suggestions(cover: DataFrame, all_params: DataFrame, param: str = "param", top: int = 15) -> DataFrame:
    """The least covered parameters, those never found included, at most ``top`` (a report's limit)."""
    rows = all_params.select(param).distinct().join(cover.select(param, "pct"), param, "left").fillna(0.0, ["pct"])
    return rows.withColumn("priority", priority(F.col("pct"))).orderBy("pct", param).limit(top)


def category_average(cover: DataFrame, categories: dict[str, str], param: str = "param") -> DataFrame:
    """Mean coverage of the parameters present in each category."""
    return cover.withColumn("category", F.coalesce(lookup(categories, F.col(param)), F.lit("other"))).groupBy("category").agg(F.count("*").alias("params"), F.round(F.avg("pct"), 6).alias("avg_pct"))


def missing(params: DataFrame, scopes: DataFrame, all_params: DataFrame, scope: str, param: str = "param") -> DataFrame:
    """(scope, parameter) pairs that were not found.

    Each scope is paired with the schema's names, one small array from a scalar subquery;
    found pairs go by an anti join on both keys.
    """
    names = all_params.select(param).distinct().agg(F.array_sort(F.collect_set(param)).alias("names"))
    pairs = scopes.select(scope).distinct().withColumn("names", names.scalar()).select(scope, F.explode("names").alias(param))
    return pairs.join(params.select(scope, param).distinct(), [scope, param], "left_anti")


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: papers, successes, multi-experiment papers, experiments, mean parameters per experiment, unique parameters.

    ``results`` has success, is_multi_experiment, num_experiments, param_counts, all_params.
    """
    ok = F.when(F.col("success"), True)
    named = results.where("success").select(F.explode("all_params").alias("p")).agg(F.countDistinct("p").alias("unique_params"))
    out = results.agg(
        F.count("*").alias("papers"), F.count(ok).alias("successes"), F.round(100.0 * F.count(ok) / F.count("*"), 6).alias("success_pct"),
        F.count(F.when(F.col("success") & F.col("is_multi_experiment"), 1)).alias("multi"), F.sum(F.when(F.col("success"), F.col("num_experiments"))).alias("experiments"),
        F.sum(F.when(F.col("success"), F.aggregate("param_counts", F.lit(0).cast("bigint"), lambda a, x: a + x))).alias("params"),
    )
    return out.withColumn("params_per_experiment", F.round(F.try_divide(F.col("params"), F.col("experiments")), 6)).withColumn("unique_params", named.scalar())


def param_frequency(results: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent parameters of a batch, at most ``top`` (a report's limit)."""
    return results.where("success").select(F.explode(F.array_distinct("all_params")).alias("param")).groupBy("param").count().orderBy(F.desc("count"), "param").limit(top)


def paper_rollup(params: DataFrame, paper: str, experiment: str, param: str) -> DataFrame:
    """Per paper: parameters of each experiment in order, unique parameters, all of them sorted."""
    per = params.groupBy(paper, experiment).agg(F.countDistinct(param).cast("int").alias("n"))
    counts = per.groupBy(paper).agg(F.transform(F.array_sort(F.collect_list(F.struct(experiment, "n"))), lambda x: x["n"]).alias("param_counts"))
    return counts.join(params.groupBy(paper).agg(F.array_sort(F.collect_set(param)).alias("all_params")), paper).withColumn("unique_params", F.size("all_params"))


def histogram(rows: DataFrame, key: str, of: str = "n") -> DataFrame:
    """How many keys have how many rows."""
    return rows.groupBy(key).agg(F.count("*").alias(of)).groupBy(of).agg(F.count("*").alias("keys"))


def status_counts(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("entry_status").agg(F.count("*").alias("n"), F.count(F.when(F.col("conflict_flag"), 1)).alias("conflicts"), F.countDistinct("paper_id").alias("papers"))


def proposal_stats(proposals: DataFrame, least: int = 2) -> DataFrame:
    """Parameters proposed ``least`` times or more: papers, highest levels by rank, mean confidence."""
    g = proposals.groupBy("name").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max(level_rank(F.col("importance"))).alias("importance_rank"),
        F.max(level_rank(F.col("prevalence"))).alias("prevalence_rank"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )
    return g.where(F.col("n") >= least)


def top_bottom(rows: DataFrame, by: str, name: str, k: int = 10) -> DataFrame:
    """The k best and k worst rows (a report's limit), equal values in the order of names."""
    best = rows.orderBy(F.desc(by), name).limit(k).withColumn("side", F.lit("top"))
    return best.unionByName(rows.orderBy(by, name).limit(k).withColumn("side", F.lit("bottom")))
