"""Command line: init, extract, validate, export, sync, status, override, discover, coverage, dedup."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from docsmelt.operators import assist, extract, match, report, resolve
from docsmelt.plans import libraries
from docsmelt.session import get_session
from docsmelt.sources import code, files, store, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docsmelt")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "init": ["--database"], "sync": ["output", "--updates"], "discover": ["texts", "output", "--provider"], "extract": ["folder", "--table"], "validate": ["gold", "results"], "export": ["--format", "--output", "--ids"],
        "status": [], "override": ["experiment", "param", "value", "--reason"], "coverage": ["results"], "dedup": ["results", "output", "--strategy"],
    }.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = get_session()
    if a.command == "init":
        store.create_tables(spark, a.database)
    elif a.command == "extract":
        found = files.discover(files.list_files(spark, a.folder), a.folder)
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.folder).join(found.select("path", "kind"), "path")
        texts = texts.select("path", "kind", F.col("content").cast("string").alias("text"))
        merged = code.merge_files(code.file_params(texts, libraries.alias_table()))
        prose = texts.where(F.col("kind").isin("markdown", "txt", "tex"))
        best = extract.best(extract.candidates_with_fallback(prose, libraries.MOTOR_LEARNING, libraries.MOTOR_FALLBACK, ["path"]), ["path", "param"])
        merged.show(100, False)
        best.select("path", "param", "value_raw", "confidence").show(100, False)
        if a.table:
            store.upsert_table(merged, a.table, "name")
    elif a.command == "validate":
        gold = tables.unpivot_gold(tables.read_gold(spark, a.gold))
        auto = tables.batch_params(tables.read_batch_results(spark, a.results)).select(F.col("paper_name").alias("auto_id"), "param", "value")
        wide = gold.groupBy("study_id").pivot("param", ["doi_or_url", "authors", "year"]).agg(F.first("value"))
        ids = auto.select("auto_id").distinct().withColumns({"doi": F.lit(""), "ord": F.xxhash64("auto_id")})
        studies = match.match_studies(wide.select("study_id", F.coalesce("doi_or_url", F.lit("")).alias("doi"), F.regexp_extract("authors", "[A-Za-z]+", 0).alias("author"), "year"), ids)
        labels = match.compare(gold, auto, studies)
        match.metrics(labels).show()
        match.metrics(labels, ["param"]).orderBy(F.desc("f1"), "param").show(100, False)
    elif a.command == "export":
        store.export(spark.table("experiments"), a.output, a.format or "json", a.ids.split(",") if a.ids else None)
    elif a.command == "status":
        report.status_counts(spark.table("experiments")).show()
    elif a.command == "override":
        row = spark.createDataFrame([(a.experiment, a.param, a.value, a.reason)], "experiment_id string, parameter_name string, override_value string, override_reason string")
        store.conform(row.withColumn("override_timestamp", F.current_timestamp()), "manual_overrides").write.mode("append").saveAsTable("manual_overrides")
    elif a.command == "sync":
        experiments = spark.table("experiments")
        if a.updates:
            store.upsert_table(store.apply_status(experiments, spark.read.csv(a.updates, header=True)), "experiments", "id")
        store.review_sheet(spark.table("experiments")).write.mode("overwrite").csv(a.output, header=True)
    elif a.command == "discover":
        docs = spark.read.text(a.texts, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.lit(True).alias("success"))
        docs = assist.discovery_papers(docs, "path")
        ask = docs.withColumn("prompt", F.concat(F.lit("Propose new parameters as JSON (new_parameters) for:\n"), F.substring("text", 1, 15000)))
        found = assist.parse_new(assist.generate(ask.select("path", "prompt"), "prompt", assist.provider(a.provider or "stub"), "discover"), ["path"])
        assist.save_proposals(assist.filter_proposals(found), a.output, "csv" if a.output.endswith(".csv") else "json", a.provider or "stub")
    elif a.command == "coverage":
        params = tables.batch_params(tables.read_batch_results(spark, a.results)).withColumn("scope", F.concat_ws("#", "paper_name", F.col("experiment").cast("string")))
        report.coverage(params, params, "scope").orderBy(F.desc("pct"), "param").show(100, False)
    elif a.command == "dedup":
        rows = tables.read_batch_results(spark, a.results).withColumns({"n_params": F.size("all_params"), "ord": F.monotonically_increasing_id()})
        resolve.dedup(rows, a.strategy or "most_params").write.mode("overwrite").json(a.output)


if __name__ == "__main__":
    main()
