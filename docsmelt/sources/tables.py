"""Interchange files: batch results, gold tables, configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsmelt.functions.text import squeeze
from docsmelt.sources.code import parse_yaml

PARAM = "struct<value:string,confidence:double,source_name:string,method:string,section:string,evidence:string,source_type:string,llm_model:string,llm_provider:string>"
EXPERIMENT = f"struct<experiment_number:int,experiment_title:string,parameters:map<string,{PARAM}>>"
BATCH = f"paper_name string, success boolean, error string, is_multi_experiment boolean, num_experiments int, param_counts array<int>, unique_params int, all_params array<string>, extraction_result struct<is_multi_experiment:boolean,num_experiments:int,parameters:map<string,{PARAM}>,experiments:array<{EXPERIMENT}>,shared_parameters:map<string,{PARAM}>>"


def read_batch_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Papers of a batch, from a JSON array, or from JSON lines, which any number of tasks can read."""
    return spark.read.schema(BATCH).json(path, multiLine=not lines)


def batch_params(results: DataFrame) -> DataFrame:
    """paper_name, experiment (from 1), param and its fields, of successful papers; the flat form is one experiment."""
    r = F.col("extraction_result")
    alone = F.array(F.struct(F.lit(1).alias("experiment_number"), F.lit(None).cast("string").alias("experiment_title"), r["parameters"].alias("parameters")))
    each = results.where("success").select("paper_name", F.posexplode(F.coalesce(r["experiments"], alone)).alias("i", "e"))
    return each.select("paper_name", (F.col("i") + 1).alias("experiment"), F.explode("e.parameters").alias("param", "p")).select("paper_name", "experiment", "param", "p.*")


def read_gold(spark: SparkSession, path: str, key: str = "study_id") -> DataFrame:
    """A gold CSV with header, quoted line breaks, cells stripped, blanks null, rows without key dropped, last row of a key kept."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    clean = raw.select(*[F.nullif(squeeze(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns]).where(f"{key} is not null")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_ord")))
    return clean.withColumn("_ord", F.monotonically_increasing_id()).withColumn("_rn", last).where("_rn = 1").drop("_ord", "_rn")


def unpivot_gold(gold: DataFrame, key: str = "study_id") -> DataFrame:
    """(study_id, param, value) of all other columns."""
    return gold.unpivot([key], [c for c in gold.columns if c != key], "param", "value")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML configuration file (small by nature) from any store that Spark reads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text) if path.endswith(".json") else parse_yaml(text)
