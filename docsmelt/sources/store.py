"""The relational store: schemas, views, upserts, quality assertions and exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsmelt.operators.resolve import upsert

SCHEMAS = {
    "experiments": "id string, name string, description string, parent_experiment_id string, experiment_number int, paper_id string, is_multi_experiment boolean, study_type string, publication_doi string, lab_name string, principal_investigator string, sample_size_n int, age_mean double, age_sd double, handedness_criteria string, equipment_manipulandum_type string, equipment_workspace_width_cm double, equipment_workspace_height_cm double, equipment_mass_inertia_compensation string, equipment_position_sensor_resolution_mm double, equipment_sampling_rate_hz double, counterbalancing_scheme string, trial_exclusion_criteria string, preprocessing_pipeline string, schedule_structure string, outcome_measures string, extracted_params string, provenance_sources string, conflict_flag boolean, entry_status string, extractor_version string, schema_version string, created_at timestamp, updated_at timestamp",
    "sessions": "id string, experiment_id string, session_number int, session_type string, session_date date, duration_minutes double, instruction_text string, instruction_awareness string, context_cues string, familiarization_trials int, block_breaks string, created_at timestamp, updated_at timestamp",
    "blocks": "id string, session_id string, block_number int, block_type string, num_trials int, rotation_magnitude_deg double, rotation_direction string, force_field_strength double, force_field_type string, feedback_type string, feedback_delay_ms double, cursor_visible boolean, cursor_noise_sd_mm double, trial_duration_ms double, inter_trial_interval_ms double, reward_type string, reward_schedule string, motor_noise_model string",
    "trials": "id string, block_id string, trial_number int, rotation_magnitude_deg double, feedback_delay_ms double, cursor_visible boolean, reward_given boolean, trial_onset_time_ms double, trial_duration_ms double, endpoint_error_mm double, movement_time_ms double, peak_velocity_mm_s double, reaction_time_ms double, trial_excluded boolean, exclusion_reason string",
    "provenance": "id bigint, experiment_id string, repo_url string, repo_commit_hash string, file_path string, file_content_hash string, source_type string, extractor_version string, extraction_timestamp timestamp, llm_provider string, llm_model string, llm_temperature double, llm_prompt string, llm_response string, llm_cost_usd double, conflict_detected boolean, conflict_resolution_policy string, alternative_values string",
    "manual_overrides": "id bigint, experiment_id string, parameter_name string, original_value string, override_value string, override_reason string, override_by string, override_timestamp timestamp, approved_by string, approval_timestamp timestamp",
    "proposed_parameters": "id bigint, parameter_name string, description string, category string, evidence string, evidence_location string, example_values string, units string, prevalence string, importance string, mapping_suggestion string, confidence double, proposed_date timestamp, proposed_by string, source_paper_id string, promoted boolean, promoted_date timestamp, reviewer_1 string, reviewer_2 string, review_notes string",
    "llm_inference_provenance": "id bigint, experiment_id string, parameter_name string, inferred_value string, confidence double, evidence string, evidence_location string, reasoning string, llm_provider string, llm_model string, inference_mode string, inference_date timestamp, abstained boolean, requires_review boolean, reviewed boolean, reviewer string, review_date timestamp, review_decision string, review_notes string",
}

VIEWS = {
    # trial values override those of their block where they are set
    "v_full_hierarchy": """
SELECT e.id AS experiment_id, e.name, e.paper_id, s.id AS session_id, s.session_number, b.id AS block_id, b.block_number, b.block_type, t.id AS trial_id, t.trial_number,
  coalesce(t.rotation_magnitude_deg, b.rotation_magnitude_deg) AS rotation_magnitude_deg, coalesce(t.feedback_delay_ms, b.feedback_delay_ms) AS feedback_delay_ms, coalesce(t.cursor_visible, b.cursor_visible) AS cursor_visible
FROM experiments e LEFT JOIN sessions s ON s.experiment_id = e.id LEFT JOIN blocks b ON b.session_id = s.id LEFT JOIN trials t ON t.block_id = b.id""",
    "v_needs_review": "SELECT id, name, paper_id, conflict_flag, created_at FROM experiments WHERE entry_status = 'needs_review' ORDER BY created_at DESC, id",
    "v_multi_experiment_papers": "SELECT paper_id, count(*) AS n, array_join(array_sort(collect_set(id)), ',') AS ids, min(created_at) AS first_created, max(updated_at) AS last_updated FROM experiments WHERE is_multi_experiment GROUP BY paper_id",
    "v_experiment_tree": "SELECT p.id AS parent_id, p.name AS parent_name, c.id AS child_id, c.experiment_number FROM experiments p LEFT JOIN experiments c ON c.parent_experiment_id = p.id WHERE p.is_multi_experiment",
    # the corrected tree: children are no parents
    "v_experiment_tree_roots": "SELECT p.id AS parent_id, p.name AS parent_name, c.id AS child_id, c.experiment_number FROM experiments p LEFT JOIN experiments c ON c.parent_experiment_id = p.id WHERE p.is_multi_experiment AND p.parent_experiment_id IS NULL",
    "v_pending_proposals": "SELECT * FROM proposed_parameters WHERE NOT coalesce(promoted, false) ORDER BY element_at(map('low', 1, 'medium', 2, 'high', 3), importance) DESC, element_at(map('low', 1, 'medium', 2, 'high', 3), prevalence) DESC, confidence DESC, parameter_name, id",
    "v_pending_reviews": "SELECT l.*, e.name AS experiment_name, e.paper_id FROM llm_inference_provenance l JOIN experiments e ON e.id = l.experiment_id WHERE l.requires_review AND NOT coalesce(l.reviewed, false)",
    "v_proposal_stats": """
SELECT parameter_name, count(*) AS n, array_join(array_sort(collect_set(source_paper_id)), ',') AS papers, max(element_at(map('low', 1, 'medium', 2, 'high', 3), importance)) AS importance_rank,
  max(element_at(map('low', 1, 'medium', 2, 'high', 3), prevalence)) AS prevalence_rank, avg(confidence) AS avg_confidence, max(promoted) AS promoted
FROM proposed_parameters GROUP BY parameter_name HAVING count(*) >= 2""",
}

# What the checks of the store allow.
CATEGORIES = ["demographics", "perturbation", "task", "feedback", "instruction", "equipment", "outcome", "other"]
LEVELS = ["low", "medium", "high"]
#: Rows that break a rule: name, table, condition of a broken row.
CHECKS = [
    ("status", "experiments", "entry_status NOT IN ('needs_review', 'validated', 'published')"),
    ("importance", "proposed_parameters", "importance NOT IN ('low', 'medium', 'high')"),
    ("prevalence", "proposed_parameters", "prevalence NOT IN ('low', 'medium', 'high')"),
    ("confidence", "proposed_parameters", "confidence < 0 OR confidence > 1"),
    ("mode", "llm_inference_provenance", "inference_mode NOT IN ('verify', 'fallback')"),
]
REFERENCES = [("sessions", "experiment_id", "experiments"), ("blocks", "session_id", "sessions"), ("trials", "block_id", "blocks"), ("provenance", "experiment_id", "experiments"), ("manual_overrides", "experiment_id", "experiments"), ("llm_inference_provenance", "experiment_id", "experiments")]


def create_tables(spark: SparkSession, database: str | None = None) -> None:
    """Create what is not there: tables, then views. Running it again changes nothing."""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        spark.catalog.setCurrentDatabase(database)
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    for name, query in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")


def create_temp_views(tables: dict[str, DataFrame]) -> None:
    """The store's views over given tables, for a session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    spark = next(iter(tables.values())).sparkSession
    for name, query in VIEWS.items():
        if all(spark.catalog.tableExists(t) for t in SCHEMAS if f" {t} " in f" {query} "):
            spark.sql(query).createOrReplaceTempView(name)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type, missing ones null."""
    schema = StructType.fromDDL(SCHEMAS[table])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def migrate(df: DataFrame, columns: dict[str, str], version: str) -> DataFrame:
    """Add missing columns as nulls and fill the schema version; idempotent."""
    new = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    df = df.withColumns(new) if new else df
    return df.withColumn("schema_version", F.coalesce(F.col("schema_version") if "schema_version" in df.columns else F.lit(None), F.lit(version)))


def upsert_table(new: DataFrame, table: str, key: str, order: str | None = None) -> None:
    """Merge rows into a Parquet table by key; the whole table is written anew, so for large ones use a format with MERGE.

    The merged rows are written beside the table. The old table keeps its rows under
    ``__last`` until the new one has its name, and a table that a stop in between left
    without its name gets it back here first.
    """
    spark = new.sparkSession
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(f"{table}__last"):
        spark.sql(f"ALTER TABLE {table}__last RENAME TO {table}")
    if not spark.catalog.tableExists(table):
        upsert(new.limit(0), new, key, order).write.saveAsTable(table)
        return
    for left in (f"{table}__next", f"{table}__last"):
        spark.sql(f"DROP TABLE IF EXISTS {left}")
    upsert(spark.table(table), new, key, order).write.saveAsTable(f"{table}__next")
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}__last")
    spark.sql(f"ALTER TABLE {table}__next RENAME TO {table}")
    spark.sql(f"DROP TABLE {table}__last")


def append_rows(rows: DataFrame, table: str) -> None:
    """Append rows that conform to the table's schema; rows whose id is there already are left out, so a replay adds nothing."""
    spark = rows.sparkSession
    new = conform(rows, table)
    if spark.catalog.tableExists(table):
        new = new.join(spark.table(table).select("id"), "id", "left_anti").select(*new.columns)
        new.write.insertInto(table)
    else:
        new.write.saveAsTable(table)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """check, table, n: how many rows break each rule or refer to no row."""
    out = [tables[t].where(cond).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.lit(t).alias("table"), "n") for name, t, cond in CHECKS if t in tables]
    for child, column, parent in REFERENCES:
        if child in tables and parent in tables:
            lost = tables[child].where(f"{column} is not null").join(tables[parent].select(F.col("id").alias(column)), column, "left_anti")
            out.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"reference {column}").alias("check"), F.lit(child).alias("table"), "n"))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def experiment_rows(params: DataFrame, keys=("paper_id", "experiment")) -> DataFrame:
    """Rows of ``experiments`` from extracted parameters; the first experiment of a paper is the parent of the rest."""
    rows = params.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "value"))))).alias("extracted_params"), F.avg("confidence").alias("c"), F.count("*").alias("parameter_count"))
    rows = rows.withColumn("id", F.concat(F.col(keys[0]).cast("string"), F.lit("_E"), F.col(keys[1]).cast("string")))
    firsts = rows.groupBy(keys[0]).agg(F.min_by("id", keys[1]).alias("first"), (F.count("*") > 1).alias("is_multi_experiment"))
    status = F.when(F.coalesce("c", F.lit(0.0)) < 0.7, "needs_review").otherwise("validated")
    return rows.join(firsts, keys[0]).select("id", F.col(keys[0]).alias("paper_id"), F.col(keys[1]).alias("experiment_number"), "is_multi_experiment", F.when(F.col("id") != F.col("first"), F.col("first")).alias("parent_experiment_id"), "extracted_params", "parameter_count", status.alias("entry_status"))


REVIEW_COLUMNS = ["id", "name", "paper_id", "study_type", "sample_size_n", "age_mean", "age_sd", "lab_name", "publication_doi", "entry_status", "conflict_flag", "updated_at"]


def export(df: DataFrame, path: str, fmt: str = "json", ids: list[str] | None = None) -> None:
    """Write experiments as json (nested equipment), csv, metalab (json) or psychds (json and its description)."""
    rows = df if ids is None else df.where(F.col("id").isin(ids))
    gear = [c for c in rows.columns if c.startswith("equipment_")]
    if fmt in ("json", "metalab", "psychds"):
        nested = rows.withColumn("equipment", F.struct(*[F.col(c).alias(c[10:]) for c in gear])).drop(*gear) if gear else rows
        nested.write.mode("overwrite").json(f"{path}/data" if fmt == "psychds" else path)
        if fmt == "psychds":
            spark = df.sparkSession
            spark.createDataFrame([("docsmelt experiments", "1.0", "Dataset of extracted experiment parameters")], "name string, schemaVersion string, description string").coalesce(1).write.mode("overwrite").json(f"{path}/dataset_description")
    elif fmt == "csv":
        flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes])
        flat.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown format: {fmt}")


def review_sheet(experiments: DataFrame) -> DataFrame:
    """The rows for review, in the sheet's columns, newest first."""
    return experiments.where("entry_status = 'needs_review'").select(*REVIEW_COLUMNS).orderBy(F.desc("updated_at"), "id")


def apply_status(experiments: DataFrame, updates: DataFrame) -> DataFrame:
    """Experiments with the statuses that came back from a review sheet (id, entry_status)."""
    return experiments.join(updates.select("id", F.col("entry_status").alias("_new")), "id", "left").withColumn("entry_status", F.coalesce("_new", "entry_status")).drop("_new")


def apply_overrides(params: DataFrame, overrides: DataFrame) -> DataFrame:
    """Parameter values with the latest manual override of each (experiment_id, parameter_name)."""
    last = overrides.groupBy("experiment_id", "parameter_name").agg(F.max_by("override_value", F.struct("override_timestamp", "id")).alias("_o"))
    return params.join(last, ["experiment_id", "parameter_name"], "left").withColumns({"value": F.coalesce("_o", "value"), "overridden": F.col("_o").isNotNull()}).drop("_o")


def run_sql(spark: SparkSession, script: str) -> list[DataFrame]:
    """Run the statements of a script in order; a semicolon inside quotes ends none."""
    quoted = r"'(?:[^'\\]|\\.)*'"
    bare = re.sub(rf"({quoted})|--[^\n]*", lambda m: m[1] or "", script)
    statements = re.findall(rf"(?:{quoted}|[^';])+", bare)
    return [spark.sql(s) for s in map(str.strip, statements) if s]


def write_report(parts: dict[str, DataFrame], path: str, spark: SparkSession) -> None:
    """Named results, whole and in their order, as one JSON file of lines: part, row number and the row."""
    out = spark.createDataFrame([], "part string, row int, value string")
    for name, df in parts.items():
        lines = df.select(F.to_json(F.struct("*")).alias("value"), F.monotonically_increasing_id().alias("_at"))
        row = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy("_at")) - 1
        out = out.unionByName(lines.select(F.lit(name).alias("part"), row.alias("row"), "value"))
    out.coalesce(1).write.mode("overwrite").json(path)


def log_usage(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)
