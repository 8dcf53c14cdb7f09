"""Queries for the operators whose inputs the driver's tables don't hold as they are.

Texts, files and answers are made of the tables' rows by a stated rule; the oracles state
what must come out of each rule, not how it is found. ``{n}`` is the row's own number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docsmelt.functions import text as tx
from docsmelt.functions import values as vl
from docsmelt.operators import assist, extract, match, report, resolve, retrieve, structure
from docsmelt.plans.libraries import MOTOR_FALLBACK, MOTOR_LEARNING, alias_table
from docsmelt.plans.queries import query, table
from docsmelt.session import scratch_path
from docsmelt.sources import code, files, store, tables


def _cases(column: str, texts: list[str], number: str) -> str:
    """SQL for both engines: the text of the row's turn, with its number put in."""
    turns = " ".join(f"WHEN {i} THEN replace('{t.replace(chr(39), chr(39) * 2)}', '{{n}}', CAST({number} AS STRING))" for i, t in enumerate(texts))
    return f"CASE {column} % {len(texts)} {turns} END".replace("\n", "\\n")


def _expected(column: str, number: str, source: str, rows: list[list[tuple]], names: list[str]) -> str:
    """DuckDB SQL for the rows that each turn's text must give."""
    parts = []
    for i, row in enumerate(rows):
        for values in row:
            made = ", ".join(("NULL" if v is None else f"replace('{v}', '{{n}}', CAST({number} AS VARCHAR))" if isinstance(v, str) else str(v)) + f" AS {n}" for v, n in zip(values, names))
            parts.append(f"SELECT {column}, {made} FROM {source} WHERE {column} % {len(rows)} = {i}")
    return " UNION ALL ".join(parts)


# --- extraction with the domain library ---------------------------------------------------

_REPORTS = [
    ("We recruited {n} healthy participants (mean age 24.5 years).", [("n_total", "{n}"), ("age_mean", "24.5")]),
    ("TRIALS\nSubjects made {n} BASELINE TRIALS, then 240 adaptation trials.", [("baseline_trials", "{n}"), ("adaptation_trials", "240")]),
    ("Cursor feedback was delayed by {n} ms. There were 15 participants per group.", [("feedback_delay_ms", "{n}"), ("sample_size_per_group", "15"), ("n_total", "15"), ("feedback_type", "Cursor")]),
    ("The cursor was rotated by {n}° clockwise; a visual cue was shown.", [("rotation_magnitude_deg", "{n}"), ("rotation_direction", "clockwise"), ("cue_modalities", "visual")]),
    ("by Ann Lee and Bob Ray\nOutcome measures were peak error {n}.", [("authors", "Ann Lee and Bob Ray"), ("outcome_measures", "peak error {n}")]),
    ("{n} people came; nothing else.", [("sample_size_n", "{n}")]),
    ("They were told to aim off by {n}. A force-field perturbation followed.", [("instruction_type", "told"), ("perturbation_type", "force-field"), ("perturbation_class", "force-field")]),
    ("no parameter here", []),
]
_REPORT_TEXT = _cases("p_partkey", [t for t, _ in _REPORTS], "p_size")


@query(_expected("p_partkey", "p_size", "part", [r for _, r in _REPORTS], ["param", "value_raw"]))
def domain_library(spark, sf_dir):
    """The domain library over whole texts, line by line and in any case, then the fallback library for what it did not find."""
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_REPORT_TEXT} text")
    rows = extract.candidates_with_fallback(docs, MOTOR_LEARNING, MOTOR_FALLBACK, ["p_partkey"])
    return extract.best(rows, ["p_partkey", "param"]).select("p_partkey", "param", "value_raw")


_ALIASES = [(" Rot ", "rotation_magnitude_deg"), ("n subjects", "sample_size_n"), ("ITI", "inter_trial_interval_ms"), ("hand preference", "handedness_criteria"), ("n_targets", "number_of_locations"), ("unheard of", None), ("age_mean", "age_mean"), ("ccw", "rotation_direction")]


@query("SELECT * FROM (" + _expected("p_partkey", "p_size", "part", [[(c,)] for _, c in _ALIASES], ["param"]) + ") WHERE param IS NOT NULL")
def canonical_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [a for a, _ in _ALIASES], 'p_size')} param")
    return extract.canonical(rows, alias_table())


# --- sections and experiments --------------------------------------------------------------

_PAPERS = [
    ("Title {n}\n# Abstract\nshort {n}\n## **Participants**\nten people\n### Task\nreach {n}\nResults\nfine\nReferences\n[1] a\n# Appendix A\nmore", [("preamble", "Title {n}"), ("abstract", "short {n}"), ("methods", "reach {n}"), ("results", "fine"), ("references", "[1] a"), ("appendix", "more")]),
    ("#### Results\nno header {n}\n# Conclusion and outlook\nend\nAppendix\nstill the end", [("preamble", "#### Results\nno header {n}"), ("conclusion", "end\nAppendix\nstill the end")]),
    ("Materials and Methods\nA {n}\nDiscussion\nB\nBibliography\nC", [("methods", "A {n}"), ("discussion", "B"), ("references", "C")]),
    ("the results of {n}", [("preamble", "the results of {n}")]),
]


def _lines(expected):
    return [[tuple(v.replace("\n", "|") for v in row) for row in rows] for rows in expected]


@query(_expected("p_partkey", "p_size", "part", _lines([r for _, r in _PAPERS]), ["section", "body"]))
def markdown_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [t for t, _ in _PAPERS], 'p_size')} text")
    return structure.sections(docs, ["p_partkey"], mode="last", markdown=True).select("p_partkey", "section", F.translate("body", "\n", "|").alias("body"))


_REPEATS = [
    ("Abstract\na {n}\nMethods\nb\nExperimental design\nc\nParticipants\nd\nResults\ne\nMethods\nf\nResults\ng", [("abstract", "a {n}"), ("methods", "b|Experimental design|c||f|Results|g"), ("participants", "d"), ("results", "e")]),
    ("1. Introduction\nx {n}\n2.1 Task design\ny\nGeneral Discussion\nz", [("introduction", "x {n}"), ("methods", "y"), ("discussion", "z")]),
]


@query(_expected("p_partkey", "p_size", "part", [r for _, r in _REPEATS], ["section", "body"]))
def merged_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [t for t, _ in _REPEATS], 'p_size')} text")
    return structure.sections(docs, ["p_partkey"], mode="merge").select("p_partkey", "section", F.translate("body", "\n", "|").alias("body"))


_STREAM = [
    ("start {n}\nOur Methods here\na\nThe Results part\nb\nmore on Methods\nc", [("introduction", "start {n}"), ("methods", "c"), ("results", "b")]),
    ("nothing {n}", [("introduction", "nothing {n}")]),
]


@query(_expected("p_partkey", "p_size", "part", [r for _, r in _STREAM], ["section", "body"]))
def line_sections(spark, sf_dir):
    """Headers anywhere in a short line; the last part of a name stays."""
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [t for t, _ in _STREAM], 'p_size')} text")
    return structure.sections(docs, ["p_partkey"], mode="last", default="introduction", place="anywhere").select("p_partkey", "section", F.translate("body", "\n", "|").alias("body"))


_LONG = "x" * 220
_KEYWORDS = [
    ("Volunteers held a robot while the cursor was shown, {n} times in all.\n\nNothing of the kind is in this long paragraph, as we see.", "Volunteers held a robot while the cursor was shown, {n} times in all."),
    ("Each movement of the experiment was of the same kind, {n} in all of them.\n\nshort robot cursor", "Each movement of the experiment was of the same kind, {n} in all of them."),
    ("No such words are in here {n}, however long the paragraph may become.", "M {n}"),
    (_LONG, _LONG),
]


@query(_expected("p_partkey", "p_size", "part", [[(e,)] for _, e in _KEYWORDS], ["methods"]))
def methods_by_keywords(spark, sf_dir):
    """Short Methods sections give way to paragraphs that speak of methods; the fourth text has a long section."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [t for t, _ in _KEYWORDS], 'p_size')} text", f"case when p_partkey % 4 = 3 then '{_LONG}' else concat('M ', cast(p_size as string)) end methods")
    return rows.select("p_partkey", structure.methods_or_keywords(F.col("methods"), F.col("text")).alias("methods"))


_SERIES = "Introduction\nwhy {n}\nParticipants\nall of {n}\nExperiment 1: First of them\nfirst {n}\nExperiment II\nsecond\nMethods\nshared {n}\nResults\nr"


@query(_expected("p_partkey", "p_size", "part", [[(1, "First of them", "Experiment 1: First of them|Methods|shared {n}||first {n}"), (2, "Experiment 2", "Experiment II|second|Methods|shared {n}|Results|r")]], ["number", "title", "body"]))
def experiment_texts(spark, sf_dir):
    """Experiments with the methods that follow the last header put into those that have none."""
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [_SERIES], 'p_size')} text")
    rows = docs.withColumn("shared", structure.shared_methods(F.col("text"), F.instr("text", "Experiment II")))
    parts = structure.experiments(rows, ["p_partkey", "shared"])
    return parts.select("p_partkey", "number", "title", F.translate(structure.experiment_text(F.col("number"), F.col("body"), F.col("shared")), "\n", "|").alias("body"))


@query(_expected("p_partkey", "p_size", "part", [[("shared_introduction", "why {n}"), ("shared_participants", "all of {n}")]], ["section", "body"]))
def shared_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [_SERIES], 'p_size')} text")
    return structure.shared_sections(docs, ["p_partkey"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr('Experiment 1|' || repeat('w', 120) || '|Methods|m', 135) ELSE 'Experiment 1|Methods|m' END AS body FROM part")
def skipped_introductions(spark, sf_dir):
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Experiment 1\n"), F.repeat(F.lit("w"), F.lit(120)), F.lit("\nMethods\nm"))).otherwise(F.lit("Experiment 1\nMethods\nm"))
    return table(spark, sf_dir, "part").select("p_partkey", F.translate(structure.experiment_text(F.lit(1), body, F.lit(None).cast("string")), "\n", "|").alias("body"))


_TABLES = [
    ("Table 1\n| a | b |\n|---|---|\n| {n} | 2 |\n| 3 | 4 |\nend", [("markdown", 2, 2, "Table 1", "a,b", "{n}")]),
    ("x  y  z\n{n}  2  3\n4  5  6\n\ntext", [("plain", 2, 3, None, "x,y,z", "{n}")]),
    ("no table {n}", []),
]


@query(_expected("p_partkey", "p_size", "part", [r for _, r in _TABLES], ["format", "n_rows", "n_cols", "caption", "headers", "first_cell"]))
def text_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', [t for t, _ in _TABLES], 'p_size')} text")
    t = structure.tables(docs, ["p_partkey"]).select("p_partkey", F.explode("tables").alias("t"))
    return t.select("p_partkey", "t.format", "t.n_rows", "t.n_cols", "t.caption", F.array_join("t.headers", ",").alias("headers"), F.col("t.rows")[0][0].alias("first_cell"))


@query("""
WITH g AS (SELECT l_orderkey, x, CASE WHEN x - lag(x) OVER (PARTITION BY l_orderkey // 8 ORDER BY x, l_linenumber) > 50 THEN 1 ELSE 0 END AS s, l_orderkey // 8 AS page, l_linenumber FROM (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 2 * 300 + l_linenumber AS DOUBLE) AS x FROM lineitem)),
c AS (SELECT page, i, count(*) AS n FROM (SELECT page, sum(s) OVER (PARTITION BY page ORDER BY x, l_linenumber ROWS UNBOUNDED PRECEDING) AS i FROM g) GROUP BY ALL)
SELECT page, count(*) FILTER (n >= 3) AS columns, sum(n) >= 10 AND count(*) FILTER (n >= 3) >= 2 AS is_multi_column FROM c GROUP BY page
""")
def column_layout(spark, sf_dir):
    blocks = table(spark, sf_dir, "lineitem").selectExpr("cast(floor(l_orderkey / 8) as bigint) page", "cast(l_suppkey % 2 * 300 + l_linenumber as double) x0")
    return structure.multi_column(blocks, ["page"])


# --- text and value rules -------------------------------------------------------------------


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'task1' WHEN 1 THEN 'task2' WHEN 2 THEN 'regex' ELSE 'task1' END AS source, CASE c_custkey % 4 WHEN 0 THEN 'abrupt' WHEN 1 THEN NULL WHEN 2 THEN 'other' END AS gold,
  CASE WHEN c_custkey % 4 IN (0, 3) THEN 'needs_review' ELSE 'validated' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'Smith2019EXP2' WHEN 1 THEN 'Unknown' || c_custkey || 'EXP1' WHEN 2 THEN 'Lee2020' ELSE 'Unknown' || c_custkey END AS study,
  CASE c_custkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.45 WHEN 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS level, c_custkey % 4 <> 3 AS complete
FROM customer
""")
def row_rules(spark, sf_dir):
    """Source classes, gold values, entry statuses, suggested ids, levels and required keys of made-up rows."""
    turn = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.source_class(turn("llm", "llm", "pdf", "missed"), turn("task1_verify", "discover", "regex", None)).alias("source"),
        tx.gold_value(turn(" Suddenly ", "N/A", "Other", None), {"suddenly": "abrupt"}).alias("gold"), tx.entry_status(turn(0.69, 0.7, 0.95, None).cast("double")).alias("status"),
        tx.suggested_study_id(turn("Smith, J; Lee", None, "Lee", ""), turn("2019", "2018", "2020", None), turn("Exp 2 of x", "EXPERIMENT 1", "none", None), F.col("c_custkey")).alias("study"),
        F.round(vl.level_confidence(turn("high", "low", "medium", "odd"), turn("High", "medium", "?", None)) * turn(1.0, 1.0, 1.2727272727, 1.0).cast("double"), 6).alias("level"),
        vl.has_keys(F.create_map(F.lit("a"), F.lit(1), F.when(F.col("c_custkey") % 4 == 3, "c").otherwise("b"), F.lit(2)), ["a", "b"]).alias("complete"),
    )


@query("""
SELECT doc_id, md5(CASE WHEN length(text) >= 200 THEN 'METHODS:' || chr(10) || text || CASE WHEN length(text) >= 300 THEN chr(10) || chr(10) || 'RESULTS:' || chr(10) || substr(text, 1, 6000) ELSE '' END ELSE text END) AS context,
  md5('Fields: a' || chr(10) || 'Text: ' || substr(text, 1, 15000 - length('Fields: ${fields}' || chr(10) || 'Text: ${context}'))) AS prompt
FROM documents
""")
def contexts_and_prompts(spark, sf_dir):
    """Labelled sections of whole texts as a context, and a prompt with a context cut to its budget."""
    t = F.col("text")
    sections = F.map_from_arrays(F.array(F.lit("methods"), F.lit("results")), F.array(t, F.when(F.length(t) >= 300, t).otherwise(F.lit("short"))))
    prompt = tx.build_prompt("Fields: ${fields}\nText: ${context}", t, 15000, fields=F.lit("a"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.assemble_context(sections, t)).alias("context"), F.md5(prompt).alias("prompt"))


@query("SELECT conv_id, CAST(len(list_filter(l, lambda x: true)) AS INTEGER) AS turns, CAST(list_sum(list_transform(l, lambda t: len(list_filter(regexp_split_to_array(t, '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> '')))) AS BIGINT) AS words FROM (SELECT conv_id, list(text) AS l FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)")
def block_chunks(spark, sf_dir):
    """Turns of a conversation as blocks, joined up to 50 words; no chunk of several blocks has more, and none is lost."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("b"))
    chunks = tx.chunk_blocks(F.transform("b", lambda x: F.struct(x["text"].alias("text"), x["turn"].alias("page"))), 50)
    made = turns.select("conv_id", F.size("b").alias("turns"), chunks.alias("c"))
    fits = F.forall("c", lambda c: (c["words"] <= 50) | F.exists("b", lambda x: x["text"] == c["text"]))
    return made.where(fits).select("conv_id", "turns", F.aggregate("c", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]).alias("words"))


_DIRTY = ['{"a": {n},}', '﻿{"a": {n}}', "no json {n}", '{{"a": {n}}}', 'x {"a": {n}, "b": [1, 2,]} y']


@query(_expected("p_partkey", "p_size", "part", [[("{n}",)], [("{n}",)], [(None,)], [("{n}",)], [("{n}",)]], ["a"]))
def json_repairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_cases('p_partkey', _DIRTY, 'p_size')} t")
    return rows.select("p_partkey", F.get_json_object(vl.parse_json(F.col("t")), "$.a").alias("a"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE CAST(p_size * 400 AS DOUBLE) END AS trials, CAST(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 ELSE 0.9 END AS DOUBLE) AS weight FROM part")
def plausible_counts(spark, sf_dir):
    n = (F.col("p_size") * 400).cast("double")
    section = F.element_at(F.array(*[F.lit(s) for s in ("methods", "results", "shared_methods", "unknown")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(vl.plausible_trials(F.lit("num_trials"), n), n).alias("trials"), vl.section_weight(section).alias("weight"))


# --- sources ----------------------------------------------------------------------------------

_CODE = [
    ("python", "rotation = {n}\nself.iti = 500\nlist = [1]\nn_trials: int = 10\nn_trials = {n}\nother = 3", [("rotation_magnitude_deg", "{n}", "ast"), ("inter_trial_interval_ms", "500", "ast"), ("num_trials", "{n}", "ast")]),
    ("python", "def broken(:\n  vmr = {n}", [("rotation_magnitude_deg", "{n}", "regex")]),
    ("json", '{"task": {"ITI": {n}, "targets": [1, 2]}, "hand": "right"}', [("inter_trial_interval_ms", "{n}", "json"), ("handedness_criteria", "right", "json")]),
    ("yaml", "task:\n  iti: {n}\n  # comment\nreward: money", [("inter_trial_interval_ms", "{n}", "yaml"), ("reward_type", "money", "yaml")]),
    ("json", "{broken {n}", []),
]


@query(_expected("p_partkey", "p_size", "part", [r for *_, r in _CODE], ["name", "value", "method"]))
def code_params(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k, *_ in _CODE]), (F.col("p_partkey") % len(_CODE) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), kind.alias("kind"), F.expr(_cases("p_partkey", [t for _, t, _ in _CODE], "p_size")).alias("text"))
    return code.file_params(rows, alias_table()).select(F.col("path").cast("bigint").alias("p_partkey"), "name", "value", "method")


_SCANS = [
    ("trialDuration = {n};\n% rotationAngle: 30", [("timing", "trialDuration", "{n}"), ("perturbation", "rotationAngle", "30")]),
    ("set_block('washout', {n})\nx = 1", [("block", "set_block", "washout")]),
    ("if rotation == {n}: pass", []),
]


@query(_expected("p_partkey", "p_size", "part", [r for _, r in _SCANS], ["group", "name", "value"]).replace(" AS group", ' AS "group"'))
def code_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(_cases("p_partkey", [t for t, _ in _SCANS], "p_size")).alias("text"))
    return code.code_scan(rows).select(F.col("path").cast("bigint").alias("p_partkey"), "group", "name", "value")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fallback' ELSE 'primary' END AS extraction_method, md5(text) AS digest, sha256(text) AS content_hash FROM documents")
def extracted_texts(spark, sf_dir):
    """Texts of files as bytes; every fifth file breaks the first extractor."""

    def strict(content: bytes) -> str:
        if content[:1] == b"\xff":
            raise ValueError("not text")
        return content.decode()

    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    content = F.encode(F.col("text"), "UTF-8")
    broken = docs.select("path", F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("ff")), content)).otherwise(content).alias("content"))
    found = files.extract_text(broken, strict, lambda b: b[1:].decode())
    return found.join(docs.select("path", "doc_id", content.alias("c")), "path").select("doc_id", "extraction_method", F.md5("full_text").alias("digest"), files.content_hash(F.col("c")).alias("content_hash"))


@query("SELECT page_id, page_id % 3 <> 0 AS fresh FROM pages WHERE page_id % 3 <> 0 OR page_id % 2 = 0")
def cached_files(spark, sf_dir):
    """Files to read again, and cached rows that hold: a third of the cache is of this version, half of that file's mode."""
    listing = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.lit(5).alias("modificationTime"))
    listing = listing.withColumn("path", F.concat("path", F.lit("#"), F.col("page_id").cast("string")))
    cache = listing.where("page_id % 3 = 0").withColumn("mode", F.when(F.col("page_id") % 2 == 0, "default").otherwise("other"))
    new, held = files.uncached(listing.where("page_id % 3 <> 0 or page_id % 2 = 0"), cache)
    return new.select("page_id", F.lit(True).alias("fresh")).unionByName(held.select("page_id", F.lit(False).alias("fresh")))


@query("SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS words FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS w FROM conversations) GROUP BY ALL")
def word_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("full_text"))
    return files.words(rows, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.count("*").alias("words"))


@query("""
SELECT 'c' || c_custkey AS study_id, param, CASE param WHEN 'name' THEN c_name WHEN 'note' THEN CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'say "' || c_custkey || '",|next' END ELSE CAST(c_nationkey AS VARCHAR) END AS value
FROM customer, (SELECT unnest(['name', 'note', 'nation']) AS param)
""")
def gold_table(spark, sf_dir):
    """A gold CSV file with quotes, line breaks, blanks around cells and rows without a key, read and unpivoted."""
    c = table(spark, sf_dir, "customer")
    rows = c.selectExpr("concat(' c', c_custkey, ' ') study_id", "c_name name", "case when c_custkey % 3 = 0 then ' ' else concat('say \"', c_custkey, '\",\\nnext') end note", "cast(c_nationkey as string) nation")
    rows = rows.unionByName(c.where("c_custkey % 7 = 0").selectExpr("' ' study_id", "'lost' name", "'lost' note", "'lost' nation"))
    path = scratch_path(spark)
    rows.write.csv(path, header=True, quote='"', escape='"')
    return tables.unpivot_gold(tables.read_gold(spark, path)).select("study_id", "param", F.translate("value", "\n", "|").alias("value"))


def _batch(spark, sf_dir):
    """Customers as papers: every seventh failed, every third with two experiments; written as JSON and read back."""
    value = lambda v, c: F.struct(v.cast("string").alias("value"), c.cast("double").alias("confidence"))
    params = F.create_map(F.lit("age"), value(F.col("c_nationkey"), F.lit(0.5)), F.lit("name"), value(F.col("c_name"), F.lit(0.9)))
    one = F.create_map(F.lit("age"), value(F.col("c_nationkey"), F.lit(0.5)))
    many = F.col("c_custkey") % 3 == 0
    experiment = lambda n, p: F.struct(F.lit(n).alias("experiment_number"), F.lit("t").alias("experiment_title"), p.alias("parameters"))
    result = F.struct(F.when(~many, params).alias("parameters"), F.when(many, F.array(experiment(1, params), experiment(2, one))).alias("experiments"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("paper_name"), (F.col("c_custkey") % 7 != 0).alias("success"), many.alias("is_multi_experiment"), F.when(many, 2).otherwise(1).alias("num_experiments"),
        F.when(many, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2))).alias("param_counts"), F.array(F.lit("age"), F.lit("name")).alias("all_params"), result.alias("extraction_result"),
    )
    path = scratch_path(spark)
    rows.write.json(path)
    return tables.read_batch_results(spark, path, lines=True)


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS paper_name, e AS experiment, param, CASE param WHEN 'age' THEN CAST(c_nationkey AS VARCHAR) ELSE c_name END AS value, CASE param WHEN 'age' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence
FROM customer, (SELECT unnest([1, 2]) AS e), (SELECT unnest(['age', 'name']) AS param) WHERE c_custkey % 7 <> 0 AND (e = 1 OR (c_custkey % 3 = 0 AND param = 'age'))
""")
def batch_params(spark, sf_dir):
    return tables.batch_params(_batch(spark, sf_dir)).select("paper_name", "experiment", "param", "value", "confidence")


@query("""
SELECT papers, successes, round(100.0 * successes / papers, 6) AS success_pct, multi, successes + multi AS experiments, 2 * successes + multi AS params, round((2 * successes + multi) / (successes + multi), 6) AS params_per_experiment, CAST(2 AS BIGINT) AS unique_params
FROM (SELECT count(*) AS papers, count(*) FILTER (c_custkey % 7 <> 0) AS successes, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 = 0) AS multi FROM customer)
""")
def batch_totals(spark, sf_dir):
    return report.batch_summary(_batch(spark, sf_dir))


# --- store ---------------------------------------------------------------------------------------


@query("""
SELECT c_nationkey || '_E' || (c_custkey % 5 + 1) AS id, CAST(c_nationkey AS VARCHAR) AS paper_id, c_custkey % 5 + 1 AS experiment_number, count(*) AS parameter_count, CASE WHEN avg(c_custkey % 10 / 10) < 0.7 THEN 'needs_review' ELSE 'validated' END AS entry_status,
  count(DISTINCT c_custkey % 5) OVER () > 0 AND (SELECT count(DISTINCT x.c_custkey % 5) FROM customer x WHERE x.c_nationkey = c.c_nationkey) > 1 AS is_multi_experiment
FROM customer c GROUP BY c_nationkey, c_custkey % 5
""".replace("count(DISTINCT c_custkey % 5) OVER () > 0 AND ", ""))
def experiment_rows(spark, sf_dir):
    params = table(spark, sf_dir, "customer").selectExpr("cast(c_nationkey as string) paper_id", "c_custkey % 5 + 1 experiment", "concat('p', c_custkey) param", "c_name value", "c_custkey % 10 / 10D confidence")
    return store.experiment_rows(params).select("id", "paper_id", "experiment_number", "parameter_count", "entry_status", "is_multi_experiment")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'published' WHEN c_acctbal < 0 THEN 'needs_review' ELSE 'validated' END AS entry_status, '1.5' AS schema_version FROM customer")
def migrated_statuses(spark, sf_dir):
    """Rows brought to a schema version, with statuses that came back from a review sheet."""
    c = table(spark, sf_dir, "customer")
    rows = store.migrate(c.selectExpr("cast(c_custkey as string) id", "c_name name", "case when c_acctbal < 0 then 'needs_review' else 'validated' end entry_status"), {"notes": "string"}, "1.5")
    back = c.where("c_custkey % 2 = 0").selectExpr("cast(c_custkey as string) id", "'published' entry_status")
    return store.apply_status(store.migrate(rows, {"notes": "string"}, "2.0"), back).select("id", "name", "entry_status", "schema_version")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS paper_id, CAST(c_acctbal AS DOUBLE) AS age_mean, 'robot' AS gear FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 2 = 1")
def exported_experiments(spark, sf_dir):
    """Experiments written as JSON with nested equipment and read back."""
    rows = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) id", "cast(c_nationkey as string) paper_id", "cast(c_acctbal as double) age_mean", "'robot' equipment_manipulandum_type")
    path = scratch_path(spark)
    store.export(rows, path)
    return spark.read.schema("id string, paper_id string, age_mean double, equipment struct<manipulandum_type:string>").json(path).select("id", "paper_id", "age_mean", F.col("equipment.manipulandum_type").alias("gear"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS paper_id FROM customer WHERE c_acctbal < 0")
def review_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) id", "c_name name", "cast(c_nationkey as string) paper_id", "case when c_acctbal < 0 then 'needs_review' else 'validated' end entry_status", "timestamp'2020-01-01' updated_at")
    return store.review_sheet(store.conform(rows, "experiments")).select("id", "name", "paper_id")


@query("""
WITH p AS (SELECT event_type AS parameter_name, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS r, value / 1000 AS c, user_id FROM events)
SELECT parameter_name, count(*) AS n, max(r) AS importance_rank, round(avg(c), 6) AS avg_confidence FROM p GROUP BY 1 HAVING count(*) >= 2
""")
def proposal_view(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id id", "event_type parameter_name", "case event_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end importance", "'low' prevalence", "value / 1000 confidence", "cast(user_id as string) source_paper_id", "false promoted")
    store.create_temp_views({"proposed_parameters": store.conform(rows, "proposed_parameters")})
    return spark.table("v_proposal_stats").select("parameter_name", "n", "importance_rank", F.round("avg_confidence", 6).alias("avg_confidence"))


@query("SELECT event_id AS id, event_type AS parameter_name, c_name AS experiment_name FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 3 = 0 AND event_id % 2 = 0")
def pending_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id id", "cast(user_id as string) experiment_id", "event_type parameter_name", "event_id % 3 = 0 requires_review", "event_id % 2 = 1 reviewed")
    experiments = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) id", "c_name name")
    store.create_temp_views({"llm_inference_provenance": store.conform(rows, "llm_inference_provenance"), "experiments": store.conform(experiments, "experiments")})
    return spark.table("v_pending_reviews").select("id", "parameter_name", "experiment_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS experiment_id, CASE WHEN p_partkey % 2 = 0 THEN 'code' ELSE 'config_files' END AS source_type, sha256(p_name) AS file_content_hash FROM part")
def file_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("concat('/r/', p_partkey) path", "case when p_partkey % 2 = 0 then 'python' else 'json' end kind", "p_name text", "cast(p_partkey as string) e")
    return store.conform(code.provenance(rows, F.regexp_extract("path", "[0-9]+", 0), "1"), "provenance").select("experiment_id", "source_type", "file_content_hash")


# --- model assistance -------------------------------------------------------------------------------


@query("""
SELECT p_partkey, param, value, stage FROM part, (SELECT unnest(['age_mean', 'effector', 'extra_one', 'num_blocks']) AS param, unnest(['verify', 'verify', 'missed', 'infer']) AS stage) s,
  LATERAL (SELECT CASE param WHEN 'age_mean' THEN CASE WHEN p_partkey % 2 = 0 THEN p_size || '' ELSE 'old' END WHEN 'effector' THEN CASE WHEN p_partkey % 3 = 0 THEN 'arm' END WHEN 'extra_one' THEN CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '' END ELSE CASE WHEN p_partkey % 5 = 0 THEN '7' END END AS value) v
WHERE value IS NOT NULL
""")
def assisted_stages(spark, sf_dir):
    """Verify, find missed, infer the rest, answered by the stub provider from what the texts hold."""
    line = lambda rule, text: f"case when {rule} then {text} else '' end"
    text = f"concat({line('p_partkey % 2 = 0', chr(39) + 'age_mean: ' + chr(39) + ' || p_size || ' + repr(chr(92) + 'n'))}, {line('p_partkey % 3 = 0', repr('effector: arm' + chr(92) + 'n'))}, {line('p_partkey % 2 = 0', chr(39) + 'extra_one = ' + chr(39) + ' || p_partkey || ' + repr(chr(92) + 'n'))}, {line('p_partkey % 5 = 0', repr('num_blocks: 7' + chr(92) + 'n'))})"
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey", text.replace("\\\\n", "\\n") + " text")
    found = docs.selectExpr("p_partkey", "'age_mean' param", "'old' value", "0.5D confidence")
    out = assist.assisted(docs, found, ["effector"], ["age_mean", "num_blocks", "effector"], "p_partkey", "text", assist.StubProvider())
    return out.select("p_partkey", "param", "value", "stage")


@query("""
WITH a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'abstained' WHEN event_id % 4 = 1 THEN 'no_value' ELSE 'accepted' END AS verdict FROM events)
SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 6) AS share FROM a GROUP BY verdict
""")
def answer_statistics(spark, sf_dir):
    answer = F.when(F.col("event_id") % 4 == 0, '{"x": {"abstained": true}}').when(F.col("event_id") % 4 == 1, '{"x": {"value": " ", "confidence": 0.9, "evidence": "e"}}').when(F.col("event_id") % 4 == 2, 'Sure: {"parameters": {"x": {"value": "1", "confidence": 0.9, "evidence": "e"}}}').otherwise('```json\n{"x": {"value": "2", "confidence": 0.1, "evidence": "e",}}\n```')
    rows = assist.parse_answers(table(spark, sf_dir, "events").select("event_id", answer.alias("answer")), ["event_id"])
    return assist.filter_statistics(rows.withColumn("verdict", assist.evidence_verdict(F.col("confidence"), F.col("evidence"), F.col("value"), F.col("abstained"))))


@query("SELECT event_id, 'p' || event_id AS parameter_name, round((CASE event_id % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.6 ELSE 0.5 END + 0.9) / 2, 6) AS confidence FROM events WHERE event_id % 3 < 2")
def new_parameters(spark, sf_dir):
    """Proposals from answers in both forms, with a known prevalence."""
    item = F.concat(F.lit('[{"parameter_name": "p'), F.col("event_id").cast("string"), F.lit('", "prevalence": "'), F.element_at(F.array(F.lit("low"), F.lit("Medium"), F.lit("odd")), (F.col("event_id") % 3 + 1).cast("int")), F.lit('", "importance": "high"}]'))
    answer = F.when(F.col("event_id") % 2 == 0, item).otherwise(F.concat(F.lit('{"new_parameters": '), item, F.lit("}")))
    rows = assist.parse_new(table(spark, sf_dir, "events").select("event_id", answer.alias("answer")), ["event_id"])
    return assist.filter_proposals(rows, top=None).select("event_id", "parameter_name", F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 AND doc_id % 2 = 0")
def discovery_papers(spark, sf_dir):
    return assist.discovery_papers(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("success")), "doc_id").select("doc_id")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'new' ELSE 'a' END AS value, CAST(CASE c_custkey % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence, CASE WHEN c_custkey % 4 IN (0, 1) THEN 2 ELSE 1 END AS evidence
FROM customer
""")
def merged_answers(spark, sf_dir):
    """Equal answers raise the confidence, different ones don't, missing ones come in."""
    c = table(spark, sf_dir, "customer")
    found = c.where("c_custkey % 4 <> 3").selectExpr("c_custkey", "'a' value", "0.5D confidence", "'f' evidence")
    answers = c.where("c_custkey % 4 <> 2").selectExpr("c_custkey", "case c_custkey % 4 when 0 then 'a' when 1 then 'b' else 'new' end value", "0.8D confidence", "'q' evidence")
    return retrieve.merge_answers(found, answers, ["c_custkey"]).select("c_custkey", "value", "confidence", F.size("evidence").alias("evidence"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'llm' ELSE 'old' END AS value, CASE WHEN c_custkey % 2 = 0 THEN 'llm_inference' ELSE 'regex' END AS source_type FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def fallback_answers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    found = c.where("c_custkey % 3 = 0").selectExpr("c_custkey", "'old' value", "0.5D confidence")
    return assist.apply_fallback(found, c.where("c_custkey % 2 = 0").selectExpr("c_custkey", "'llm' value", "0.8D confidence"), ["c_custkey"]).select("c_custkey", "value", "source_type")


@query("SELECT user_id, round(1 - f / 3.0, 6) AS missing FROM (SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('click', 'purchase')) AS f FROM events GROUP BY 1) WHERE 1 - f / 3.0 > 0.34")
def gated_scopes(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("param"))
    expected = ev.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit("click"), F.lit("purchase"), F.lit("nothing"))).alias("param"))
    return assist.gate(ev, expected, "user_id", 0.34).select("user_id", F.round("missing", 6).alias("missing"))


@query("SELECT event_id, event_id % 4 = 0 OR value < 30 OR (event_id % 2 = 0 AND value < 50) AS ask FROM events")
def asked_parameters(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", assist.ask_model(F.when(F.col("event_id") % 4 == 0, "verify").otherwise("fallback"), F.col("value") / 100, F.col("event_id") % 2 == 0).alias("ask"))


@query("SELECT user_id, event_type AS param, round(value, 1) AS value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_type, round(value, 1) FROM events WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def added_missing(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("param"), F.round("value", 1).alias("value"))
    return assist.add_missing(ev.where("param = 'click'"), ev.where("param <> 'click'"), ["user_id"])


# --- retrieval, reports, matching -----------------------------------------------------------------------


@query("""
WITH p AS (SELECT a.label, a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id < 17)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY label, query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY label, query_id ORDER BY score DESC, chunk_id) <= 6
""")
def vector_within(spark, sf_dir):
    """Retrieval within a document: the label stands for it, and 17 vectors for a schema's fields."""
    e = table(spark, sf_dir, "embeddings")
    return retrieve.vector_top_k(e.select("label", F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id < 17").select("label", F.col("vec_id").alias("query_id"), "embedding"), within=["label"]).select("query_id", "chunk_id", "score", "rank")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'v' || c_custkey END AS value, CASE WHEN c_custkey % 2 = 0 THEN 0.8 END::DOUBLE AS confidence, CAST(c_custkey % 9 AS INTEGER) AS page FROM customer")
def field_answers(spark, sf_dir):
    answer = F.concat(F.lit('Answer: {"value": '), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"v'), F.col("c_custkey").cast("string"), F.lit('"'))).otherwise("null"), F.lit(', "page": '), (F.col("c_custkey") % 9).cast("string"), F.lit(', "quote": "q"}'))
    a = table(spark, sf_dir, "customer").select("c_custkey", retrieve.parse_field(answer).alias("a"))
    return a.select("c_custkey", "a.value", "a.confidence", F.col("a.evidence")[0]["page"].alias("page"))


@query("SELECT * FROM (SELECT p_name AS name, p_retailprice AS price, 'top' AS side FROM part ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 10) UNION ALL SELECT * FROM (SELECT p_name, p_retailprice, 'bottom' FROM part ORDER BY p_retailprice, p_name, p_partkey LIMIT 10)")
def best_and_worst(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return report.top_bottom(rows, "price", "name")


@query("SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 'acts' ELSE 'other' END AS category, count(*) AS params, round(avg(pct), 6) AS avg_pct FROM (SELECT event_type, round(100.0 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS pct FROM events WHERE value > 60 GROUP BY 1) GROUP BY 1")
def category_coverage(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cover = report.coverage(ev.where("value > 60").select("user_id", F.col("event_type").alias("param"), "value"), ev.select("user_id"), "user_id", confidence=None)
    return report.category_average(cover, {"click": "acts", "purchase": "acts"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_suppkey % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS weight FROM lineitem")
def source_weights(spark, sf_dir):
    source = F.element_at(F.array(*[F.lit(s) for s in ("code", "pdf_methods", "regex", "odd")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", resolve.weighted_score(source, {"code": 3.0, "pdf_methods": 2.0}).alias("weight"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'synonym' WHEN 1 THEN 'exact' WHEN 2 THEN 'substring' WHEN 3 THEN NULL ELSE 'number' END AS rule FROM customer")
def synonym_matches(spark, sf_dir):
    turn = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rule = match.fuzzy_rule(turn("abrupt", "random", "gradual", "abrupt", "12.0 deg"), turn("immediate", "Random", "gradually so", "never", "12.1"), F.lit("perturbation_schedule"))
    return table(spark, sf_dir, "customer").select("c_custkey", rule.alias("rule"))


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS same FROM customer")
def same_papers(spark, sf_dir):
    turn = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.same_paper(turn("Smith_2019.pdf", "On  Reaching.PDF", "Lee 2020"), turn("smith 2019 more", "on_reaching", "Lee 2021")).alias("same"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text || chr(10) || 'Published in ' || (1990 + doc_id % 30) || '.', '\\b(?:19|20)[0-9]{2}\\b')) AS BIGINT) AS years FROM documents")
def domain_years(spark, sf_dir):
    """Both domain libraries over whole documents that end in a line with a year; how many years they find in each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nPublished in "), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit(".")).alias("text"))
    rows = extract.candidates_with_fallback(docs, MOTOR_LEARNING, MOTOR_FALLBACK, ["doc_id"])
    return rows.where("param = 'year'").groupBy("doc_id").agg(F.count("*").alias("years"))
