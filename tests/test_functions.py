"""Scalar functions and parsers on small inline rows."""

import os

import pytest
from pyspark.sql import functions as F

from docsmelt.functions import text as tx
from docsmelt.functions import values as vl
from docsmelt.operators import assist, extract, match, resolve, retrieve, structure
from docsmelt.plans import libraries
from docsmelt.sources import code, files, store, tables


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))
    return df.select(column.alias("x")).first()["x"]


def test_clean_text_joins_broken_words(spark):
    assert one(spark, tx.clean_text(F.col("t")), t="the partici- pants and ad- aptation /H11011 5") == "the participants and adaptation ~ 5"


@pytest.mark.parametrize("raw,want", [("https://doi.org/10.1/x", "10.1/x"), ("DOI 10.1/x", "10.1/x"), ("http://dx.doi.org/10.1/x ", "10.1/x")])
def test_clean_doi(spark, raw, want):
    assert one(spark, tx.clean_doi(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,kind,want", [("45.7", "integer", 45.0), ("-45.7", "integer", -45.0), ("twelve", "integer", 12.0), ("sixty young adults", "integer", 60.0), ("30°", "float", 30.0), ("n/a", "float", None)])
def test_typed_numbers(spark, raw, kind, want):
    t = one(spark, vl.typed(F.col("t"), F.lit(kind)), t=raw)
    assert t["value_num"] == want
    assert t["base"] == (0.5 if want is None else 0.85)


def test_pattern_quality_is_bounded(spark):
    q = lambda c: one(spark, vl.pattern_quality(F.col("t"), F.lit("deg"), F.array(F.lit("rotation"))), t=c)
    assert q("") == 0.7
    assert q("the rotation was 30 deg") == pytest.approx(1.0)
    assert q("maybe 30") == 0.5
    assert q("30") == 0.6


@pytest.mark.parametrize("dirty", ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} as asked', '{{"a": 1}}', '﻿{"a": 1}', '{"a": 1,}'])
def test_parse_json_strategies(spark, dirty):
    assert one(spark, F.get_json_object(vl.parse_json(F.col("t")), "$.a"), t=dirty) == "1"


@pytest.mark.parametrize("bad", ["", "none here", '{"a": ', None])
def test_parse_json_gives_null(spark, bad):
    assert one(spark, vl.parse_json(F.col("t")), t=bad) is None


@pytest.mark.parametrize(
    "gold,auto,param,rule",
    [
        ("Arm", "arm", None, "exact"), ("abrupt", "sudden", "perturbation_schedule", "synonym"), ("end_point", "end point", None, "normalised"), ("4", "45", None, "substring"),
        ("a continuous cue", "continous dot", None, "typo"), ("aim and report", "report the aim", None, "words"), ("25, 45", "45, 90", None, "set"), ("45", "46 deg", None, "number"),
        ("rotated cw", "clockwise turn", None, "abbreviation"), ("red", "blue", None, None), (None, "blue", None, None),
    ],
)
def test_fuzzy_rule(spark, gold, auto, param, rule):
    assert one(spark, match.fuzzy_rule(F.col("g"), F.col("a"), F.col("p")), g=gold, a=auto, p=param) == rule


def test_strict_match_leaves_out_substrings(spark):
    assert one(spark, match.fuzzy_rule(F.col("g"), F.col("a"), strict=True), g="4", a="45") is None


def test_metrics_golden_arithmetic(spark):
    rows = [("TP",)] * 28 + [("FP",)] * 34 + [("FN",)] * 135 + [("VM",)] * 54
    m = match.metrics(spark.createDataFrame(rows, "label string")).first()
    assert (round(m["precision"], 3), round(m["recall"], 3), round(m["f1"], 3)) == (0.241, 0.172, 0.201)


def test_libraries_name_known_parameters():
    libraries.check_library(libraries.MOTOR_LEARNING)
    with pytest.raises(ValueError):
        libraries.check_library([libraries.Pattern("no_such", "string", "x")])


def test_domain_extraction(spark):
    text = "Methods\nA total of 24 healthy participants took part (mean age 22.5). A 30 deg visuomotor rotation was abrupt. There were 80 adaptation trials."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    found = extract.best(extract.candidates(docs, libraries.MOTOR_LEARNING, ["doc_id"]), ["doc_id", "param"]).collect()
    got = {r["param"]: (r["value_num"] if r["value_num"] is not None else r["value_str"]) for r in found}
    assert got["n_total"] == 24 and got["age_mean"] == 22.5 and got["rotation_magnitude_deg"] == 30 and got["adaptation_trials"] == 80 and got["perturbation_schedule"] == "abrupt"
    assert all(0 < r["confidence"] <= 1 and r["doc_id"] == 1 for r in found)


def test_sections_modes_and_sentences(spark):
    text = "Intro words\nMethods\nfirst\nResults\nr\nMethods\nsecond\nThe methods that we used in this long sentence are not a header at all."
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    got = {m: {r["section"]: r["body"] for r in structure.sections(docs, ["id"], mode=m).collect()} for m in ("concat", "first", "last")}
    assert got["first"]["methods"] == "first" and got["last"]["methods"].startswith("second") and got["concat"]["methods"].startswith("first\n\nsecond")
    assert got["first"]["preamble"] == "Intro words"


def test_experiments_keep_first_header_of_a_number(spark):
    text = "Experiment 1: Baseline runs\na\nExperiment II: Later runs\nb\nExperiment 1: again\nc"
    rows = structure.experiments(spark.createDataFrame([(1, text), (2, "no headers")], "id int, text string"), ["id"]).collect()
    got = {(r["id"], r["number"]): r["title"] for r in rows}
    assert got == {(1, 1): "Baseline runs", (1, 2): "Later runs", (2, 1): ""}


def test_tables(spark):
    md = "Table 1. Groups\n| a | b |\n|---|---|\n| 1 | 2 |\n\nname  n  mean\nx  1  2.0\ny  2  3.0\n"
    t = structure.tables(spark.createDataFrame([(1, md), (2, None)], "id int, text string"), ["id"]).orderBy("id").collect()
    assert [(x["format"], x["n_rows"], x["caption"]) for x in t[0]["tables"]] == [("markdown", 1, "Table 1. Groups"), ("plain", 2, None)]
    assert t[1]["tables"] == []


def test_multi_column(spark):
    rows = [(1, float(x)) for x in [50, 51, 52, 53, 54, 300, 301, 302, 303, 304]] + [(2, 50.0)]
    got = {r["id"]: r["is_multi_column"] for r in structure.multi_column(spark.createDataFrame(rows, "id int, x0 double"), ["id"]).collect()}
    assert got == {1: True, 2: False}


def test_resolve_policies(spark):
    rows = [
        ("feedback_delay_ms", "100", "code", 0.9, 1), ("feedback_delay_ms", "102", "llm", 0.8, 2), ("instruction_awareness", "a", "code", 0.9, 1), ("instruction_awareness", "b", "pdf", 0.2, 2),
        ("x", "1", "llm", 0.5, 1), ("x", "2", "config", 0.4, 2), ("y", "1", "llm", 0.9, 1), ("y", "2", "config", 0.4, 2), ("z", "7", "code", 0.1, 1), ("w", "1", "llm", 0.7, 1), ("w", "2", "config", 0.5, 2),
    ]
    got = {r["param"]: r for r in resolve.resolve(spark.createDataFrame([("s", *r) for r in rows], "s string, param string, value string, source_type string, confidence double, ord int"), ["s"]).collect()}
    assert got["feedback_delay_ms"]["value"] == "101.0"
    assert got["instruction_awareness"]["value"] is None and got["instruction_awareness"]["conflict_detected"]
    assert got["x"]["value"] == "2" and got["x"]["alternatives"] == ["1"]  # a gap of 0.1: the source decides
    assert got["y"]["value"] == "1"  # a gap of 0.5
    assert got["w"]["value"] == "2"  # a gap of exactly 0.2 does not decide
    assert got["z"]["value"] == "7" and not got["z"]["conflict_detected"]


def test_dedup_rejects_unknown_strategy(spark):
    with pytest.raises(ValueError):
        resolve.dedup(spark.range(1), "best")


def test_model_round_trip(spark):
    docs = spark.createDataFrame([(1, "effector: arm\nenvironment: tablet"), (2, "nothing")], "id int, text string")
    found = spark.createDataFrame([(1, "effector", "leg", 0.4)], "id int, param string, value string, confidence double")
    out = {(r["id"], r["param"]): (r["value"], r["source_type"]) for r in assist.verify_and_fill(docs, found, ["environment", "effector"], "id", "text", assist.provider("stub")).collect()}
    assert out == {(1, "effector"): ("arm", "llm_inference"), (1, "environment"): ("tablet", "llm_inference")}
    with pytest.raises(ValueError):
        assist.provider("nobody")


def test_failing_provider_gives_error_rows(spark):
    class Broken:
        name = "broken"

        def generate(self, *_):
            raise RuntimeError("no")

    r = assist.generate(spark.createDataFrame([("p",)], "prompt string"), "prompt", Broken()).first()
    assert r["answer"] is None and r["error"] == "no"


def test_vector_queries_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id int, embedding array<double>")
    with pytest.raises(ValueError):
        retrieve.vector_top_k(rows, rows.withColumnRenamed("chunk_id", "query_id"), largest=1)


def test_python_config_and_yaml_sources():
    aliases = {k.lower(): v for k, v in libraries.alias_table().items()}
    got = {n: (v, how) for n, v, how, _ in code.python_params("n_trials = 80\nrotation = -30\nself.iti = 1.5\nn_trials = 90\n", aliases)}
    assert got["num_trials"] == ("90", "ast") and got["rotation_magnitude_deg"] == ("-30", "ast") and got["inter_trial_interval_ms"][0] == "1.5"
    assert dict(code.walk({"task": {"n_blocks": 4}, "list": [{"iti": 1}]}, aliases)) == {"num_blocks": "4"}
    assert code.parse_yaml("a:\n  n_trials: 5\nb: x\n")["a"]["n_trials"] in (5, "5")
    assert [how for _, _, how, _ in code.python_params("def broken(:\n  n_trials = 7\n", aliases)] == ["regex"]


def test_files_and_cache(spark, tmp_path):
    for name in ("src/a.py", "build/b.py", "c.json", "x.pdf", "x.ocr.pdf"):
        p = tmp_path / "out" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("n_trials = 3" if name.endswith(".py") else '{"iti": 2}')
    root = f"file:{tmp_path}/out"  # an excluded name above the root does not count
    found = files.discover(files.list_files(spark, root), root)
    assert sorted(r["name"] for r in files.without_ocr_twins(found).collect()) == ["a.py", "c.json", "x.pdf"]
    todo, kept = files.uncached(found.select("path", "modificationTime"), found.limit(1).select("path", "modificationTime", F.lit("default").alias("mode")))
    assert todo.count() == found.count() - 1 and kept.count() == 1
    texts = files.extract_text(spark.createDataFrame([("p", bytearray(b"hi"))], "path string, content binary"), lambda b: 1 / 0, lambda b: b.decode())
    assert texts.first()["extraction_method"] == "fallback"


def test_gold_csv(spark, tmp_path):
    p = tmp_path / "gold.csv"
    p.write_text('study_id,title,effector\nA1,"x, ""y""\nz",arm\nA1,last, \n,none,none\n')
    rows = tables.read_gold(spark, str(p)).collect()
    assert [(r["study_id"], r["title"], r["effector"]) for r in rows] == [("A1", "last", None)]


def test_store_upsert_and_stream(spark, tmp_path):
    from docsmelt.streaming import ingest

    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    spark.sql("drop table if exists t_up")
    store.upsert_table(a, "t_up", "id")
    store.upsert_table(spark.createDataFrame([("2", "z"), ("3", "w")], "id string, v string"), "t_up", "id")
    assert sorted(map(tuple, spark.table("t_up").collect())) == [("1", "x"), ("2", "z"), ("3", "w")]
    folder = str(tmp_path / "in")
    docs = spark.createDataFrame([(1, "mail me at a.b@c.de now")], "doc_id long, text string")
    docs.write.parquet(folder)
    spark.sql("drop table if exists t_stream")
    stream = ingest.file_stream(spark, folder, docs.schema)
    for _ in range(2):  # the second run sees nothing new
        ingest.extract_stream(stream, libraries.GENERIC, "t_stream", "doc_id", str(tmp_path / "cp")).awaitTermination()
    assert [r["value_raw"] for r in spark.table("t_stream").collect()] == ["a.b@c.de"]


def test_migration_is_idempotent(spark):
    df = store.migrate(spark.createDataFrame([("1",)], "id string"), {"paper_id": "string"}, "1.4")
    again = store.migrate(df, {"paper_id": "string"}, "1.5")
    assert again.columns == ["id", "paper_id", "schema_version"] and again.first()["schema_version"] == "1.4"
    assert store.conform(df, "experiments").columns[0] == "id"


def test_block_chunks(spark):
    blocks = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(p).alias("page")) for t, p in (("a b", 1), ("c", 1), ("d e f g h", 2), ("i", 3))])
    got = [(r["text"], r["page"]) for r in one(spark, tx.chunk_blocks(blocks, 4), t="x")]
    assert got == [("a b\nc", 1), ("d e f g h", 2), ("i", 3)]


def test_words_and_blocks(spark):
    df = spark.createDataFrame([(1, "a b\n\nc\fd"), (2, "")], "id int, full_text string")
    assert [(r["page"], r["block_no"], r["word"]) for r in files.words(df, ["id"]).orderBy("page", "block_no", "word_no").collect()] == [(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, "d")]


def test_sql_registry(spark):
    from docsmelt.functions import registry

    registry.register(spark)
    assert spark.sql("""select extract_json('so {"a": "}", "b": {"c": 1}} done') x""").first()["x"] == '{"a": "}", "b": {"c": 1}}'
    assert registry.first_object("no { object") is None and registry.first_object(None) is None
    assert [tuple(r)[:2] for r in spark.sql("select * from python_params('n_trials = 12')").collect()] == [("num_trials", "12")]
    assert [tuple(r) for r in spark.sql("""select * from config_params('{"iti": 5}', 'json')""").collect()] == [("inter_trial_interval_ms", "5")]


def test_field_answers(spark):
    assert retrieve.field_queries(spark).count() == 17
    r = one(spark, retrieve.parse_field(F.col("t")), t='```json\n{"value": "30", "page": 2, "quote": "was 30"}\n```')
    assert (r["value"], r["confidence"], r["evidence"][0]["page"]) == ("30", 0.8, 2)


def test_ask_model(spark):
    ask = lambda mode, c, crit: one(spark, assist.ask_model(F.col("m"), F.col("c"), F.lit(crit)), m=mode, c=c)
    assert ask("verify", 0.9, False) and ask("fallback", 0.2, False) and ask("fallback", 0.4, True) and not ask("fallback", 0.4, False)


def test_store_script_views_and_export(spark, tmp_path):
    store.run_sql(spark, "create or replace temp view tv as select 'a;b' as x; -- done\n")
    assert spark.table("tv").first()["x"] == "a;b"
    e = store.conform(spark.createDataFrame([("1", "p", "needs_review", 2.5)], "id string, paper_id string, entry_status string, age_mean double"), "experiments")
    for fmt in ("json", "csv", "metalab", "psychds"):
        store.export(e, str(tmp_path / fmt), fmt, ["1"])
    assert "equipment" in spark.read.json(str(tmp_path / "json")).columns or spark.read.json(str(tmp_path / "json")).count() == 1
    assert store.review_sheet(e).count() == 1
    updates = spark.createDataFrame([("1", "validated")], "id string, entry_status string")
    assert store.apply_status(e, updates).first()["entry_status"] == "validated"
    with pytest.raises(ValueError):
        store.export(e, str(tmp_path / "x"), "xml")
    store.write_report({"part": e.select("id")}, str(tmp_path / "report"), spark)
    assert spark.read.json(str(tmp_path / "report")).first()["part"] == "part"


def test_experiment_rows_have_one_parent(spark):
    p = spark.createDataFrame([("A", 1, "x", "1", 0.9), ("A", 2, "x", "2", 0.5), ("B", 1, "y", "3", 0.8)], "paper_id string, experiment int, param string, value string, confidence double")
    got = {r["id"]: (r["parent_experiment_id"], r["is_multi_experiment"], r["entry_status"]) for r in store.experiment_rows(p).collect()}
    assert got == {"A_E1": (None, True, "validated"), "A_E2": ("A_E1", True, "needs_review"), "B_E1": (None, False, "validated")}


def test_shared_prefix_and_methods(spark):
    df = spark.createDataFrame([(1, "Intro text\nExperiment 1: Alpha beta\nx\nMethods\nall of it\nResults\nr")], "id int, text string")
    assert structure.shared_prefix(df, ["id"]).first()["text"].strip() == "Intro text"
    shared = df.select(structure.shared_methods(F.col("text"), F.lit(1)).alias("m")).first()["m"]
    assert shared.strip() == "Methods\nall of it"
    assert df.select(structure.inject_methods(F.lit("Experiment 2\nbody"), F.lit("Methods\nm")).alias("t")).first()["t"] == "Experiment 2\nMethods\nm\nbody"


def test_command_line_parses():
    from docsmelt.cli import parser

    assert parser().parse_args(["dedup", "a", "b", "--strategy", "last"]).strategy == "last"


def test_batch_summary(spark):
    from docsmelt.operators import report

    rows = [("a", True, True, 2, [3, 4], ["x", "y"]), ("b", True, False, 1, [1], ["x"]), ("c", False, None, None, None, None)]
    df = spark.createDataFrame(rows, "paper_name string, success boolean, is_multi_experiment boolean, num_experiments int, param_counts array<int>, all_params array<string>")
    r = report.batch_summary(df).first()
    assert (r["papers"], r["successes"], r["multi"], r["experiments"], r["params_per_experiment"], r["unique_params"]) == (3, 2, 1, 3, round(8 / 3, 6), 2)
    assert [tuple(x) for x in report.param_frequency(df).collect()] == [("x", 2), ("y", 1)]


def test_entry_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "docsmelt"), tmp_path / "docsmelt", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    show = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(e.oracle_sql()) == sorted(q), any(n.startswith('op') for n in q))"
    run = lambda: subprocess.run([sys.executable, "-c", show], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split()[1:] == ["True", "False"]
    os.makedirs(tmp_path / "docsmelt" / "llm")  # an empty folder left behind is no package
    assert run().stdout.split()[1:] == ["True", "False"]
    (tmp_path / "docsmelt" / "llm" / "queries.py").write_text("import a_library_that_is_missing")
    assert "a_library_that_is_missing" in run().stderr


def test_sections_of_rows_that_share_a_key(spark):
    docs = spark.createDataFrame([(1, "Methods\naaa\nResults\nbbb"), (1, "Methods\nxxx\nResults\nyyy"), (2, None), (3, "")], "id int, text string")
    rows = [(r["id"], r["section"], r["body"]) for r in structure.sections(docs, ["id"]).collect()]
    assert sorted(rows) == [(1, "methods", "aaa"), (1, "methods", "xxx"), (1, "results", "bbb"), (1, "results", "yyy")]
    both = structure.experiments(spark.createDataFrame([(1, "Task 1: One of them\na\nStudy two\nb"), (1, "Experiment 3\nc"), (2, None)], "id int, text string"), ["id"]).collect()
    assert sorted((r["number"], r["title"], r["body"]) for r in both) == [(1, "One of them", "Task 1: One of them\na"), (2, "Experiment 2", "Study two\nb"), (3, "Experiment 3", "Experiment 3\nc")]


@pytest.mark.parametrize("text,groups", [("a 2x2 factorial", 4), ("3 × 2 factorial design", 6), ("2-by-3 factorial", 6), ("targets were 2x2 cm", None), ("two groups", None), ("four experimental groups", 4), ("13 groups", None), (None, None)])
def test_group_counts(spark, text, groups):
    from docsmelt.operators import extract

    assert spark.createDataFrame([(text,)], "t string").select(extract.group_count(F.col("t")).alias("n")).first()["n"] == groups


def test_words_of_any_script_are_joined(spark):
    from docsmelt.functions.text import clean_text

    assert spark.createDataFrame([("pré- férence des вы- боров",)], "t string").select(clean_text(F.col("t")).alias("t")).first()["t"] == "préférence des выборов"


def test_upsert_survives_a_stop_between_renames(spark):
    from docsmelt.sources import store

    spark.sql("DROP TABLE IF EXISTS stopped")
    store.upsert_table(spark.createDataFrame([(1, "a")], "id int, v string"), "stopped", "id")
    spark.sql("ALTER TABLE stopped RENAME TO stopped__last")  # as if the process had ended here
    store.upsert_table(spark.createDataFrame([(2, "b"), (2, "c")], "id int, v string").withColumn("n", F.ascii("v")).drop("n"), "stopped", "id")
    assert {r["id"] for r in spark.table("stopped").collect()} == {1, 2}
    spark.sql("DROP TABLE stopped")


def test_provenance_is_appended_once(spark):
    from docsmelt.sources import code, store

    spark.sql("DROP TABLE IF EXISTS provenance")
    files = spark.createDataFrame([("/a.py", "python", "x = 1"), ("/b.json", "json", "{}")], "path string, kind string, text string")
    for _ in range(2):
        store.append_rows(code.provenance(files, F.lit("e1"), "1"), "provenance")
    assert spark.table("provenance").count() == 2
    spark.sql("DROP TABLE provenance")


def test_yaml_without_its_library(monkeypatch):
    from docsmelt.sources import code

    monkeypatch.setattr(code, "yaml", None)
    assert code.parse_yaml("a:\n  b: 1 # x\nc: d") == {"a": {"b": "1"}, "c": "d"}
    with pytest.raises(ValueError, match="PyYAML"):
        code.parse_yaml("a:\n  - 1")


def test_proposals_are_saved(spark, tmp_path):
    from docsmelt.operators import assist

    rows = spark.createDataFrame([("p", "d")], "parameter_name string, description string")
    assist.save_proposals(rows, f"{tmp_path}/j", model="stub")
    assist.save_proposals(rows, f"{tmp_path}/c", "csv")
    saved = spark.read.json(f"{tmp_path}/j").first()
    assert saved["model"] == "stub" and saved["proposal"]["parameter_name"] == "p" and spark.read.csv(f"{tmp_path}/c", header=True).count() == 1


def test_answers_without_json_are_asked_again(spark):
    from docsmelt.operators import assist

    class Second:
        name = "second"

        def generate(self, prompts, temperature, max_tokens):
            return ['{"a": 1}' if "JSON object only" in p or p == "good" else "no" for p in prompts]

    rows = assist.answer_json(spark.createDataFrame([("good",), ("bad",)], "prompt string"), "prompt", Second(), "verify").collect()
    assert sorted((r["attempts"], r["answer"]) for r in rows) == [(1, '{"a": 1}'), (2, '{"a": 1}')]
