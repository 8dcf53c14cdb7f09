"""Registered queries: each applies operators to whole driver tables, with its DuckDB oracle.

``QUERIES[name]`` takes (spark, sf_dir); ``ORACLE_SQL[name]`` is the same result in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsmelt.functions import text as tx
from docsmelt.functions import values as vl
from docsmelt.operators import assist, extract, match, report, resolve, retrieve, structure
from docsmelt.plans.libraries import GENERIC, GENERIC_FALLBACK
from docsmelt.session import scratch_path
from docsmelt.sources import files, store
from docsmelt.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _matches_sql(library, lib: str) -> str:
    parts = []
    for k, p in enumerate(library):
        pattern = p.pattern.replace("'", "''")
        kind = p.kind
        parts.append(
            f"SELECT doc_id, text, '{lib}' AS lib, '{p.param}' AS param, '{kind}' AS kind, unnest(l) AS value_raw, {k} AS pattern_ord, unnest(range(len(l))) AS match_ord"
            f" FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}', {p.group}) AS l FROM documents)"
        )
    return " UNION ALL ".join(parts)


def _found(spark, sf_dir, library=GENERIC, lib="main"):
    return extract.candidates(table(spark, sf_dir, "documents"), library, ["doc_id"], lib=lib, ignore_case=False)


@query(f"SELECT doc_id, param, value_raw, CAST(pattern_ord AS INTEGER) AS pattern_ord, CAST(match_ord AS INTEGER) AS match_ord FROM ({_matches_sql(GENERIC, 'main')})")
def extract_candidates(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "param", "value_raw", "pattern_ord", "match_ord")


_WORDS_SQL = "list_filter(string_split(param, '_'), lambda w: length(w) > 3)"
_SCORED_SQL = f"""
SELECT doc_id, lib, param, value_raw, pattern_ord, match_ord, CASE WHEN kind = 'integer' THEN trunc(TRY_CAST(value_raw AS DOUBLE)) END AS value_num,
  round(CAST(base AS DOUBLE) * quality * 0.9 * CASE WHEN lib = 'fallback' THEN 0.8 ELSE 1.0 END, 6) AS confidence
FROM (SELECT *, CASE WHEN kind = 'integer' THEN 0.85 ELSE 0.75 END AS base,
  CASE WHEN trim(c) = '' THEN 0.7 ELSE greatest(0.5, least(1.0,
    CASE WHEN regexp_matches(c, '^[ ]*[0-9.]+[ ]*$') THEN least(s, 0.6) ELSE s END)) END AS quality
  FROM (SELECT *, 0.6 + CASE WHEN hits >= 2 THEN 0.2 WHEN hits = 1 THEN 0.1 ELSE 0 END
      + CASE WHEN regexp_matches(c, '\\b(was|were|is|are|set to|fixed at|consisted of)\\b') THEN 0.05 ELSE 0 END
      - CASE WHEN regexp_matches(c, '\\b(approximately|about|around|roughly|perhaps|maybe)\\b') THEN 0.1 ELSE 0 END AS s
    FROM (SELECT *, len(list_filter({_WORDS_SQL}, lambda w: contains(c, w))) AS hits
      FROM (SELECT *, lower(substr(text, greatest(1, instr(text, value_raw) - 50), length(value_raw) + 100)) AS c FROM ({{found}}) f))))
"""  # noqa: E501
_MAIN_SCORED = _SCORED_SQL.format(found=_matches_sql(GENERIC, "main"))
_BOTH_SCORED = _SCORED_SQL.format(found=f"{_matches_sql(GENERIC, 'main')} UNION ALL {_matches_sql(GENERIC_FALLBACK, 'fallback')}")


@query(f"SELECT doc_id, param, value_raw, value_num, confidence FROM ({_MAIN_SCORED})")
def extract_scored(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "param", "value_raw", "value_num", "confidence")


_BEST_SQL = "SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY doc_id, param ORDER BY confidence DESC, pattern_ord, match_ord) = 1"


@query(f"SELECT doc_id, param, value_raw, confidence FROM ({_BEST_SQL.format(rows=_MAIN_SCORED)})")
def extract_best(spark, sf_dir):
    return extract.best(_found(spark, sf_dir), ["doc_id", "param"]).select("doc_id", "param", "value_raw", "confidence")


@query(f"SELECT param, count(*) AS documents, round(avg(confidence), 6) AS avg_confidence FROM ({_BEST_SQL.format(rows=_MAIN_SCORED)}) GROUP BY param")
def param_counts(spark, sf_dir):
    rows = extract.best(_found(spark, sf_dir), ["doc_id", "param"])
    return rows.groupBy("param").agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(
    f"WITH s AS ({_BOTH_SCORED}), k AS (SELECT * FROM s WHERE lib = 'main' OR NOT EXISTS (SELECT 1 FROM s m WHERE m.lib = 'main' AND m.doc_id = s.doc_id AND m.param = s.param)) "
    "SELECT doc_id, param, lib, value_raw, confidence FROM (" + _BEST_SQL.format(rows="SELECT * FROM k") + ")"
)
def fallback_library(spark, sf_dir):
    rows = extract.candidates_with_fallback(table(spark, sf_dir, "documents"), GENERIC, GENERIC_FALLBACK, ["doc_id"], ignore_case=False)
    return extract.best(rows, ["doc_id", "param"], main_first=True).select("doc_id", "param", "lib", "value_raw", "confidence")


_CLEAN_SQL = "regexp_replace(text, '([\\p{L}\\p{M}\\p{Nd}_]+)-[\\t\\n\\x0b\\f\\r \\x{85}\\p{Z}]+([\\p{L}\\p{M}\\p{Nd}_]+)', '\\1\\2', 'g')"
_TIDY_SQL = f"translate(regexp_replace({_CLEAN_SQL}, '_+|\\*+', '', 'g'), '�×', '=x')"


@query(f"SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars, CAST(len(list_filter(regexp_split_to_array(t, '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> '')) AS INTEGER) AS words FROM (SELECT doc_id, {_TIDY_SQL} AS t FROM documents)")
def clean_text(spark, sf_dir):
    t = tx.tidy_layout(tx.clean_text(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"), tx.word_count(F.col("t")).alias("words"))


@query("""
SELECT doc_id, md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x)), chr(10))) AS digest
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \\t]*[0-9]{1,3}[ \\t]*$', '', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[ \\t]+([.,;:!?])', '\\1', 'g'), '([.,;:!?])([A-Za-z])', '\\1 \\2', 'g') AS t FROM documents)
""")
def clean_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_markdown(F.col("text"))).alias("digest"))


_FLAT = "replace(text, chr(10), ' ')"
_THIRD = f"substr({_FLAT}, CAST({{k}} * length(text) // 3 AS INTEGER) + 1, CAST(({{k}} + 1) * length(text) // 3 - {{k}} * length(text) // 3 AS INTEGER))"
_STRIP = "regexp_replace({x}, '^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g')"


def _thirds(docs: DataFrame):
    flat, n = F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.length("text")
    cut = lambda k: F.floor(n * k / 3).cast("int")
    return docs, [F.substring(flat, cut(k) + 1, cut(k + 1) - cut(k)) for k in range(3)]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS section, md5({_STRIP.format(x=_THIRD.format(k=k))}) AS digest FROM documents WHERE {_STRIP.format(x=_THIRD.format(k=k))} <> ''" for k, name in enumerate(["introduction", "methods", "results"])) + ")")
def section_split(spark, sf_dir):
    docs, (a, b, c) = _thirds(table(spark, sf_dir, "documents"))
    built = docs.select("doc_id", F.concat(F.lit("1. Introduction\n"), a, F.lit("\n2. Methods\n"), b, F.lit("\nResults\n"), c).alias("text"))
    return structure.sections(built, ["doc_id"], longest=20).select("doc_id", "section", F.md5("body").alias("digest"))


@query(
    "SELECT doc_id, CAST(1 AS INTEGER) AS number, 'First task' AS title, CAST(length(" + _THIRD.format(k=0) + ") + 1 + length('Behavioral Experiment 1: First task') AS INTEGER) AS chars FROM documents UNION ALL "
    "SELECT doc_id, 2, 'Second task', CAST(length(" + _THIRD.format(k=1) + ") + 1 + length('Experiment Two: Second task') AS INTEGER) FROM documents UNION ALL "
    "SELECT doc_id, 3, 'Experiment 3', CAST(length(" + _THIRD.format(k=2) + ") + 1 + length('3. Task III') AS INTEGER) FROM documents"
)
def experiment_split(spark, sf_dir):
    docs, (a, b, c) = _thirds(table(spark, sf_dir, "documents"))
    built = docs.select("doc_id", F.concat(F.lit("Behavioral Experiment 1: First task\n"), a, F.lit("\nExperiment Two: Second task\n"), b, F.lit("\n3. Task III\n"), c).alias("text"))
    return structure.experiments(built, ["doc_id"]).select("doc_id", "number", "title", F.length("body").alias("chars"))


@query("""
SELECT doc_id, i AS chunk, CAST((i // 10) + 1 AS INTEGER) AS page, md5(p) AS digest
FROM (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g')), lambda x: length(x) > 50) AS l FROM documents))
""")
def paragraph_chunks(spark, sf_dir):
    parts = tx.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("i", "p")).select("doc_id", F.col("i").cast("bigint").alias("chunk"), F.col("p.page").alias("page"), F.md5("p.text").alias("digest"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(CAST(greatest(ceil((len(w) - 10) / 90.0), 1) AS BIGINT))) AS chunk FROM w)
SELECT doc_id, chunk, CAST(len(w[chunk * 90 + 1 : chunk * 90 + 100]) AS INTEGER) AS words, md5(array_to_string(w[chunk * 90 + 1 : chunk * 90 + 100], ' ')) AS digest FROM c
""")
def token_chunks(spark, sf_dir):
    chunks = tx.token_chunks(F.split("text", " "), 100, 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks).alias("i", "c")).select("doc_id", F.col("i").cast("bigint").alias("chunk"), F.size("c").alias("words"), F.md5(F.array_join("c", " ")).alias("digest"))


@query("""
SELECT doc_id, has_tables, has_figures, is_scanned, is_multi_column, score,
  CASE WHEN has_tables OR has_figures OR is_scanned OR score >= 5 THEN 'layout_model' ELSE 'layout_text' END AS route
FROM (SELECT *, CAST(2 * CAST(has_tables AS INTEGER) + CAST(has_figures AS INTEGER) + 3 * CAST(is_scanned AS INTEGER) + 2 * CAST(is_multi_column AS INTEGER) AS INTEGER) AS score
FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'table')) >= 2 AS has_tables, len(regexp_extract_all(text, 'Figure|Fig\\.')) >= 2 AS has_figures, length(text) < 500 AS is_scanned,
  len(l) > 0 AND len(list_filter(l, lambda x: length(trim(x)) < 60)) > 0.6 * len(l) AS is_multi_column
FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))
""")
def layout_route(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.complexity(F.col("text")).alias("t"))
    return t.select("doc_id", "t.*", tx.route(F.col("t")).alias("route"))


_LISTING_SQL = "SELECT page_id, '/r/' || CASE page_id % 7 WHEN 0 THEN '.git/' WHEN 1 THEN 'a/build/' ELSE 'src/' END || CASE WHEN page_id % 11 = 0 THEN 'yarn.lock' ELSE 'f' || page_id || CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.JSON' WHEN 2 THEN '.pdf' WHEN 3 THEN '.xyz' ELSE '.md' END END AS path FROM pages"


def _listing(spark, sf_dir):
    ends = F.expr("case page_id % 5 when 0 then '.py' when 1 then '.JSON' when 2 then '.pdf' when 3 then '.xyz' else '.md' end")
    name = F.when(F.col("page_id") % 11 == 0, F.lit("yarn.lock")).otherwise(F.concat(F.lit("f"), F.col("page_id").cast("string"), ends))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/r/"), F.expr("case page_id % 7 when 0 then '.git/' when 1 then 'a/build/' else 'src/' end"), name).alias("path"))


@query(f"""
SELECT path, k AS kind, CAST(CASE k WHEN 'json' THEN 0 WHEN 'python' THEN 3 WHEN 'pdf' THEN 9 ELSE 10 END AS INTEGER) AS prio
FROM (SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.JSON' THEN 'json' WHEN path LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.md' THEN 'markdown' END AS k
  FROM ({_LISTING_SQL}) WHERE path NOT LIKE '%/.git/%' AND path NOT LIKE '%/build/%' AND path NOT LIKE '%yarn.lock') WHERE k IS NOT NULL
""")
def discover_files(spark, sf_dir):
    return files.prioritise(files.discover(_listing(spark, sf_dir), "/r")).select("path", "kind", F.col("prio.kind").alias("prio"))


@query("""
WITH f AS (SELECT 'f' || page_id || '.ocr.pdf' AS name FROM pages UNION ALL SELECT 'f' || page_id || '.pdf' FROM pages WHERE page_id % 3 = 0)
SELECT name FROM f WHERE name NOT LIKE '%.ocr.pdf' OR replace(name, '.ocr.pdf', '.pdf') NOT IN (SELECT name FROM f)
""")
def ocr_twins(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = lambda end: F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(end)).alias("name")
    return files.without_ocr_twins(pages.select(name(".ocr.pdf")).unionByName(pages.where("page_id % 3 = 0").select(name(".pdf"))))


_NAMES_SQL = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Smith et al ' || (1990 + c_custkey % 30) || ' - Title.pdf' WHEN 1 THEN 'Van Dyk - ' || (1990 + c_custkey % 30) || ' - On Reaching' WHEN 2 THEN 'notes  on_ learning.TXT' ELSE 'Lee_' || (2000 + c_custkey % 20) || '.PDF' END AS name FROM customer"
_NAMES = "case c_custkey % 4 when 0 then concat('Smith et al ', 1990 + c_custkey % 30, ' - Title.pdf') when 1 then concat('Van Dyk - ', 1990 + c_custkey % 30, ' - On Reaching') when 2 then 'notes  on_ learning.TXT' else concat('Lee_', 2000 + c_custkey % 20, '.PDF') end"


@query(f"""
SELECT c_custkey, CASE WHEN regexp_extract(name, '^([A-Za-z]+).*?([0-9]{{4}})', 2) <> '' THEN regexp_extract(name, '^([A-Za-z]+).*?([0-9]{{4}})', 1) || regexp_extract(name, '^([A-Za-z]+).*?([0-9]{{4}})', 2) ELSE string_split(name, ' ')[1] END || '_EXP2' AS study_id,
  string_split(string_split(name, ' - ')[1], ' ')[1] || coalesce(list_filter(string_split(name, ' - '), lambda p: regexp_full_match(p, '[0-9]{{4}}'))[1], 'Unknown') || '_E1' AS experiment_id,
  regexp_replace(trim(lower(regexp_replace(name, '\\.(pdf|PDF|txt|TXT)$', ''))), '[_ \\t\\r\\n]+', '_', 'g') AS paper_id,
  lower(regexp_extract(name, '([A-Za-z]+)[_ \\t]*([0-9]{{4}})', 1)) AS author, regexp_extract(name, '([A-Za-z]+)[_ \\t]*([0-9]{{4}})', 2) AS year
FROM ({_NAMES_SQL})
""")
def paper_names(spark, sf_dir):
    n = F.col("name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAMES).alias("name"))
    return rows.select("c_custkey", tx.study_id(n, F.lit(2)).alias("study_id"), tx.experiment_id(n, F.lit(1)).alias("experiment_id"), tx.paper_id(n).alias("paper_id"), tx.author_year(n)["author"].alias("author"), tx.author_year(n)["year"].alias("year"))


_RAW = "case p_partkey % 5 when 0 then concat(p_size, '.7 cm') when 1 then 'sixty young adults' when 2 then concat('-', p_size, '.2') when 3 then 'n/a' else cast(p_size as string) end"


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trunc(n) ELSE n END AS value_num, CAST(CASE WHEN n IS NULL THEN 0.5 ELSE 0.85 END AS DOUBLE) AS base, round(n * CASE WHEN p_partkey % 3 = 0 THEN 2.54 WHEN p_partkey % 3 = 1 THEN 0.1 ELSE 1.0 END, 6) AS in_cm
FROM (SELECT p_partkey, TRY_CAST(CASE p_partkey % 5 WHEN 0 THEN p_size || '.7' WHEN 1 THEN '60' WHEN 2 THEN '-' || p_size || '.2' WHEN 3 THEN '' ELSE p_size || '' END AS DOUBLE) AS n FROM part)
""")
def typed_values(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_RAW).alias("raw"), F.when(F.col("p_partkey") % 2 == 0, "integer").otherwise("float").alias("kind"))
    unit = F.expr("case p_partkey % 3 when 0 then 'inches' when 1 then 'mm' else 'cm' end")
    t = vl.typed(F.col("raw"), F.col("kind"))
    number = vl.typed(F.col("raw"), F.lit("float"))["value_num"]
    return rows.select("p_partkey", t["value_num"].alias("value_num"), t["base"].alias("base"), F.round(vl.convert(number, unit, F.lit("cm")), 6).alias("in_cm"))


_STOP = ", ".join(f"'{s}'" for s in match.STOP_WORDS)
_PLAIN_SQL = "trim(regexp_replace(regexp_replace({v}, '[-_/°()\\[\\]]', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
_ABBR = " OR ".join(f"(list_contains(gw, '{k}') AND contains(an, '{full}')) OR (list_contains(aw, '{k}') AND contains(gn, '{full}'))" for k, full in match.ABBREVIATIONS.items())
_TYPO = " OR ".join(f"(contains(gn, '{c}') AND contains(an, '{t}')) OR (contains(gn, '{t}') AND contains(an, '{c}'))" for c, t in match.TYPOS)
_FUZZY_SQL = f"""
SELECT key, CASE WHEN g = a THEN 'exact' WHEN gn = an THEN 'normalised' WHEN contains(a, g) OR contains(g, a) OR contains(an, gn) OR contains(gn, an) THEN 'substring' WHEN {_TYPO} THEN 'typo'
  WHEN len(gw) >= 2 AND len(list_intersect(gw, aw)) >= len(gw) * 0.6 THEN 'words'
  WHEN (contains(g, ',') OR contains(a, ',')) AND len(list_intersect(gs, s)) > 0 AND len(list_intersect(gs, s)) >= least(len(gs), len(s)) * 0.5 THEN 'set'
  WHEN len(gx) > 0 AND len(ax) > 0 AND CASE WHEN len(gx) = 1 AND len(ax) = 1 THEN abs(TRY_CAST(gx[1] AS DOUBLE) - TRY_CAST(ax[1] AS DOUBLE)) / greatest(abs(TRY_CAST(gx[1] AS DOUBLE)), 0.001) < 0.05 ELSE gx[1] = ax[1] END THEN 'number'
  WHEN {_ABBR} THEN 'abbreviation' END AS rule
FROM (SELECT *, list_filter(list_distinct(regexp_extract_all(gn, '[A-Za-z0-9_]+')), lambda w: w NOT IN ({_STOP})) AS gw, list_filter(list_distinct(regexp_extract_all(an, '[A-Za-z0-9_]+')), lambda w: w NOT IN ({_STOP})) AS aw,
  list_distinct(list_transform(string_split(g, ','), lambda x: trim(x))) AS gs, list_distinct(list_transform(string_split(a, ','), lambda x: trim(x))) AS s,
  regexp_extract_all(g, '[-+]?[0-9]*\\.?[0-9]+') AS gx, regexp_extract_all(a, '[-+]?[0-9]*\\.?[0-9]+') AS ax
FROM (SELECT key, g, a, {_PLAIN_SQL.format(v="g")} AS gn, {_PLAIN_SQL.format(v="a")} AS an FROM (SELECT key, lower(trim(gold)) AS g, lower(trim(auto)) AS a FROM ({{pairs}}))))
"""  # noqa: E501
_PAIRS = """SELECT p.p_partkey AS key, {case}
FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1"""
_CASES = """CASE p.p_partkey % 6 WHEN 0 THEN p.p_type WHEN 1 THEN concat(p.p_size, ' ms') WHEN 2 THEN concat(p.p_size, ', ', n.p_size, ', 90') WHEN 3 THEN 'continuous feedback of cursor' WHEN 4 THEN concat('rotation_', p.p_size, '°') ELSE p.p_name END AS gold,
 CASE p.p_partkey % 6 WHEN 0 THEN n.p_type WHEN 1 THEN concat(n.p_size, '.0 milliseconds') WHEN 2 THEN concat(n.p_size, ',', p.p_size) WHEN 3 THEN 'continous cursor' WHEN 4 THEN concat('Rotation ', p.p_size) ELSE n.p_name END AS auto"""


@query(_FUZZY_SQL.format(pairs=_PAIRS.format(case=_CASES)))
def fuzzy_rules(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_PAIRS.format(case=_CASES)).select("key", match.fuzzy_rule(F.col("gold"), F.col("auto")).alias("rule"))


@query("""
WITH g AS (SELECT 'S' || c_custkey AS study_id, CASE WHEN c_custkey % 3 = 0 THEN '10.1/' || c_custkey ELSE '' END AS d, 'smith' || c_custkey % 40 AS author, CAST(1990 + c_custkey % 20 AS VARCHAR) AS year FROM customer),
a AS (SELECT 'Smith' || s_suppkey % 40 || ' ' || (1990 + s_suppkey % 20) || ' n' || s_suppkey AS auto_id, CASE WHEN s_suppkey % 2 = 0 THEN '10.1/' || s_suppkey ELSE '' END AS d, s_suppkey AS ord FROM supplier),
t1 AS (SELECT study_id, auto_id FROM g JOIN a ON g.d = a.d AND g.d <> '' QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY ord) = 1),
t2 AS (SELECT study_id, auto_id FROM g JOIN a ON contains(lower(auto_id), author) AND contains(auto_id, year) WHERE study_id NOT IN (SELECT study_id FROM t1) QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY ord) = 1)
SELECT *, 'doi' AS tier FROM t1 UNION ALL SELECT *, 'author_year' FROM t2
""")
def study_match(spark, sf_dir):
    gold = table(spark, sf_dir, "customer").selectExpr("concat('S', c_custkey) study_id", "case when c_custkey % 3 = 0 then concat('https://doi.org/10.1/', c_custkey) else '' end doi", "concat('smith', c_custkey % 40) author", "cast(1990 + c_custkey % 20 as string) year")
    auto = table(spark, sf_dir, "supplier").selectExpr("concat('Smith', s_suppkey % 40, ' ', 1990 + s_suppkey % 20, ' n', s_suppkey) auto_id", "case when s_suppkey % 2 = 0 then concat('DOI 10.1/', s_suppkey) else '' end doi", "s_suppkey ord")
    return match.match_studies(gold, auto)


_LABELS_SQL = """
WITH gold AS (SELECT doc_id, 'quality' AS param, CAST(quality AS VARCHAR) AS v FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 10 = 0 THEN '?' ELSE CAST(toxic AS VARCHAR) END FROM labels),
auto AS (SELECT doc_id, 'quality' AS param, CASE WHEN n_chars >= 500 THEN '1' ELSE '0' END AS v FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'toxic', CASE WHEN contains(text, 'idiot') THEN '1' ELSE '0' END FROM documents WHERE doc_id % 5 <> 0),
l AS (SELECT coalesce(g.doc_id, a.doc_id) AS doc_id, coalesce(g.param, a.param) AS param, g.v AS gv, a.v AS av FROM (SELECT * FROM gold WHERE v <> '?') g FULL JOIN (SELECT * FROM auto WHERE doc_id IN (SELECT doc_id FROM labels)) a ON g.doc_id = a.doc_id AND g.param = a.param),
labels_ AS (SELECT *, CASE WHEN gv IS NULL THEN 'FP' WHEN av IS NULL THEN 'FN' WHEN gv = av THEN 'TP' ELSE 'VM' END AS label FROM l)
"""
_METRICS_SQL = """tp, fp, fn, vm, precision, recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
FROM (SELECT *, round(CASE WHEN tp + fp + vm = 0 THEN 0 ELSE tp / (tp + fp + vm) END, 6) AS precision, round(CASE WHEN {base} = 0 THEN 0 ELSE tp / {base} END, 6) AS recall
FROM (SELECT {by} CAST(count(*) FILTER (label = 'TP') AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 'FP') AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 'FN') AS DOUBLE) AS fn, CAST(count(*) FILTER (label = 'VM') AS DOUBLE) AS vm FROM labels_ {group}) {join})"""


def _confusion(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = F.when(F.col("doc_id") % 10 == 0, "?").otherwise(F.col("toxic").cast("string"))
    gold = labels.select("doc_id", F.col("quality").cast("string").alias("quality"), toxic.alias("toxic")).unpivot(["doc_id"], ["quality", "toxic"], "param", "value").withColumnRenamed("doc_id", "study_id")
    quality = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("auto_id"), F.lit("quality").alias("param"), F.when(F.col("n_chars") >= 500, "1").otherwise("0").alias("value"))
    toxic = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("auto_id"), F.lit("toxic").alias("param"), F.when(F.contains("text", F.lit("idiot")), "1").otherwise("0").alias("value"))
    studies = labels.select(F.col("doc_id").alias("study_id"), F.col("doc_id").alias("auto_id"))
    return gold, match.compare(gold, quality.unionByName(toxic), studies, fuzzy=False)


@query(_LABELS_SQL + "SELECT doc_id AS study_id, param, label FROM labels_")
def confusion_labels(spark, sf_dir):
    return _confusion(spark, sf_dir)[1].select("study_id", "param", "label")


@query(_LABELS_SQL + "SELECT " + _METRICS_SQL.format(by="", group="", base="(tp + fn)", join=""))
def validation_overall(spark, sf_dir):
    return match.metrics(_confusion(spark, sf_dir)[1])


@query(_LABELS_SQL + "SELECT param, total_gold, " + _METRICS_SQL.format(by="param,", group="GROUP BY param", base="total_gold", join="JOIN (SELECT param, CAST(count(*) AS DOUBLE) AS total_gold FROM gold WHERE v <> '?' GROUP BY param) t USING (param)"))
def validation_by_param(spark, sf_dir):
    gold, labels = _confusion(spark, sf_dir)
    total = gold.where(tx.annotated(F.col("value"))).groupBy("param").agg(F.count("*").cast("double").alias("total_gold"))
    return match.metrics(labels, ["param"], total)


@query(_LABELS_SQL + "SELECT param, count(*) FILTER (label = 'VM') AS mismatched, count(*) FILTER (label = 'FN') AS missing, count(DISTINCT CASE WHEN label = 'VM' THEN gv || '|' || av END) AS pairs FROM labels_ GROUP BY param")
def value_mismatches(spark, sf_dir):
    return match.mismatches(_confusion(spark, sf_dir)[1]).select("param", "mismatched", "missing", F.coalesce(F.size("pairs"), F.lit(0)).cast("bigint").alias("pairs"))


_FOUND_SQL = "SELECT user_id AS study_id, event_type AS param, CASE WHEN event_id % 3 = 0 THEN 'regex' WHEN event_id % 3 = 1 THEN 'task1' ELSE 'task2' END AS source FROM events WHERE event_id % 4 = 0"


@query(f"""
WITH f AS ({_FOUND_SQL}), g AS (SELECT DISTINCT user_id AS study_id, event_type AS param FROM events),
c AS (SELECT g.*, EXISTS (SELECT 1 FROM f WHERE f.study_id = g.study_id AND f.param = g.param AND source = 'regex') AS r, EXISTS (SELECT 1 FROM f WHERE f.study_id = g.study_id AND f.param = g.param AND source = 'task1') AS t FROM g)
SELECT param, count(*) AS gold, count(*) FILTER (NOT r) AS misses, count(*) FILTER (NOT r AND t) AS recovered, round(coalesce(count(*) FILTER (NOT r AND t) / nullif(count(*) FILTER (NOT r), 0), 0), 6) AS rate FROM c GROUP BY param
""")
def task_recovery(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    source = F.when(F.col("event_id") % 3 == 0, "regex").when(F.col("event_id") % 3 == 1, "task1").otherwise("task2")
    source = F.when(F.col("event_id") % 4 == 0, source).otherwise("none")  # three of four events are found by no task
    found = ev.select(F.col("user_id").alias("study_id"), F.col("event_type").alias("param"), source.alias("source"))
    return match.recovery(ev.select(F.col("user_id").alias("study_id"), F.col("event_type").alias("param")), found, ["param"])


def _user_params(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.where("value > 60").select("user_id", F.col("event_type").alias("param"), F.round("value", 1).alias("value"), (F.col("value") / 1000).alias("confidence")), ev.select("user_id")


_COVER_SQL = "SELECT *, round(100.0 * n / total, 6) AS pct FROM (SELECT event_type AS param, count(DISTINCT user_id) AS n, count(DISTINCT round(value, 1)) AS distinct_values, round(avg(value / 1000), 6) AS avg_confidence, (SELECT count(DISTINCT user_id) FROM events) AS total FROM events WHERE value > 60 GROUP BY 1)"


@query(_COVER_SQL)
def coverage(spark, sf_dir):
    params, scopes = _user_params(spark, sf_dir)
    return report.coverage(params, scopes, "user_id")


@query(f"SELECT tier, count(*) AS params, round(avg(pct), 6) AS avg_pct FROM (SELECT *, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' WHEN pct >= 25 THEN 'low' ELSE 'very_low' END AS tier FROM ({_COVER_SQL})) GROUP BY tier")
def coverage_tiers(spark, sf_dir):
    params, scopes = _user_params(spark, sf_dir)
    return report.coverage(params, scopes, "user_id").groupBy(report.tier(F.col("pct")).alias("tier")).agg(F.count("*").alias("params"), F.round(F.avg("pct"), 6).alias("avg_pct"))


@query(f"SELECT p.param, coalesce(c.pct, 0.0) AS pct, CASE WHEN coalesce(c.pct, 0) <= 0 THEN 'CRITICAL' WHEN c.pct < 25 THEN 'HIGH' WHEN c.pct < 50 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM (SELECT DISTINCT event_type AS param FROM events UNION SELECT 'never_found') p LEFT JOIN ({_COVER_SQL}) c ON c.param = p.param ORDER BY pct, p.param LIMIT 15")
def coverage_suggestions(spark, sf_dir):
    params, scopes = _user_params(spark, sf_dir)
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("param")).unionByName(spark.createDataFrame([("never_found",)], "param string"))
    return report.suggestions(report.coverage(params, scopes, "user_id"), names)


@query("SELECT user_id, param FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type AS param FROM events) EXCEPT SELECT user_id, event_type FROM events WHERE value > 60")
def missing_matrix(spark, sf_dir):
    params, scopes = _user_params(spark, sf_dir)
    return report.missing(params, scopes, table(spark, sf_dir, "events").select(F.col("event_type").alias("param")), "user_id")


@query("""
WITH e AS (SELECT user_id, hour(ts) AS experiment, event_type AS param FROM events), n AS (SELECT user_id, experiment, count(DISTINCT param) AS n FROM e GROUP BY ALL)
SELECT user_id, array_to_string(list(n ORDER BY experiment), ',') AS param_counts, (SELECT string_agg(DISTINCT param, ',' ORDER BY param) FROM e WHERE e.user_id = n.user_id) AS all_params FROM n GROUP BY user_id
""")
def paper_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("experiment"), F.col("event_type").alias("param"))
    out = report.paper_rollup(rows, "user_id", "experiment", "param")
    return out.select("user_id", F.array_join("param_counts", ",").alias("param_counts"), F.array_join("all_params", ",").alias("all_params"))


@query("SELECT n, count(*) AS keys FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY n")
def events_histogram(spark, sf_dir):
    return report.histogram(table(spark, sf_dir, "events"), "user_id")


@query("SELECT o_orderstatus AS entry_status, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS conflicts, count(DISTINCT o_custkey) AS papers FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return report.status_counts(o.select(F.col("o_orderstatus").alias("entry_status"), (F.col("o_totalprice") > 150000).alias("conflict_flag"), F.col("o_custkey").alias("paper_id")))


def _hierarchy(spark, sf_dir):
    """customer, orders, lineitem as experiments, sessions, blocks; trials of every third line."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    line = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
    return {
        "experiments": c.selectExpr("cast(c_custkey as string) id", "c_name name", "cast(c_nationkey as string) paper_id", "c_custkey % 5 = 0 is_multi_experiment", "case when c_custkey % 5 <> 0 then cast(c_custkey - c_custkey % 5 as string) end parent_experiment_id", "cast(c_custkey % 5 as int) experiment_number", "case when c_acctbal < 0 then 'needs_review' else 'validated' end entry_status", "c_acctbal < 0 conflict_flag", "timestamp'2020-01-01 00:00:00' created_at", "timestamp'2020-01-01 00:00:00' updated_at"),
        "sessions": o.selectExpr("cast(o_orderkey as string) id", "cast(o_custkey as string) experiment_id", "cast(o_orderkey % 10 as int) session_number"),
        "blocks": li.selectExpr(f"{line} id", "cast(l_orderkey as string) session_id", "l_linenumber block_number", "l_returnflag block_type", "l_quantity rotation_magnitude_deg", "l_tax feedback_delay_ms", "l_linestatus = 'O' cursor_visible"),
        "trials": li.where("l_linenumber % 3 = 0").selectExpr(f"concat({line}, 't') id", f"{line} block_id", "1 trial_number", "case when l_linenumber = 3 then l_discount end rotation_magnitude_deg", "cast(null as double) feedback_delay_ms", "cast(null as boolean) cursor_visible"),
    }


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS experiment_id, CAST(o_orderkey AS VARCHAR) AS session_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS block_id, CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || 't' END AS trial_id, CASE WHEN l_linenumber = 3 THEN l_discount ELSE l_quantity END AS rotation_magnitude_deg
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
""")
def hierarchy_full(spark, sf_dir):
    store.create_temp_views(_hierarchy(spark, sf_dir))
    return spark.table("v_full_hierarchy").select("experiment_id", "session_id", "block_id", "trial_id", "rotation_magnitude_deg")


@query("SELECT CAST(p.c_custkey AS VARCHAR) AS parent_id, CAST(c.c_custkey AS VARCHAR) AS child_id, CAST(c.c_custkey % 5 AS INTEGER) AS experiment_number FROM customer p LEFT JOIN customer c ON c.c_custkey % 5 <> 0 AND c.c_custkey - c.c_custkey % 5 = p.c_custkey WHERE p.c_custkey % 5 = 0")
def self_hierarchy(spark, sf_dir):
    store.create_temp_views(_hierarchy(spark, sf_dir))
    return spark.table("v_experiment_tree_roots").select("parent_id", "child_id", "experiment_number")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS paper_id, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS ids FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1")
def groups_listagg(spark, sf_dir):
    store.create_temp_views(_hierarchy(spark, sf_dir))
    return spark.table("v_multi_experiment_papers").select("paper_id", "n", "ids")


@query("SELECT 'reference experiment_id' AS \"check\", 'sessions' AS \"table\", (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)) AS n UNION ALL SELECT 'status', 'experiments', 0 UNION ALL SELECT 'reference session_id', 'blocks', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'reference block_id', 'trials', 0")
def store_violations(spark, sf_dir):
    t = _hierarchy(spark, sf_dir)
    return store.violations(t | {"experiments": t["experiments"].where("cast(id as bigint) % 9 <> 0")})


_SOURCES_SQL = "SELECT l_partkey AS k, 'price' AS param, CAST(l_quantity AS INTEGER) || '' AS value, CASE l_suppkey % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'config_files' WHEN 2 THEN 'pdf_methods' WHEN 3 THEN 'llm_inference' ELSE 'other' END AS source_type, CAST(l_linenumber AS DOUBLE) / 10 AS confidence, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"


def _values(spark, sf_dir):
    source = "case l_suppkey % 5 when 0 then 'code' when 1 then 'config_files' when 2 then 'pdf_methods' when 3 then 'llm_inference' else 'other' end source_type"
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey k", "'price' param", "cast(cast(l_quantity as int) as string) value", source, "cast(l_linenumber as double) / 10 confidence", "l_orderkey * 10 + l_linenumber ord")


_RANK_SQL = "CASE source_type WHEN 'trial_logs' THEN 0 WHEN 'config_files' THEN 1 WHEN 'code' THEN 2 WHEN 'pdf_methods' THEN 3 WHEN 'llm_inference' THEN 4 ELSE 5 END"
_PRECEDENCE_SQL = f"""
SELECT k, param, n, distinct_values, CASE WHEN n = 1 OR round(c1 - c2, 9) > 0.2 THEN v1 ELSE vr END AS value, CASE WHEN n = 1 OR round(c1 - c2, 9) > 0.2 THEN c1 ELSE cr END AS confidence, CASE WHEN n = 1 OR round(c1 - c2, 9) > 0.2 THEN s1 ELSE sr END AS source_type
FROM (SELECT k, param, count(*) AS n, count(DISTINCT value) AS distinct_values, max(value) FILTER (r1 = 1) AS v1, max(confidence) FILTER (r1 = 1) AS c1, max(source_type) FILTER (r1 = 1) AS s1, max(confidence) FILTER (r1 = 2) AS c2, max(value) FILTER (r2 = 1) AS vr, max(confidence) FILTER (r2 = 1) AS cr, max(source_type) FILTER (r2 = 1) AS sr
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, ord) AS r1, row_number() OVER (PARTITION BY k ORDER BY {_RANK_SQL}, ord) AS r2 FROM ({_SOURCES_SQL})) GROUP BY k, param)
"""


@query(_PRECEDENCE_SQL)
def conflict_precedence(spark, sf_dir):
    return resolve.by_precedence(_values(spark, sf_dir), ["k", "param"])


@query(f"SELECT k, param, n, CASE WHEN greatest(hi - m, m - lo) <= abs(m) * 60 / 100 THEN m END AS mean FROM (SELECT k, param, count(*) AS n, avg(CAST(value AS DOUBLE)) AS m, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi FROM ({_SOURCES_SQL}) GROUP BY ALL)")
def conflict_tolerance(spark, sf_dir):
    return resolve.by_tolerance(_values(spark, sf_dir), ["k", "param"], F.lit(60.0))


@query(f"SELECT k, param, CASE WHEN votes >= 2 THEN value END AS value, votes FROM (SELECT k, param, value, count(*) AS votes, min(ord) AS f FROM ({_SOURCES_SQL}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY votes DESC, f) = 1")
def conflict_consensus(spark, sf_dir):
    return resolve.by_consensus(_values(spark, sf_dir), ["k", "param"])


@query(f"SELECT k, param, CASE WHEN n > 1 AND distinct_values > 1 AND k % 2 = 0 THEN NULL ELSE value END AS value, distinct_values > 1 AS conflict_detected, CASE WHEN k % 2 = 0 THEN 'manual' ELSE 'precedence' END AS policy FROM ({_PRECEDENCE_SQL.replace('param', 'param')})".replace("SELECT k, param, CASE WHEN n > 1", "SELECT k, CASE WHEN k % 2 = 0 THEN 'instruction_awareness' ELSE 'price' END AS param, CASE WHEN n > 1", 1))
def conflict_resolve(spark, sf_dir):
    rows = _values(spark, sf_dir).withColumn("param", F.when(F.col("k") % 2 == 0, "instruction_awareness").otherwise("price"))
    return resolve.resolve(rows, ["k"]).select("k", "param", "value", "conflict_detected", "policy")


@query("""
WITH r AS (SELECT c_custkey AS k, c_nationkey AS v, 0.3 + (c_custkey % 7) / 10.0 AS c FROM customer WHERE c_custkey % 3 <> 0), m AS (SELECT c_custkey AS k, c_nationkey + c_custkey % 2 AS v, 0.35 + (c_custkey % 6) / 10.0 AS c FROM customer WHERE c_custkey % 4 <> 0),
j AS (SELECT coalesce(r.k, m.k) AS k, r.v AS rv, r.c AS rc, m.v AS mv, m.c AS mc, CASE WHEN m.c IS NULL THEN 'regex_only' WHEN r.c IS NULL AND m.c >= 0.7 THEN 'auto_accepted' WHEN r.c IS NULL THEN 'requires_review' WHEN r.v = m.v THEN 'agreed' ELSE 'conflict' END AS status FROM r FULL JOIN m ON r.k = m.k)
SELECT k, CAST(CASE WHEN rc IS NULL OR (status = 'conflict' AND round(mc - rc, 9) > 0.2) THEN mv ELSE rv END AS VARCHAR) AS value, status FROM j
""")
def auto_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    r = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey k", "cast(c_nationkey as string) value", "0.3D + (c_custkey % 7) / 10D confidence")
    m = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey k", "cast(c_nationkey + c_custkey % 2 as string) value", "0.35D + (c_custkey % 6) / 10D confidence")
    return resolve.auto_merge(r, m, ["k"]).select("k", "value", "status")


def _dedup(strategy):
    order = {"first": "doc_id", "last": "doc_id DESC", "most_params": "CASE WHEN doc_id % 6 = 0 THEN 0 ELSE n_chars END DESC, doc_id"}[strategy]
    sql = f"SELECT k AS paper_key, doc_id AS ord, count(*) OVER (PARTITION BY k) AS copies FROM (SELECT *, regexp_replace(lower(source || '  ' || substr(text, 1, 3)), '[_ \\t\\r\\n]+', '_', 'g') AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY {order}) = 1"

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("  "), F.substring("text", 1, 3), F.lit(".pdf")).alias("paper_name"), F.col("n_chars").alias("n_params"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 6 != 0).alias("success"))
        return resolve.dedup(rows, strategy).select("paper_key", "ord", "copies")

    # names end in white space only where the text does; those are trimmed before the blanks merge
    sql = sql.replace("lower(source || '  ' || substr(text, 1, 3))", "trim(lower(source || '  ' || substr(text, 1, 3)))")
    run.__name__ = f"dedup_{strategy}"
    query(sql)(run)


for _s in ("first", "last", "most_params"):
    _dedup(_s)


_PROPOSALS_SQL = "SELECT event_type || '_' || user_id % 20 AS name, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS importance, CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'odd' END AS prevalence, value / 1000 AS confidence, 'u' || user_id % 5 AS source, event_id AS ord, 'd' || event_id AS description FROM events"
_LEVEL_SQL = "CASE {c} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END"


def _proposals(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("concat(event_type, '_', user_id % 20) name", "case event_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end importance", "case user_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'odd' end prevalence", "value / 1000 confidence", "concat('u', user_id % 5) source", "event_id ord", "concat('d', event_id) description")


@query(f"SELECT name, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max({_LEVEL_SQL.format(c='importance')}) AS importance_rank, max({_LEVEL_SQL.format(c='prevalence')}) AS prevalence_rank, round(avg(confidence), 6) AS avg_confidence FROM ({_PROPOSALS_SQL}) GROUP BY name HAVING count(*) >= 2")
def proposal_stats(spark, sf_dir):
    return report.proposal_stats(_proposals(spark, sf_dir))


@query(f"""
WITH p AS ({_PROPOSALS_SQL}), i AS (SELECT name, importance FROM (SELECT name, importance, count(*) AS c, min(ord) AS f FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY name ORDER BY c DESC, f) = 1), v AS (SELECT name, prevalence FROM (SELECT name, prevalence, count(*) AS c, min(ord) AS f FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY name ORDER BY c DESC, f) = 1)
SELECT name, count(*) AS occurrences, arg_min(description, ord) AS description, any_value(i.importance) AS importance, any_value(v.prevalence) AS prevalence FROM p JOIN i USING (name) JOIN v USING (name) GROUP BY name
""")
def proposal_mode(spark, sf_dir):
    return resolve.consolidate(_proposals(spark, sf_dir)).select("name", "occurrences", "description", "importance", "prevalence")


@query("""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id < 17)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 6
""")
def vector_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # the schema's 17 fields are the queries
    return retrieve.vector_top_k(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id < 17").select(F.col("vec_id").alias("query_id"), "embedding")).select("query_id", "chunk_id", "score", "rank")


@query("SELECT conv_id, string_agg('[p.' || (turn // 2 + 1) || '] ' || substr(text, 1, 1200), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def context_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.col("turn").alias("rank"), "text", (F.floor(F.col("turn") / 2) + 1).alias("page"))
    return retrieve.chunk_context(rows, ["conv_id"])


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_parse(spark, sf_dir):
    p = F.col("props")
    dirty = F.expr("cast(event_id % 4 as int)")
    text = F.when(dirty == 0, p).when(dirty == 1, F.concat(F.lit("Answer:\n```json\n"), p, F.lit("\n```"))).when(dirty == 2, F.concat(F.lit("Here it is: "), p, F.lit(" as asked"))).otherwise(F.concat(F.lit("{"), p, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(vl.parse_json(text), "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, user_id, spent FROM (SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events) WHERE spent <= 500")
def budget_running_total(spark, sf_dir):
    return assist.within_budget(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", 500.0, ["user_id"]).select("event_id", "user_id", "spent")


@query("WITH f AS (SELECT user_id, event_type AS param, max(value / 1000) AS confidence FROM events GROUP BY ALL) SELECT u.user_id, c.param FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'purchase', 'nothing']) AS param) c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = u.user_id AND f.param = c.param AND confidence >= 0.3)")
def model_needed(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    found = ev.groupBy("user_id", F.col("event_type").alias("param")).agg(F.max(F.col("value") / 1000).alias("confidence"))
    return assist.needs_model(found, ev.select("user_id").distinct(), ["click", "purchase", "nothing"], "user_id")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'abstained' WHEN event_id % 7 = 0 THEN 'no_value' WHEN length(props) < CASE WHEN value / 100 >= 0.5 THEN 3 ELSE 12 END THEN 'weak_evidence' ELSE 'accepted' END AS verdict FROM events")
def evidence_filter(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("x"))
    return table(spark, sf_dir, "events").select("event_id", assist.evidence_verdict(F.col("value") / 100, F.col("props"), v, F.col("event_id") % 11 == 0, "missed").alias("verdict"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1 - c_custkey, 'new' FROM customer WHERE c_custkey % 10 = 0")
def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = c.where("c_custkey % 3 = 0").selectExpr("c_custkey id", "'new' segment").unionByName(c.where("c_custkey % 10 = 0").selectExpr("-1 - c_custkey id", "'new' segment"))
    return resolve.upsert(c.selectExpr("c_custkey id", "c_mktsegment segment"), new, "id")


@query("SELECT c_custkey AS experiment_id, 'age' AS parameter_name, CASE WHEN c_custkey % 4 = 0 THEN 'b' WHEN c_custkey % 4 = 1 THEN 'a' ELSE c_mktsegment END AS value, c_custkey % 4 < 2 AS overridden FROM customer")
def manual_overrides(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    params = c.selectExpr("c_custkey experiment_id", "'age' parameter_name", "c_mktsegment value")
    over = c.where("c_custkey % 4 = 0").selectExpr("c_custkey experiment_id", "'age' parameter_name", "'b' override_value", "2 override_timestamp", "1 id")
    over = over.unionByName(c.where("c_custkey % 4 < 2").selectExpr("c_custkey experiment_id", "'age' parameter_name", "'a' override_value", "1 override_timestamp", "0 id"))
    return store.apply_overrides(params, over)


# what a text says, and how many groups that is: written apart from the rule
_DESIGNS = [("A 2x2 factorial design.", 4), ("a 2 × 3 factorial", 6), ("the 3-by-2 factorial", 6), ("targets were 2x2 cm", None), ("Three groups took part", 3), ("4 experimental groups", 4), ("two groups", None), ("13 groups, 24 groups", None), ("a 2 x 4 mixed design", 8), ("no design", None)]
_DESIGN_TEXT = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_DESIGNS)) + " END"
_DESIGN_GROUPS = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {g}" for i, (_, g) in enumerate(_DESIGNS) if g) + " END"


@query(f"SELECT p_partkey, CASE WHEN use THEN per * g ELSE total END AS n_total, CAST(CASE WHEN use THEN 0.95 ELSE conf END AS DOUBLE) AS n_total_conf FROM (SELECT *, g IS NOT NULL AND (total IS NULL OR total = per OR conf < 0.85) AS use FROM (SELECT p_partkey, p_size AS per, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_size ELSE 99 END AS total, CASE WHEN p_partkey % 2 = 0 THEN 0.9 ELSE 0.5 END AS conf, {_DESIGN_GROUPS} AS g FROM part))")
def derived_totals(spark, sf_dir):
    wide = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size sample_size_per_group", "case p_partkey % 3 when 0 then null when 1 then p_size else 99 end n_total", "case when p_partkey % 2 = 0 then 0.9D else 0.5D end n_total_conf", "cast(null as int) sample_size_n", f"{_DESIGN_TEXT} text")
    return extract.derived_totals(wide).select("p_partkey", "n_total", "n_total_conf")


@query("SELECT page_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS block_no, md5(unnest(l)) AS digest FROM (SELECT page_id, list_filter(list_transform(regexp_split_to_array(replace(html, chr(10), ' '), '>[ ]*<'), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)")
def page_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", r"\n", " "), r">[ ]*<", "\n\n").alias("full_text"))
    return files.blocks(pages, ["page_id"]).select("page_id", "block_no", F.md5("text").alias("digest"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    """The events as a file stream, windowed by hour, all that is there processed."""
    path = f"{sf_dir}/events.parque[t]"  # a pattern, so that one file may stand for the folder
    stream = ingest.file_stream(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ingest.windowed_counts(stream, "ts", "event_type").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")
    return ingest.latest_counts(spark, counts, ["hour", "event_type"], scratch_path(spark))


from docsmelt.plans import more_queries  # noqa: E402, F401 - registers its queries here
