"""File discovery and text scans over any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsmelt.functions import text as tx

# File kinds by extension, and folders and files that a scan leaves out.
KINDS = {
    "python": [".py"], "matlab": [".m"], "javascript": [".js", ".jsx", ".ts", ".tsx"], "r": [".r"], "json": [".json"], "yaml": [".yaml", ".yml"], "xml": [".xml"], "ini": [".ini"],
    "txt": [".txt", ".cfg", ".conf"], "csv": [".csv", ".tsv"], "mat": [".mat"], "hdf5": [".h5", ".hdf5"], "pdf": [".pdf"], "markdown": [".md"], "tex": [".tex"],
}
SKIP_DIRS = [".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".mypy_cache", "node_modules", "bower_components", "venv", "env", ".env", "virtualenv", "dist", "build", "out", "target", ".vscode", ".idea", ".eclipse"]
SKIP_FILES = [".DS_Store", "Thumbs.db", "package-lock.json", "yarn.lock", "requirements.lock"]
# The order in which kinds are read.
PRIORITY = ["json", "yaml", "xml", "python", "matlab", "javascript", "csv", "mat", "hdf5", "pdf", "markdown"]


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    return F.create_map(*[F.lit(x) for k, exts in KINDS.items() for e in exts for x in (e, k)])[ext]


def discover(listing: DataFrame, root: str = "", path: str = "path") -> DataFrame:
    """Files of known kinds with kind and name; excluded folders are looked for below ``root`` only."""
    below = F.regexp_replace(F.col(path), F.lit("^" + root.replace("\\", "\\\\").replace(".", "\\.")), F.lit(""))
    parts = F.split(below, "/")
    name = F.element_at(parts, -1)
    ok = ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in SKIP_DIRS])) & ~name.isin(SKIP_FILES)
    return listing.where(ok).withColumns({"name": name, "kind": kind_of(F.col(path))}).where("kind is not null")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def prioritise(files: DataFrame) -> DataFrame:
    """Add ``prio``: kinds in their order, papers and readmes first within theirs."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, k in enumerate(PRIORITY) for x in (k, i)])[F.col("kind")], F.lit(len(PRIORITY)))
    low = F.lower("name")
    first = F.when((F.col("kind") == "pdf") & low.rlike("paper|methods|manuscript|supplementary"), 0).when((F.col("kind") == "markdown") & low.contains("readme"), 0).otherwise(1)
    return files.withColumn("prio", F.struct(rank.alias("kind"), first.alias("first"), F.col("name").alias("name")))


def without_ocr_twins(files: DataFrame, name: str = "name") -> DataFrame:
    """Files but ``X.ocr.pdf`` where ``X.pdf`` is there too."""
    plain = files.where(F.col(name).endswith(".pdf") & ~F.col(name).endswith(".ocr.pdf")).select(F.regexp_replace(name, r"\.pdf$", ".ocr.pdf").alias(name)).distinct()
    return files.join(plain, name, "left_anti")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


Extractor = Callable[[bytes], str]
#: Text extractors by kind; others (PDF layout, OCR) are registered by whoever has their library.
EXTRACTORS: dict[str, Extractor] = {"text": lambda b: b.decode("utf-8", "replace")}


def extract_text(files: DataFrame, by: Extractor = EXTRACTORS["text"], fallback: Extractor | None = None) -> DataFrame:
    """path, full_text, extraction_method, error of (path, content) rows; a failure is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                out, how, error = "", "failed", None
                for name, f in (("primary", by), ("fallback", fallback)):
                    if f is None:
                        continue
                    try:
                        out, how, error = f(bytes(content)), name, None
                        break
                    except Exception as e:  # noqa: BLE001 - extractors may raise anything
                        error = str(e)[:500]
                rows.append((path, out, how, error))
            yield pd.DataFrame(rows, columns=["path", "full_text", "extraction_method", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, full_text string, extraction_method string, error string")


def documents(texts: DataFrame) -> DataFrame:
    """Cleaned documents with counts, layout traits and route."""
    clean = texts.withColumn("full_text", tx.tidy_layout(tx.clean_text(F.col("full_text"))))
    clean = clean.withColumns({"char_count": F.length("full_text"), "word_count": tx.word_count(F.col("full_text")), "traits": tx.complexity(F.col("full_text"))})
    return clean.withColumn("route", tx.route(F.col("traits")))


def uncached(files: DataFrame, cache: DataFrame, mode: str = "default") -> tuple[DataFrame, DataFrame]:
    """(files to extract, cached rows that still hold): the key is path, modification time and mode."""
    keyed = files.withColumn("mode", F.lit(mode))
    keys = ["path", "modificationTime", "mode"]
    return keyed.join(cache.select(*keys), keys, "left_anti"), cache.join(keyed.select(*keys), keys, "left_semi")


def blocks(texts: DataFrame, keys: list[str], text: str = "full_text") -> DataFrame:
    """keys, page, block_no, text: blocks between blank lines, pages between form feeds, both from 1."""
    pages = texts.select(*keys, F.posexplode(F.split(text, "\f")).alias("p", "t"))
    rows = pages.select(*keys, (F.col("p") + 1).alias("page"), F.posexplode(F.split("t", r"\n[ \t]*\n")).alias("b", "text"))
    return rows.select(*keys, "page", (F.col("b") + 1).alias("block_no"), tx.squeeze(F.col("text")).alias("text")).where("text <> ''")


def words(texts: DataFrame, keys: list[str], text: str = "full_text") -> DataFrame:
    """keys, page, block_no, word_no, word."""
    return blocks(texts, keys, text).select(*keys, "page", "block_no", F.posexplode(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")).alias("word_no", "word"))
