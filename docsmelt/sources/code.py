"""Parameters in source code and configuration files.

Syntax trees and recursive key walks have no SQL form; they run in Arrow batches of whole
files.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # a small reader of plain key: value files stands in
    yaml = None

PARAM_ROWS = "path string, name string, value string, source_type string, method string, confidence double, ord int"


def python_params(source: str, aliases: dict[str, str]) -> list[tuple[str, str, str, float]]:
    """(canonical, value, method, confidence) of assignments of literals; later ones win.

    What the syntax tree does not give (a file with errors) is looked for by pattern, at
    0.8 of the confidence.
    """
    found: dict[str, tuple[str, str, float]] = {}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        tree = ast.Module([], [])
    for node in ast.walk(tree):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value else []
        for t in targets:
            name = t.id if isinstance(t, ast.Name) else t.attr if isinstance(t, ast.Attribute) else None
            key = aliases.get((name or "").lower())
            if key:
                try:
                    value = ast.literal_eval(node.value)
                except (ValueError, TypeError, SyntaxError, MemoryError):
                    continue
                found.pop(key, None)
                found[key] = (value if isinstance(value, str) else json.dumps(value, default=str), "ast", 1.0)
    for m in re.finditer(r"(?m)^\s*(?:self\.)?(\w+)\s*=\s*([-+]?[\d.]+|'[^'\n]*'|\"[^\"\n]*\"|True|False)", source):
        key = aliases.get(m[1].lower())
        if key and key not in found:
            found[key] = (m[2].strip("'\""), "regex", 0.8)
    return [(k, *v) for k, v in found.items()]


def walk(data, aliases: dict[str, str]) -> list[tuple[str, str]]:
    """(canonical, value) of leaves below dictionaries; lists are not entered, later keys win."""
    found: dict[str, str] = {}

    def visit(node: dict):
        for key, value in node.items():
            if isinstance(value, dict):
                visit(value)
            elif not isinstance(value, list) and (name := aliases.get(str(key).lower())):
                found[name] = str(value)

    if isinstance(data, dict):
        visit(data)
    return list(found.items())


def parse_yaml(text: str):
    """A YAML document; without PyYAML, plain nested ``key: value`` lines only, and an error for anything else."""
    if yaml is not None:
        return yaml.safe_load(text)
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not line or line == "---":
            continue
        m = re.fullmatch(r"( *)([\w.-]+):(?: +([^\[{&*|>].*))?", line)
        if not m:
            raise ValueError(f"PyYAML is needed to read this line: {line!r}")
        depth, key, value = len(m[1]), m[2], m[3]
        while stack[-1][0] >= depth:
            stack.pop()
        if value:
            stack[-1][1][key] = value.strip("'\"")
        else:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
    return root


#: What a line of code says about each group of parameters, for any language: group, words of a name, what a value looks like.
CODE_GROUPS = [
    ("perturbation", "rotation rot angle perturbation force curl", r"[-+]?\d+(?:\.\d+)?"),
    ("feedback", "feedback cursor delay noise", r"[-+]?\d+(?:\.\d+)?|true|false|True|False|'[^'\n]*'|\"[^\"\n]*\""),
    ("timing", "trial duration interval iti time", r"\d+(?:\.\d+)?"),
    ("sample", "subject participant age sample", r"\d+(?:\.\d+)?"),
    ("block", "block phase baseline washout", r"\d+|'[^'\n]*'|\"[^\"\n]*\""),
    ("target", "target distance radius spacing", r"\d+(?:\.\d+)?|\[[^\]\n]*\]"),
]


def code_mentions(source: str) -> list[tuple[str, str, str]]:
    """(group, name, value) of assignments, ``key: value`` pairs, calls and comments whose name has a word of a group."""
    out = []
    for m in re.finditer(r"(?m)([A-Za-z_][\w.]*)['\"]?\s*(?:=(?!=)|:|\()\s*([^\n,;)]+)", source):
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", m[1]).lower()))
        words |= {w[:-1] for w in words if w.endswith("s")}
        for group, terms, value in CODE_GROUPS:
            found = re.match(value, m[2].strip())
            if found and words & set(terms.split()):
                out.append((group, m[1], found[0].strip("'\"")))
    return out


def code_scan(files: DataFrame) -> DataFrame:
    """path, group, name, value: what files of source code of any language mention of each group of parameters."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = [(path, *found) for path, text in zip(b["path"], b["text"]) for found in code_mentions(text or "")]
            yield pd.DataFrame(rows, columns=["path", "group", "name", "value"])

    return files.select("path", "text").mapInPandas(run, "path string, `group` string, name string, value string")


def provenance(files: DataFrame, experiment: Column, version: str) -> DataFrame:
    """Rows for the ``provenance`` table: one for each (path, kind, text) file that was read, with its content's hash."""
    return files.select(
        F.xxhash64("path", F.sha2("text", 256)).alias("id"), experiment.alias("experiment_id"), F.col("path").alias("file_path"), F.sha2("text", 256).alias("file_content_hash"),
        F.when(F.col("kind") == "python", "code").otherwise("config_files").alias("source_type"), F.lit(version).alias("extractor_version"), F.current_timestamp().alias("extraction_timestamp"),
    )


def file_params(files: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Parameters of (path, kind, text) rows of kinds python, json and yaml; unreadable files give none."""
    lower = {k.lower(): v for k, v in aliases.items()}

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = []
            for path, kind, text in zip(b["path"], b["kind"], b["text"]):
                try:
                    if kind == "python":
                        found = [(n, v, "code", how, c) for n, v, how, c in python_params(text or "", lower)]
                    else:
                        found = [(n, v, "config_files", kind, 1.0) for n, v in walk(json.loads(text) if kind == "json" else parse_yaml(text), lower)]
                except Exception:  # noqa: BLE001 - a broken file has no parameters
                    found = []
                rows += [(path, *f, i) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "name", "value", "source_type", "method", "confidence", "ord"])

    return files.where(F.col("kind").isin("python", "json", "yaml")).select("path", "kind", "text").mapInPandas(run, PARAM_ROWS)


def merge_files(params: DataFrame) -> DataFrame:
    """One value for each name: the most confident, first path of equals; any differing value flags a conflict."""
    key = F.struct((-F.col("confidence")).alias("a"), F.col("path").alias("b"), F.col("ord").alias("c"))
    return params.groupBy("name").agg(F.min_by(F.struct("value", "confidence", "source_type", "path"), key).alias("w"), (F.countDistinct("value") > 1).alias("conflict")).select("name", "w.*", "conflict")
