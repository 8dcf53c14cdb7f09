"""SQL names for what has no built-in form: JSON out of prose, and parameters of code and configuration."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from docsmelt.plans.libraries import alias_table
from docsmelt.sources import code


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text that parses; braces in strings don't count."""
    text = text or ""
    at = text.find("{")
    while at >= 0:
        depth, inside, skip = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        json.loads(text[at : i + 1])
                        return text[at : i + 1]
                    except ValueError:
                        break
        at = text.find("{", at + 1)
    return None


def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


class PythonParams:
    """Parameters of one Python source."""

    def eval(self, source: str) -> Iterator[tuple]:
        yield from code.python_params(source or "", {k.lower(): v for k, v in alias_table().items()})


class ConfigParams:
    """Parameters of one configuration text, ``kind`` json or yaml."""

    def eval(self, text: str, kind: str) -> Iterator[tuple]:
        try:
            data = json.loads(text) if kind == "json" else code.parse_yaml(text)
        except Exception:  # noqa: BLE001 - a broken file has no parameters
            return
        yield from code.walk(data, {k.lower(): v for k, v in alias_table().items()})


def register(spark: SparkSession) -> None:
    """Make ``extract_json``, ``python_params`` and ``config_params`` callable from SQL."""
    spark.udf.register("extract_json", F.pandas_udf(extract_json, "string"))
    spark.udtf.register("python_params", udtf(PythonParams, returnType="name string, value string, method string, confidence double"))
    spark.udtf.register("config_params", udtf(ConfigParams, returnType="name string, value string"))
