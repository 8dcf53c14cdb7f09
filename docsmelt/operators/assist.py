"""Model-assisted steps: gates, prompts, a pluggable provider, parsing and filtering of answers."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsmelt.functions.values import level_confidence, level_rank, parse_json
from docsmelt.session import written


class Provider(Protocol):
    """Anything that answers prompts. It must be picklable; a task makes one call for each Arrow batch."""

    name: str

    def generate(self, prompts: list[str], temperature: float, max_tokens: int) -> list[str]: ...


class StubProvider:
    """A deterministic provider for tests: for each ``- name`` line of a prompt, the first ``name: value`` in it.

    Asked for missed parameters, it gives the ``name = value`` lines that are not known.
    """

    name = "stub"

    def generate(self, prompts: list[str], temperature: float = 0.0, max_tokens: int = 1024) -> list[str]:
        out = []
        for p in prompts:
            found = {}
            if "missed_parameters" in p:
                known = set(re.findall(r"\w+", p.partition("\nKnown: ")[2].partition("\n")[0]))
                lines = re.findall(r"(?m)^(\w+) = (\S+)$", p)
                missed = [{"parameter_name": n, "value": v, "confidence": 0.8, "evidence": f"{n} = {v}"} for n, v in lines if n not in known]
                out.append(json.dumps({"missed_parameters": missed}))
                continue
            for field in re.findall(r"(?m)^- (\w+)", p):
                m = re.search(rf"(?m)^(?!- ){re.escape(field)}\s*[:=]\s*(\S+)", p)
                found[field] = {"value": m[1], "confidence": 0.9, "evidence": m[0]} if m else {"abstained": True}
            out.append("```json\n" + json.dumps(found) + "\n```")
        return out


class HttpProvider:
    """Any server with the widespread ``/v1/chat/completions`` interface; one request for each prompt."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 120.0):
        self.name, self.url, self.model, self.key, self.timeout = "http", url.rstrip("/"), model, key, timeout

    def generate(self, prompts: list[str], temperature: float = 0.0, max_tokens: int = 1024) -> list[str]:
        out = []
        for p in prompts:
            body = {"model": self.model, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "user", "content": p}]}
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
            request = urllib.request.Request(f"{self.url}/v1/chat/completions", json.dumps(body).encode(), headers)
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                out.append(json.load(r)["choices"][0]["message"]["content"])
        return out


PROVIDERS: dict[str, Callable[..., Provider]] = {"stub": StubProvider, "http": HttpProvider}


def provider(name: str, **options) -> Provider:
    """A registered provider; register others in ``PROVIDERS``."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name](**options)


# Temperature and most tokens of each task.
TASKS = {"verify": (0.0, 1024), "infer": (0.0, 512), "missed": (0.6, 1536), "discover": (0.2, 2048)}


def generate(rows: DataFrame, prompt: str, by: Provider, task: str = "verify") -> DataFrame:
    """Add ``answer``; a failing batch gives null answers and an ``error``, never a failed task."""
    temperature, tokens = TASKS[task]

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            try:
                yield b.assign(answer=by.generate(b[prompt].tolist(), temperature, tokens), error=None)
            except Exception as e:  # noqa: BLE001 - a provider may raise anything
                yield b.assign(answer=None, error=str(e)[:500])

    return rows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", answer string, error string")


ANSWER = "map<string,struct<value:string,confidence:double,evidence:string,reasoning:string,abstained:boolean,verified:boolean>>"
MISSED = "struct<missed_parameters:array<struct<parameter_name:string,value:string,confidence:double,evidence:string,evidence_location:string>>>"
NEW = "struct<new_parameters:array<struct<parameter_name:string,description:string,category:string,evidence:string,prevalence:string,importance:string>>>"


def parse_answers(rows: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """keys, param and the fields of each answered parameter; a wrapping ``parameters`` object is looked into."""
    text = parse_json(F.col(answer))
    inner = F.coalesce(F.get_json_object(text, "$.parameters"), text)
    return rows.select(*keys, F.explode(F.from_json(inner, ANSWER)).alias("param", "a")).select(*keys, "param", "a.*")


def parse_missed(rows: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    return rows.select(*keys, F.explode(F.from_json(parse_json(F.col(answer)), MISSED)["missed_parameters"]).alias("a")).select(*keys, "a.*")


def parse_new(rows: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Proposals of new parameters with the mean confidence of their levels; a bare array is read too."""
    text = parse_json(F.col(answer))
    wrapped = F.when(F.ltrim(text).startswith("["), F.concat(F.lit('{"new_parameters":'), text, F.lit("}"))).otherwise(text)
    out = rows.select(*keys, F.explode(F.from_json(wrapped, NEW)["new_parameters"]).alias("a")).select(*keys, "a.*")
    return out.withColumn("confidence", level_confidence(F.col("prevalence"), F.col("importance")))


def evidence_verdict(confidence: Column, evidence: Column, value: Column, abstained: Column, task: str = "verify") -> Column:
    """accepted, or why not: abstained, no_value, weak_evidence."""
    n = F.length(F.trim(F.coalesce(evidence, F.lit(""))))
    need = {"verify": F.lit(1), "missed": F.when(confidence >= 0.5, 3).otherwise(12), "discover": F.lit(20)}[task]
    return F.when(F.coalesce(abstained, F.lit(False)), "abstained").when(value.isNull() | (F.trim(value) == ""), "no_value").when(n < need, "weak_evidence").otherwise("accepted")


def needs_model(found: DataFrame, scopes: DataFrame, critical: list[str], scope: str, below: float = 0.3, mode: str = "fallback") -> DataFrame:
    """(scope, param) pairs to ask about: critical ones missing or below the threshold; with ``verify`` all found ones too."""
    pairs = scopes.select(scope, F.explode(F.array(*[F.lit(c) for c in critical])).alias("param"))
    sure = found if mode == "fallback" else found.limit(0)
    ask = pairs.join(sure.where(F.col("confidence") >= below).select(scope, "param"), [scope, "param"], "left_anti")
    return ask if mode == "fallback" else ask.unionByName(found.select(scope, "param")).distinct()


def gate(found: DataFrame, expected: DataFrame, scope: str, share: float = 0.3) -> DataFrame:
    """Scopes whose missing share of expected parameters exceeds ``share``."""
    j = expected.join(found.select(scope, "param").distinct().withColumn("has", F.lit(1)), [scope, "param"], "left")
    return j.groupBy(scope).agg((1 - F.count("has") / F.count("*")).alias("missing")).where(F.col("missing") > share)


def ask_model(mode: Column, confidence: Column, critical: Column, verify_below: float = 0.3, critical_below: float = 0.5) -> Column:
    """Whether one parameter is asked for: all in verify mode; else missing, unsure, or critical and not sure enough."""
    c = F.coalesce(confidence, F.lit(0.0))
    return (mode == "verify") | (c < verify_below) | (critical & (c < critical_below))


def apply_fallback(found: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates overwritten by answers that have a value; answers to missing ones come in."""
    a = answers.select(*keys, F.col("value").alias("_v"), F.col("confidence").alias("_c"))
    out = found.join(a, keys, "full")
    used = F.col("_v").isNotNull()
    return out.select(*keys, F.coalesce("_v", "value").alias("value"), F.when(used, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"), F.when(used, "llm_inference").otherwise("regex").alias("source_type"))


def add_missing(found: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``extra`` only where ``found`` has none for the key."""
    return found.unionByName(extra.join(found.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def within_budget(calls: DataFrame, order: list[str], cost: str, budget: float, by: list[str] = ()) -> DataFrame:
    """Calls in order with their running cost, up to the budget, for each key of ``by``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("spent", F.round(F.sum(cost).over(w), 6)).where(F.col("spent") <= budget)


def filter_proposals(rows: DataFrame, min_prevalence: str = "low", min_importance: str = "low", top: int | None = 10) -> DataFrame:
    """Proposals at the levels or above, most important first; ``top`` is the report's limit."""
    ok = (level_rank(F.col("prevalence")) >= level_rank(F.lit(min_prevalence))) & (level_rank(F.col("importance")) >= level_rank(F.lit(min_importance)))
    out = rows.where(ok).orderBy(level_rank(F.col("importance")).desc(), level_rank(F.col("prevalence")).desc(), "parameter_name")
    return out if top is None else out.limit(top)


# How many papers the discovery of new parameters reads, to bound what it costs.
DISCOVERY_PAPERS = 5


def discovery_papers(papers: DataFrame, order: str, success: str = "success", most: int | None = DISCOVERY_PAPERS) -> DataFrame:
    """The papers that discovery reads: of the first ``most`` by ``order``, those that succeeded (the feature's own limit)."""
    first = papers if most is None else papers.orderBy(order).limit(most)
    return first.where(success)


def save_proposals(rows: DataFrame, path: str, fmt: str = "json", model: str = "") -> None:
    """Proposals as CSV, or as JSON lines that each carry the model and the day."""
    if fmt == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    elif fmt == "json":
        rows.select(F.struct("*").alias("proposal"), F.lit(model).alias("model"), F.current_date().alias("proposed_date")).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def answer_json(rows: DataFrame, prompt: str, by: Provider, task: str, again: str = "\n\nAnswer with one valid JSON object only.") -> DataFrame:
    """``generate`` with one more try, under a stricter prompt, for answers that hold no JSON; ``attempts`` says how many it took.

    Answers are written down as they come, so that no prompt is sent twice.
    """
    first = written(generate(rows, prompt, by, task))
    good = parse_json(F.col("answer")).isNotNull()
    second = written(generate(first.where(~F.coalesce(good, F.lit(False))).drop("answer", "error").withColumn(prompt, F.concat(F.col(prompt), F.lit(again))), prompt, by, task))
    return first.where(good).withColumn("attempts", F.lit(1)).unionByName(second.withColumn("attempts", F.lit(2)))


def filter_statistics(rows: DataFrame, verdict: str = "verdict", by: list[str] = ()) -> DataFrame:
    """How many answers each verdict had, and their share."""
    n = rows.groupBy(*by, verdict).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*[F.col(c) for c in by])), 6))


def _asked(docs: DataFrame, wanted: DataFrame, scope: str, text: str, head: str) -> DataFrame:
    names = wanted.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_set("param")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("wanted"))
    return docs.join(names, scope).select(scope, F.concat(F.lit(head), F.col("wanted"), F.lit("\n\n"), F.substring(text, 1, 25000)).alias("prompt"))


def find_missed(docs: DataFrame, found: DataFrame, scope: str, text: str, by: Provider, most: int = 15000) -> DataFrame:
    """scope, param, value, confidence, verdict: parameters that a text has and ``found`` lacks, by one open question for each text."""
    known = found.groupBy(scope).agg(F.array_join(F.array_sort(F.collect_set("param")), ", ").alias("known"))
    head = "List parameters of the text that are missing among the known ones, as JSON (missed_parameters with parameter_name, value, confidence, evidence).\nKnown: "
    ask = docs.join(known, scope, "left").select(scope, F.concat(F.lit(head), F.coalesce("known", F.lit("")), F.lit("\n\n"), F.substring(text, 1, most)).alias("prompt"))
    rows = parse_missed(answer_json(ask, "prompt", by, "missed"), [scope]).withColumnRenamed("parameter_name", "param")
    verdict = evidence_verdict(F.col("confidence"), F.col("evidence"), F.col("value"), F.lit(False), "missed")
    return rows.join(found.select(scope, "param"), [scope, "param"], "left_anti").select(scope, "param", "value", "confidence", verdict.alias("verdict"))


def infer_remaining(docs: DataFrame, found: DataFrame, names: list[str], scope: str, text: str, by: Provider) -> DataFrame:
    """scope, param, value, confidence, verdict: one answer for each of ``names`` that ``found`` still lacks."""
    left = docs.select(scope, F.explode(F.array(*[F.lit(n) for n in names])).alias("param")).join(found.select(scope, "param"), [scope, "param"], "left_anti")
    prompts = _asked(docs, left, scope, text, "Infer from the text, as a JSON object with value, confidence and evidence for each:\n")
    rows = parse_answers(answer_json(prompts, "prompt", by, "infer"), [scope]).join(left, [scope, "param"], "left_semi")
    verdict = evidence_verdict(F.col("confidence"), F.col("evidence"), F.col("value"), F.col("abstained"))
    return rows.select(scope, "param", "value", "confidence", verdict.alias("verdict"))


def assisted(docs: DataFrame, found: DataFrame, critical: list[str], names: list[str], scope: str, text: str, by: Provider, share: float = 0.3) -> DataFrame:
    """The stages in order: verify what was found, find what was missed, infer what remains where more than ``share`` of ``names`` is missing.

    Returns scope, param, value, confidence, source_type, stage. A stage sees only what the
    ones before it left, and adds accepted answers only.
    """
    first = written(verify_and_fill(docs, found, critical, scope, text, by).withColumn("stage", F.lit("verify")).where("value is not null"))
    extra = lambda rows, stage: rows.where("verdict = 'accepted'").select(scope, "param", "value", "confidence", F.lit("llm_inference").alias("source_type"), F.lit(stage).alias("stage"))
    second = written(first.unionByName(extra(find_missed(docs, first, scope, text, by), "missed")))
    expected = docs.select(scope, F.explode(F.array(*[F.lit(n) for n in names])).alias("param"))
    poor = docs.join(gate(second, expected, scope, share).select(scope), scope, "left_semi")
    return second.unionByName(extra(infer_remaining(poor, second, names, scope, text, by), "infer"))


def verify_and_fill(docs: DataFrame, found: DataFrame, critical: list[str], scope: str, text: str, by: Provider, template: str | None = None) -> DataFrame:
    """Verify what was found, ask for what is missing, keep accepted answers: one prompt for each scope.

    Returns scope, param, value, confidence, source_type.
    """
    ask = needs_model(found, docs, critical, scope, mode="verify")
    prompts = _asked(docs, ask, scope, text, template or "Give a JSON object with value, confidence and evidence for:\n")
    parsed = parse_answers(answer_json(prompts, "prompt", by, "verify"), [scope])
    verdict = evidence_verdict(F.col("confidence"), F.col("evidence"), F.col("value"), F.col("abstained"))
    return apply_fallback(found.select(scope, "param", "value", "confidence"), parsed.where(verdict == "accepted"), [scope, "param"])
