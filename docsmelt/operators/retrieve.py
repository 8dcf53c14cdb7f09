"""Vector retrieval over chunks, and merging what it answers into candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsmelt.functions.values import parse_json

QUESTION = "information about {field} in the experiment"


#: Fields of a structured answer, one query each.
FIELDS = ["sample_size", "age_mean", "age_sd", "handedness", "effector", "environment", "perturbation_class", "perturbation_magnitude", "perturbation_schedule", "feedback_type", "feedback_delay", "num_trials", "num_blocks", "target_distance", "instruction", "primary_outcome", "mechanism"]
ANSWER = "struct<value:string,page:int,quote:string>"


def field_queries(spark: SparkSession, fields: list[str] = FIELDS) -> DataFrame:
    return spark.createDataFrame([(f, QUESTION.format(field=f)) for f in fields], "query_id string, text string")


def parse_field(answer: Column) -> Column:
    """value, confidence (0.8 where there is a value) and evidence of one field's answer."""
    a = F.from_json(parse_json(answer), ANSWER)
    return F.struct(a["value"].alias("value"), F.when(a["value"].isNotNull(), 0.8).alias("confidence"), F.array(F.struct(a["page"].alias("page"), a["quote"].alias("quote"))).alias("evidence"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embed(rows: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Add ``embedding`` by a pluggable encoder, one call for each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield b.assign(embedding=list(encode(b[text].fillna("").tolist())))

    return rows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", embedding array<double>")


def vector_top_k(chunks: DataFrame, queries: DataFrame, k: int = 6, chunk_id: str = "chunk_id", query_id: str = "query_id", within: list[str] = (), largest: int = 64 << 20) -> DataFrame:
    """query_id, rank, chunk_id, score: each query's k most similar chunks, ties to the smaller id.

    Queries are one for each field of a schema: their vectors may have ``largest`` bytes,
    which is checked before they are broadcast. Each Arrow batch of chunks is one matrix
    product, of which a query's k best leave. With ``within`` (a document key on both
    sides) it is an equi-join instead.
    """
    rank = F.row_number().over(Window.partitionBy(*within, query_id).orderBy(F.desc("score"), chunk_id))
    if within:
        pairs = chunks.select(*within, chunk_id, F.col("embedding").alias("_c")).join(queries.select(*within, query_id, F.col("embedding").alias("_q")), list(within))
        return pairs.select(*within, query_id, chunk_id, F.round(cosine(F.col("_c"), F.col("_q")), 6).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
    asked = queries.where("embedding is not null").select(query_id, F.col("embedding").cast("array<double>").alias("_q"))
    size = asked.agg(F.sum(F.size("_q").cast("bigint") * 8)).first()[0] or 0
    if size > largest:
        raise ValueError(f"query vectors of more than {largest} bytes; give a key to join within, or use a block search")
    rows = asked.collect()
    kinds = dict(queries.dtypes) | dict(chunks.dtypes)
    shared = chunks.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1)))

    def best(batches: Iterator[pd.DataFrame]):
        names, q = shared.value
        for b in batches:
            b = b[b["embedding"].notna()]
            if not len(b) or not len(names):
                continue
            c, ids = np.array(b["embedding"].tolist(), float), b[chunk_id].to_numpy()
            with np.errstate(invalid="ignore", divide="ignore"):
                score = (q @ c.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None, :])
            score = np.round(score, 6)
            order = np.argsort(ids, kind="stable")
            order = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
            yield pd.DataFrame({query_id: np.repeat(np.array(names, object), order.shape[1]), chunk_id: ids[order.ravel()], "score": np.take_along_axis(score, order, axis=1).ravel()})

    found = chunks.select(chunk_id, F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(best, f"{query_id} {kinds[query_id]}, {chunk_id} {kinds[chunk_id]}, score double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def chunk_context(ranked: DataFrame, keys: list[str], longest: int = 1200) -> DataFrame:
    """Chunks of a query joined in rank order, each cut and led by its page."""
    part = F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit("] "), F.substring("text", 1, longest))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def merge_answers(found: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with retrieved answers: new ones come in, equal ones keep the higher confidence and gain evidence.

    Where the values differ, the candidate stays with its own confidence; the answer's
    evidence is kept beside its own.
    """
    f = found.select(*keys, F.col("value").alias("f_value"), F.col("confidence").alias("f_conf"), F.col("evidence").alias("f_ev"))
    a = answers.select(*keys, F.col("value").alias("a_value"), F.col("confidence").alias("a_conf"), F.col("evidence").alias("a_ev"))
    confidence = F.when(F.col("f_value").isNull(), F.col("a_conf")).when(F.col("f_value") == F.col("a_value"), F.greatest("f_conf", "a_conf")).otherwise(F.col("f_conf"))
    evidence = F.filter(F.array("f_ev", "a_ev"), lambda x: x.isNotNull())
    return f.join(a, keys, "full").select(*keys, F.coalesce("f_value", "a_value").alias("value"), confidence.alias("confidence"), evidence.alias("evidence"))
