"""Incremental ingest: the batch transformations over a file stream, upserted by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from docsmelt.operators import extract
from docsmelt.sources.store import upsert_table


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """New files of a folder, once each; the stream's checkpoint remembers them."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(folder)


def extract_stream(docs: DataFrame, library, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Best value per (document, parameter) of every new document into ``table``, a replay changing nothing."""

    def write(batch: DataFrame, _: int):
        found = extract.best(extract.candidates(batch, library, [key]), [key, "param"])
        upsert_table(found.withColumn("row_id", F.concat_ws("|", F.col(key).cast("string"), "param")), table, "row_id")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and key; rows later than ``late`` are dropped and windows close behind it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def latest_counts(spark: SparkSession, counts: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run a stream of counts to the end of what is there; each key's last count.

    Every micro-batch writes the counts that it changed to its own place in ``folder``, so
    a replay writes the same again, windows behind the watermark leave the state, and
    nothing gathers on the driver.
    """

    def write(batch: DataFrame, number: int):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/counts/{number:06d}")

    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in counts.columns if c not in keys]
    schema = StructType([*counts.schema.fields, StructField("batch", IntegerType())])
    written = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/counts")
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
