"""Connected components of link tables, without collecting links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsmelt.llm.common import discard, scratch_dir


def link_roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Take links into a forest of smallest reachable indices (``arange`` to begin with)."""
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (low != high).any():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def connected_components(links: DataFrame, a: str, b: str, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``, root the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours
    to the smallest node it knows (large star), then its smaller neighbours likewise
    (small star). Rounds grow with the logarithm of the number of nodes. Each round cuts
    lineage through the shared scratch folder, so a lost executor costs one round at
    most. Nulls and self links are left out; repeated links count once. A node's
    neighbours meet by aggregation (``min``) and a join, never as one list.
    """
    spark, folder = links.sparkSession, scratch_dir(links.sparkSession)

    def keep(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/{k}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{k}")

    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = keep(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
    for k in range(1, most_rounds + 1):
        # large star: for each node u, with m the least of u and its neighbours, v > u gets m
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: for each node u, all smaller neighbours and u itself get the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = keep(small.where("u <> v").distinct(), k)
        discard(spark, f"{folder}/{k - 1}")  # nothing reads the round before any more
        # it is over when every node links to one root and no root links on
        state = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        deep = new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        edges = new
        if state["n"] == state["d"] and not deep:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
