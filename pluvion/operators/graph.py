"""Connected components of large graphs as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


#: Neighbours of one node are dealt to so many tasks.
SALTS = 4


def _written(pairs: DataFrame, name: str, files: int) -> DataFrame:
    """``materialise`` in at most so many files: pairs are 16 bytes, and each round's files cost more than its rows."""
    return materialise(pairs.coalesce(files), name)


def _with_least(pairs: DataFrame, key: str, value: str, least: DataFrame, m: str) -> DataFrame:
    """``pairs`` with the column ``m`` of ``least`` by ``key``: a key's pairs are spread over SALTS tasks, its one minimum goes to each."""
    spread = pairs.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return spread.join(copies.select(key, "salt", m), [key, "salt"]).drop("salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable from each node that has an edge; edges: (a, b), any direction.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A node's smallest neighbour is a pre-aggregated
    minimum; where it is joined back, a node's neighbours are spread over several tasks by a salt, so that a centre of
    very many edges is never gathered in one. Each round is written to the shared folder. Loops and repeated edges count
    once; an empty table gives no rows.
    """
    few = max(12, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    now = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", few)
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        # large star: each larger neighbour goes to the smallest of the node and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = _with_least(both.filter("v > u"), "u", "v", least, "m").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, "a", "b", least, "m").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m")).filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        now = _written(small, "edges", few)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
