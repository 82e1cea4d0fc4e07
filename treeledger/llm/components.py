"""Joins and connected components where one key may hold a large part of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.sources.scratch import delete_folder, fresh_folder

from .common import materialise, written

HEAVY_KEYS = 1_000  # a key with more than so small a part of all rows is heavy: there are fewer than this many


def heavy_join(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``unique`` by a key that ``unique`` holds once, together with how many of the ``total``
    rows have it (``weight``, at least: rows without partner fall out).

    Keys with more than 1/1,000 of all rows are sent to every task (fewer than 1,000 rows, whatever the data), so
    that their rows stay where they are; no key of the others fills a task.
    """
    heavy = F.col(weight) * HEAVY_KEYS > F.lit(total)
    few = unique.where(heavy)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(light.join(unique.where(~heavy), key))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b): the smallest node reachable.

    Large-star and small-star steps in turn, until nothing moves: a logarithmic number of rounds.  Each step is a
    minimum by node, pre-aggregated before the shuffle, and a join with that minimum by ``heavy_join``, so a hub with a third of all edges
    is not one task's work.  Each round's edges are written and those of the round before deleted.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    folder, before = fresh_folder(spark), None
    pairs = materialise(pairs.distinct(), folder)
    count = pairs.count()
    while count:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        joined = heavy_join(both, least, "u", "n", 2 * count)
        large = joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        passed = fresh_folder(spark)
        large = materialise(large.distinct(), passed)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        lower = heavy_join(large, least, "u", "n", large.count()).where("v <> m")
        lower = lower.select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = fresh_folder(spark)
        pairs = materialise(lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), after)
        for done in (folder, passed):
            delete_folder(spark, done)
        folder = after
        count, *state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if (count, state) == before:
            break
        before = (count, state)
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return written(nodes.unionByName(roots))
