"""Connected components of a link table, with every round written to the shared scratch space."""

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stored
from tidemark.sources.storage import drop_scratch


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("low"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v")
    return small.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (u, v); root is the smallest node that can be reached.

    Neighbours are reduced to their minimum before any shuffle, so a node with many links is one row per task in the
    aggregations; the joins put one row per node against the links, which lets Spark split a hub's links. The number of
    rounds grows with the logarithm of a component's size. An empty table gives an empty result.
    """
    spark = links.sparkSession
    state, path = stored(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen, old = tuple(mark), path
        state, path = stored(_stars(state), "stars")
        drop_scratch(spark, old)  # the next round is whole
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
