"""Keyed building blocks that stay balanced when one key holds a large share of the rows."""

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.text import quoted

SALTS = 1024
#: Equal rows of a frequent key that travel as one.
PORTION = 1000


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name, pairwise, so that no branch is analyzed more than a few times."""
    while len(parts) > 1:
        parts = [a.unionByName(*b) if b else a for a, *b in (parts[i:i + 2] for i in range(0, len(parts), 2))]
    return parts[0]


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: pa.Schema) -> DataFrame:
    """A small control table whose exact size the optimizer knows."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def strings(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.string()) for n in names])


def tally(keys: Sequence[str], sides: dict[str, DataFrame]) -> DataFrame:
    """One row per key with its row count on every side.

    All sides go through one shuffle on the key. Each task counts its own rows first, so a key that
    holds a third of a table arrives as one row per task; no join is needed to compare the sides.
    """
    tagged = [
        df.select(*[quoted(k) for k in keys], *[F.lit(int(side == s)).cast("bigint").alias(s) for s in sides])
        for side, df in sides.items()
    ]
    return union_all(tagged).groupBy(*[quoted(k) for k in keys]).agg(*[F.sum(s).alias(s) for s in sides])


def _hashable(dtype: T.DataType) -> bool:
    text = dtype.simpleString()
    return "map<" not in text and "variant" not in text


def _known_small(df: DataFrame) -> bool:
    """Whether Spark's own size estimate is under the session's broadcast limit, so that it will broadcast it."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except ValueError:
        return False  # an estimate of more digits than Python reads
    return int(str(size)) <= limit


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Parts of the rows whose sketches are merged apart before they meet.
SKETCH_PARTS = 64
#: Spark's bound on the items a sketch tracks.
SKETCH_ITEMS = 1_000_000
NO_KEY = -2 ** 63


def frequent_keys(rows: DataFrame, on: Sequence[str], partitions: int | None = None) -> list[int]:
    """Hashes of the keys that hold over half of a shuffle partition's even share of the rows, or nearly so.

    Each task keeps a sketch of its heavy keys, a few times as many as there can be; the sketches are merged in parts and then
    once more, so that no key is shuffled. A sketch may be off by a quarter of the asked share, so keys from three
    quarters of it on are taken: every key above it is found, and there are at most a few times as many as partitions.
    """
    shares = 2 * (partitions or shuffle_partitions(rows.sparkSession))
    # a sketch of n slots is off by at most 3.5 / n of the rows
    items = min(SKETCH_ITEMS, 16 * shares)
    # sketches cannot be merged where there is none, neither in a table nor in a task: one row more, of no key, and groups throughout
    hashes = rows.select(_key_hash(on).alias("_key")).union(rows.sparkSession.range(1).select(F.lit(NO_KEY).cast("long")))
    parts = hashes.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_PARTS)).alias("_part")).agg(
        F.expr(f"approx_top_k_accumulate(_key, {items})").alias("_sketch"), F.count("*").alias("_n"))
    found = parts.groupBy((F.col("_part") < 0).alias("_none")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(_sketch, {items}), {min(items, 4 * shares)})").alias("top"),
        F.sum("_n").alias("n")).first()
    least = 0.75 * (found["n"] - 1) / shares
    return [r["item"] for r in found["top"] if r["item"] != NO_KEY and r["count"] > least]


def _key_hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*[quoted(c) for c in on])


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS,
    frequent: Sequence[int] | None = None,
) -> DataFrame:
    """Join rows, any of whose keys may be hot, to a lookup with at most one row per key.

    A lookup of known small size is left to Spark, which broadcasts it. Otherwise the rows of frequent keys
    are spread over ``salts`` parts by row content, so a retried task puts them in the same place again, and
    their lookup rows are repeated once per part. Equal rows of a frequent key travel as one row with their number, in
    portions, so that they spread too. All other keys join as usual, and without frequent keys all do. Which count as frequent
    only changes the speed, never the result; ``frequent`` passes them when they are known already.
    """
    if _known_small(lookup):
        return rows.join(lookup, list(on), how)
    if frequent is None:
        frequent = frequent_keys(rows, on)
    if not frequent:
        return rows.join(lookup, list(on), how)
    hot = _key_hash(on).isin(list(frequent))
    names = [quoted(f.name) for f in rows.schema.fields]
    content = [quoted(f.name) for f in rows.schema.fields if _hashable(f.dataType)]
    if len(content) == len(names):
        portions = rows.filter(hot).groupBy(*names).agg(F.count("*").alias("_n")).withColumn(
            "_portion", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / PORTION)))).withColumn(
            "_n", F.least(F.lit(PORTION), F.col("_n") - F.col("_portion") * PORTION).cast("int"))
    else:
        portions = rows.filter(hot).withColumn("_n", F.lit(1)).withColumn("_portion", F.lit(0))
    salted = portions.withColumn("_salt", F.pmod(F.xxhash64("_portion", *content), F.lit(salts)).cast("int")).drop("_portion")
    spread = lookup.filter(hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spreadout = salted.join(spread, [*on, "_salt"], how).drop("_salt")
    repeated = spreadout.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    return rows.filter(~hot).join(lookup.filter(~hot), list(on), how).unionByName(repeated)
