"""Exact top-k inner products over norm buckets.

Vectors are grouped by length into buckets. A first pass over the longest vectors gives each query a score that its k-th
best cannot be below; with a bucket's largest length this becomes a local cosine threshold. A query skips buckets whose
threshold is over one, prunes by length where it is low, by its largest coordinates where it is high, and only what is
left is multiplied out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import by_batch, materialised

BUCKETS = 32
#: Vectors and queries that meet in one task, and the longest vectors that every query is first scored against.
CHUNK = 2048
BLOCK = 1024
SEEDS = 1024
#: Local cosine thresholds from which coordinates prune better than lengths, and how many coordinates are looked at.
STEEP = 0.35
FOCUS = 4
_FOUND = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LONG = 2 ** 63 - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, norm, hash): components as floor(scale * x); rows without id, or with null or non-finite components, are left out."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select("vec_id", v.alias("v")).distinct().select(
        "vec_id", "v", norm.alias("norm"), F.xxhash64("vec_id", "v").alias("hash"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows), default=0)
    return np.array([r + [0] * (width - len(r)) for r in rows], dtype=np.int64).reshape(len(rows), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with the rows of b; sums beyond a long are clipped to its range."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, width)
    if largest < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64).reshape(len(a), len(b))


def survivors(query: np.ndarray, length: float, least: float, vectors: np.ndarray, norms: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Positions of the vectors, sorted by falling norm, whose product with the query may reach ``least``."""
    if length == 0 or not len(norms) or norms[0] == 0 or least <= 0:
        return np.arange(len(norms)) if least <= 0 else np.zeros(0, dtype=np.int64)
    slack = 1e-9
    cosine = least / (length * norms[0])
    if cosine > 1 + slack:
        return np.zeros(0, dtype=np.int64)
    reach = int(np.searchsorted(-norms, -(least / length) * (1 - slack), side="right"))
    if cosine < STEEP:
        return np.arange(reach)
    keep = np.ones(reach, dtype=bool)
    direction = np.zeros(unit.shape[1])
    width = min(len(query), unit.shape[1])
    direction[:width] = query[:width] / length
    cosine = min(1.0, cosine)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        spread = np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - cosine ** 2)))
        if direction[f] >= cosine:
            low, high = direction[f] * cosine - spread, 1.0
        elif direction[f] <= -cosine:
            low, high = -1.0, direction[f] * cosine + spread
        else:
            low, high = direction[f] * cosine - spread, direction[f] * cosine + spread
        keep &= (unit[:reach, f] >= low - 1e-7) & (unit[:reach, f] <= high + 1e-7)
    return np.flatnonzero(keep)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, buckets: int = BUCKETS, chunk: int = CHUNK, block: int = BLOCK,
           seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of vectors for each of queries; both as made by ``quantised``.

    A query's own vec_id is no candidate; equal rows count once, an id with different vectors counts with each of them.
    Ties go to the smaller vec_id; with fewer than k candidates all are returned, without any there is no row.
    """
    edges = vectors.agg(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    edges = sorted(set(edges))
    number = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("norm"))) if edges else F.lit(0)
    cut = vectors.withColumn("bucket", number.cast("int"))
    known = {r["bucket"]: (r["most"], -(-r["n"] // chunk)) for r in cut.groupBy("bucket").agg(F.max("norm").alias("most"), F.count("*").alias("n")).collect()}
    n_blocks = max(1, -(-queries.count() // block))
    longest = vectors.orderBy(F.desc("norm"), "hash").limit(seeds).select("vec_id", "v").toArrow()
    seed_ids, seed_rows = longest.column(0).to_numpy(), matrix(longest.column(1))
    schema = pa.schema([
        ("query_id", pa.int64()), ("hash", pa.int64()), ("v", pa.list_(pa.int64())), ("norm", pa.float64()), ("least", pa.float64())])

    def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = products(matrix(batch.column(2)), seed_rows).astype(np.float64)
        scores[batch.column(0).to_numpy()[:, None] == seed_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        else:
            least = np.full(len(scores), -np.inf)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], schema=schema)

    asked = materialised(queries.select(F.col("vec_id").alias("query_id"), "hash", "v", "norm").mapInArrow(
        by_batch(bound, schema), "query_id long, hash long, v array<long>, norm double, least double"), "asked")
    reach = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(m).alias("most"), F.lit(n).cast("int").alias("chunks")) for b, (m, n) in known.items()]) \
        if known else F.expr("cast(array() as array<struct<bucket:int,most:double,chunks:int>>)")
    open_buckets = F.filter(reach, lambda r: (F.col("least") <= 0) | (F.col("norm") * r["most"] * (1 + 1e-9) >= F.col("least")))
    sent = asked.withColumn("r", F.explode(open_buckets)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("r.chunks") - 1))).select(
        "query_id", "hash", "v", "norm", "least", F.col("r.bucket").alias("bucket"), "chunk",
        F.pmod(F.col("hash"), F.lit(n_blocks)).cast("int").alias("block"))
    chunks = F.element_at(F.create_map(*[F.lit(x) for b, (_, n) in known.items() for x in (b, n)]), F.col("bucket")) if known else F.lit(1)
    # a chunk goes only to the blocks that hold a query whose bound its bucket can reach
    cells = sent.select(*[F.col(c).alias(c) for c in ("bucket", "chunk", "block")]).distinct()
    held = cut.withColumn("chunk", F.pmod(F.col("hash"), chunks).cast("int")).join(cells, ["bucket", "chunk"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        right = right.sort_by([("norm", "descending")])
        ids, rows, norms = right.column("vec_id").to_numpy(), matrix(right.column("v")), right.column("norm").to_numpy()
        unit = rows / np.where(norms > 0, norms, 1)[:, None]
        asked_rows = matrix(left.column("v"))
        out = []
        for q, (qid, qhash, length, least) in enumerate(zip(*(left.column(c).to_pylist() for c in ("query_id", "hash", "norm", "least")))):
            at = survivors(asked_rows[q], length, least, rows, norms, unit)
            at = at[ids[at] != qid]
            if not len(at):
                continue
            scores = products(asked_rows[q:q + 1], rows[at])[0]
            enough = scores >= least
            scores, found = scores[enough], ids[at][enough]
            for p in best(scores, found, k):
                out.append((qid, qhash, int(found[p]), int(scores[p])))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _FOUND)], schema=_FOUND) if out else _FOUND.empty_table()

    cell = ["bucket", "chunk", "block"]
    found = sent.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(
        meet, "query_id long, query_hash long, vec_id long, score long")
    place = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the rows of vectors(vec_id, embedding) with vec_id divisible by ``every`` against all rows.

    Vectors that are null or hold null or non-finite components, and rows without a vec_id, take no part. Vectors of
    different widths are compared over the shorter one's components. Other columns are ignored; an empty table gives an empty result.
    """
    rows = materialised(quantised(vectors), "vectors")
    return search(rows.filter(F.col("vec_id") % every == 0), rows, k)
