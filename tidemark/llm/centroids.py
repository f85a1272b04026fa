"""Centroid clustering of integer vectors by popcounts over bit planes.

A vector of 64 integers is kept as its two's complement bit planes, each one 64-bit word with a bit per component. The
product of two vectors is the sum over pairs of planes of popcount(a & b), weighted by both planes' powers of two; the
sign plane weighs negative. Squared distances follow from three such products, all in whole numbers.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_batch, materialised

WIDTH = 64
CLUSTERS = 16
ROUNDS = 3
LONGEST = 2 ** 63 - 1
#: Planes up to which distances and sums of 64 components stay within 64-bit arithmetic.
_NARROW = 27
_PACKED = pa.schema([("vec_id", pa.int64()), ("planes", pa.list_(pa.int64()))])
_SUMS = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) for vectors(vec_id, embedding) of 64 finite components; v is floor(scale * x), clipped to a long's range."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # 2 ** 62 keeps the floor within a long for any double
    v = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-2.0 ** 62), F.least(F.lit(2.0 ** 62), c * scale))).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("embedding").isNotNull() & (F.size("embedding") == WIDTH) & whole).select("vec_id", v.alias("v"))


def pack(values: np.ndarray) -> np.ndarray:
    """Bit planes, lowest first and the sign last, of rows of 64 integers: one column per plane, as uint64."""
    values = values.reshape(-1, WIDTH)
    most = np.where(values < 0, ~values, values).max(initial=0)
    planes = [(values >> k) & 1 for k in range(int(most).bit_length() + 1)]
    bits = np.stack(planes, axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8").reshape(len(values), len(planes))


def unpack(planes: np.ndarray) -> np.ndarray:
    """The rows of 64 integers that have these planes."""
    bits = np.unpackbits(planes.astype("<u8").view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little").astype(np.int64)
    out = -(bits[:, -1] << (planes.shape[1] - 1))
    for k in range(planes.shape[1] - 1):
        out += bits[:, k] << k
    return out


def widen(planes: list[np.ndarray] | np.ndarray, width: int) -> np.ndarray:
    """Planes of rows with differing numbers of them, all with ``width``: the sign is repeated."""
    out = np.zeros((len(planes), width), dtype=np.uint64)
    for k, own in enumerate(planes):
        out[k, :len(own)] = own
        out[k, len(own):] = own[-1]
    return out


def _weight(k: int, planes: int) -> int:
    return -(1 << k) if k == planes - 1 else 1 << k


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of a with the rows of b, given as planes, by weighted popcounts."""
    kind = np.int64 if max(a.shape[1], b.shape[1]) <= _NARROW else object
    out = np.zeros((len(a), len(b)), dtype=kind)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            common = np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(kind)
            out += common * (_weight(i, a.shape[1]) * _weight(j, b.shape[1]))
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """Exact squared lengths of rows given as planes, by popcounts of their own planes."""
    n, kind = planes.shape[1], np.int64 if planes.shape[1] <= _NARROW else object
    out = np.zeros(len(planes), dtype=kind)
    for i in range(n):
        for j in range(i, n):
            common = np.bitwise_count(planes[:, i] & planes[:, j]).astype(kind)
            out += common * ((1 if i == j else 2) * _weight(i, n) * _weight(j, n))
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) of every row, ties to the smaller number; both given as planes."""
    away = squares(planes)[:, None] + squares(centroids)[None, :] - 2 * dots(planes, centroids)
    at = np.argmin(away, axis=1)
    return at, away[np.arange(len(away)), at]


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, planes) of the quantised vectors, each row with as many planes as its own values need."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
        most = np.where(values < 0, ~values, values).max(axis=1, initial=0)
        # rows of different magnitude are packed apart, so that one long vector does not widen its whole batch
        sizes = np.array([int(m).bit_length() + 1 for m in most], dtype=np.int64)
        out = [None] * len(values)
        for size in set(sizes.tolist()):
            at = np.flatnonzero(sizes == size)
            for k, row in zip(at.tolist(), pack(values[at]).view(np.int64)):
                out[k] = row
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.list_(pa.int64()))], schema=_PACKED)
    return quantised(vectors, scale).mapInArrow(by_batch(make, _PACKED), "vec_id long, planes array<long>")


def _planes(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().view(np.uint64)
    width = int(sizes.max(initial=1))
    if (sizes == width).all():
        return flat.reshape(-1, width)
    return widen(np.split(flat, np.cumsum(sizes)[:-1]), width)


def seeds(rows: DataFrame, clusters: int) -> list[list[int]]:
    """The components of the vectors whose ids' hashes are smallest: ``clusters`` rows, however many vectors there are."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(name.alias("name"), "planes").orderBy(F.col("name").asc_nulls_last(), "planes").limit(clusters).collect()
    return [unpack(np.array([r["planes"]], dtype=np.int64).view(np.uint64))[0].tolist() for r in first]


def _as_planes(centroids: list[list[int]]) -> np.ndarray:
    return pack(np.array(centroids, dtype=np.int64))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid as the floored mean of the vectors nearest to it; one without vectors stays.

    Every batch reduces its vectors to one sum per centroid and component, so what is shuffled does not depend on how
    the vectors spread over centroids; a row per centroid and component comes back.
    """
    known = _as_planes(centroids)

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        planes = _planes(batch.column(0))
        at, _ = nearest(planes, known)
        values = unpack(planes)
        if planes.shape[1] > _NARROW:
            values = values.astype(object)
        cluster, component, total, n = [], [], [], []
        for c in np.unique(at).tolist():
            own = values[at == c]
            cluster += [c] * WIDTH
            component += range(WIDTH)
            total += own.sum(axis=0).tolist()
            n += [len(own)] * WIDTH
        return pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array(n, pa.int64())],
            schema=_SUMS)

    found = rows.select("planes").mapInArrow(
        by_batch(sums, _SUMS, rows=8192), "cluster int, component int, total decimal(38,0), n long").groupBy(
        "cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = [list(c) for c in centroids]
    for r in found:
        out[r["cluster"]][r["component"]] = int(r["total"]) // r["n"]
    return out


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every row of rows(vec_id, planes); distances beyond a long are clipped to its range."""
    known = _as_planes(centroids)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, away = nearest(_planes(batch.column(1)), known)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(at, pa.int32()), pa.array(np.minimum(away, LONGEST).astype(np.int64))], schema=_ASSIGNED)
    return rows.select("vec_id", "planes").mapInArrow(
        by_batch(make, _ASSIGNED, rows=8192), "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector of vectors(vec_id, embedding).

    Vectors that are null, hold null or non-finite components or have not exactly 64 take no part. Components beyond
    2 ** 62 are clipped there, distances and inertias beyond a long to its range. Every row counts, repeated ones and ones
    without a vec_id too; the latter are the last to become a starting centroid. Rows of one id are told apart by their
    planes when centroids start. With fewer vectors than clusters every vector starts one; an empty table gives an empty
    result. Other columns are ignored. Only centroids and one inertia each pass the driver.
    """
    rows = materialised(packed(vectors, scale), "planes")
    centroids = seeds(rows, clusters)
    if not centroids:
        return rows.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = materialised(assigned(rows, centroids), "assigned")
    spread = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.array(*[F.lit(min(spread.get(k, 0), LONGEST)).cast("long") for k in range(len(centroids))])
    return found.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(spread.values()), LONGEST)).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, names)), F.col("cluster")).alias("centroid_sha256"))
