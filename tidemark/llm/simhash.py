"""SimHash near-duplicate groups, linked by the generalised pigeonhole principle.

A fingerprint's 64 bits are cut into m partitions. With thresholds T that add up to radius - m + 1 (-1: skip), two
fingerprints within the radius agree up to T[i] bits in some partition i. Correlated bits go into one partition, so
that the others stay selective, and every fingerprint gets the thresholds that a dynamic program finds cheapest by the
estimated number of candidates of its own values: partitions in which its value is frequent are skipped.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import NULL_ID, by_batch, materialised, set_aside, words_of
from tidemark.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Distinct fingerprints from which bit correlations and candidate counts are estimated; results do not depend on it.
SAMPLE = 50_000
MOST_FLIPS = 2
#: Work of comparing one candidate, counted in looked-up rows: a row is shuffled and sorted, a candidate only compared.
COMPARE = 0.05
_BLOCK = 65_536
_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
_PROBES = pa.schema([("part", pa.int32()), ("value", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 for a text without words."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, _BLOCK):
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), seed=42) for i in range(start, min(n, start + _BLOCK))],
            dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of docs(doc_id, text); fp is the fingerprint as a signed long."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], schema=_FINGERPRINTS)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        by_batch(make, _FINGERPRINTS), "doc_id long, text_hash long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """Bit positions in m near-equal groups, each grown from a seed by the strongest mean correlation with its members."""
    bits = _bits(sample if len(sample) else np.zeros(1, dtype=np.uint64)).astype(np.float64)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits ** 2).sum(axis=0))
    spread[spread == 0] = 1
    alike = np.abs((bits.T @ bits) / np.outer(spread, spread))
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [left.pop(int(np.argmax(alike[np.ix_(left, left)].sum(axis=1))))]
        while len(part) < size:
            part.append(left.pop(int(np.argmax(alike[np.ix_(left, part)].sum(axis=1)))))
        parts.append(sorted(part))
    return parts


def gather(values: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of one partition as small integers."""
    out = np.zeros(len(values), dtype=np.uint64)
    for k, bit in enumerate(part):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def flips(width: int, most: int) -> list[np.ndarray]:
    """For each distance up to most, the masks with that many of width bits set."""
    return [
        np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), d)], dtype=np.uint64)
        for d in range(most + 1)]


class Allocation:
    """Partitions of the bits and, for each fingerprint, the cheapest thresholds."""

    def __init__(self, sample: np.ndarray, total: int, m: int, radius: int):
        self.m, self.radius = m, radius
        self.most = radius if m == 1 else min(radius, MOST_FLIPS)
        self.parts = correlated_parts(sample, m)
        self.scale = total / max(1, len(sample))
        self.floor = [total / 2 ** len(p) for p in self.parts]
        self.known = [np.unique(gather(sample, p), return_counts=True) for p in self.parts]
        self.masks = [flips(len(p), self.most) for p in self.parts]

    def _count(self, i: int, values: np.ndarray) -> np.ndarray:
        known, counts = self.known[i]
        if not len(known):
            return np.full(values.shape, self.floor[i])
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, counts[at] * self.scale, self.floor[i])

    def thresholds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(thresholds, cost) for each fingerprint: a dynamic program over partitions and the sum used so far."""
        n, goal = len(values), self.radius - self.m + 1
        sums = list(range(-self.m, self.m * self.most + 1))
        tables = []
        for i in range(self.m):
            own, cost, running = gather(values, self.parts[i]), {-1: np.zeros(n)}, np.zeros(n)
            for t in range(self.most + 1):
                masks = self.masks[i][t]
                running = running + len(masks)
                for mask in masks:
                    running = running + COMPARE * self._count(i, own ^ mask)
                cost[t] = running
            tables.append(cost)
        table = {0: np.zeros(n)}
        steps = []
        for cost in tables:
            new, choice = {}, {}
            for s, so_far in table.items():
                for t, c in cost.items():
                    if s + t not in sums:
                        continue
                    total = so_far + c
                    if s + t not in new:
                        new[s + t], choice[s + t] = total.copy(), np.full(n, t)
                    else:
                        better = total < new[s + t]
                        new[s + t][better] = total[better]
                        choice[s + t][better] = t
            table = new
            steps.append(choice)
        chosen, left = np.zeros((n, self.m), dtype=np.int64), np.full(n, goal)
        for i in range(self.m - 1, -1, -1):
            for s, choice in steps[i].items():
                at = left == s
                chosen[at, i] = choice[at]
            left = left - chosen[:, i]
        return chosen, table[goal]

    def probes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(partition, value to look up, fingerprint) rows."""
        chosen, _ = self.thresholds(values)
        out = []
        for i in range(self.m):
            own = gather(values, self.parts[i])
            for t in range(self.most + 1):
                at = np.flatnonzero(chosen[:, i] >= t)
                masks = self.masks[i][t]
                out.append((
                    np.full(len(at) * len(masks), i), (own[at][:, None] ^ masks[None, :]).ravel(), np.repeat(values[at], len(masks))))
        return tuple(np.concatenate(c) for c in zip(*out))

    def keys(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(partition, own value, fingerprint) rows."""
        return (
            np.repeat(np.arange(self.m), len(values)),
            np.concatenate([gather(values, p) for p in self.parts]), np.tile(values, self.m))


def cheapest_allocation(sample: np.ndarray, total: int, radius: int) -> Allocation:
    """The number of partitions whose estimated work for one fingerprint is least."""
    found = []
    some = sample[:2000]
    for m in range(min(2, radius + 1), radius + 2):
        allocation = Allocation(sample, total, m, radius)
        cost = allocation.thresholds(some)[1].mean() + m if len(some) else m
        found.append((cost, m, allocation))
    return min(found, key=lambda x: x[:2])[2]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): every two different fingerprints of distinct(fp) that differ in at most ``radius`` bits."""
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toArrow()
    sample = rows.column("fp").to_numpy().view(np.uint64)
    allocation = cheapest_allocation(sample, distinct.count(), radius)

    def rows_of(make):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            part, value, fp = make(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64))], schema=_PROBES)
        return by_batch(run, _PROBES, rows=4096)

    probes = distinct.select("fp").mapInArrow(rows_of(allocation.probes), "part int, value long, fp long")
    index = distinct.select("fp").mapInArrow(rows_of(allocation.keys), "part int, value long, fp long")
    a, b = probes.alias("a"), index.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    return a.join(
        b, (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") != F.col("b.fp")) & near
    ).select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v")).distinct()


def _groups(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of rows(doc_id, fp)."""
    distinct = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = components(links(distinct, radius))
    named = distinct.join(rooted, distinct.fp == rooted.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text); other columns are ignored.

    component_id is the smallest doc_id reachable over links. Rows with equal fingerprints meet once, as one distinct
    fingerprint; only different fingerprints are linked. A null or wordless text has fingerprint zero and is linked like
    any other. A null doc_id keeps its row, does not name a component, and has a null component_id if no other id is
    reachable. Repeated rows are all returned. An empty table gives an empty result.
    """
    rows = materialised(fingerprints(docs, shingle), "fingerprints")
    return rows.join(_groups(rows, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each group of near-duplicates, with docs' own columns: that of the smallest doc_id.

    A group without any doc_id keeps one of its rows. Rows with the doc_id that is kept for a group stay only if their text
    is the one chosen for it, the one with the smallest hash; equal rows of it are reduced to one. Where one doc_id has texts
    in several groups it may stay once for each. An empty table gives an empty result.
    """
    docs, restore = set_aside(docs, ("doc_id", "text"))
    rows = materialised(fingerprints(docs, shingle), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id"), F.col("text_hash"))).alias("_least")
    # one row per fingerprint before groups meet
    kept = rows.groupBy("fp").agg(least).join(_groups(rows, radius), "fp").groupBy("root").agg(F.min("_least").alias("_least")).select(
        F.coalesce("_least.doc_id", F.lit(NULL_ID)).alias("_id"), F.col("_least._null").alias("_null"), F.col("_least.text_hash").alias("_hash"))
    keys = ["_id", "_null", "_hash"]
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(
        "_null", F.col("doc_id").isNull()).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    return restore(keyed.join(kept, keys, "left_semi").dropDuplicates(keys))
