"""Mixing of sources to target weights by a low-discrepancy schedule.

Golden-ratio points in [0, 1) are mapped through the cumulative target shares, which deals slots to sources as evenly as
can be. A source's documents are laid out in shuffled order on a line of words that repeats up to ``most`` times and is cut
into equal blocks; its r-th slot takes its r-th block.
"""

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import SPACE, materialised, set_aside

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 64
#: round(2**31 / golden ratio), made odd: t * STEP mod 2**31 visits every point once before it repeats.
STEP = 1327217885
POINTS = 2 ** 31
#: Slots per chunk and rows per bucket of the two-level running counts.
CHUNK = 8192
BUCKET = 1000


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: int = MOST) -> list[float]:
    """Target words of each source: shares by weight of all words, none above ``most`` times its source's size.

    What a source at its limit leaves over is shared again by weight among the others.
    """
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while free:
        weight = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if left * weights[i % len(weights)] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i % len(weights)] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """docs with the number of words of its text in _size; a null text has none."""
    words = F.regexp_count(F.col("text"), F.lit(f"[^{SPACE}]+"))
    return docs.withColumn("_size", F.coalesce(words, F.lit(0)).cast("long"))


def _running(rows: DataFrame, group: str, bucket: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """The sum of value over the rows of a group before each row, by sums of buckets and then inside each bucket."""
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(base, [group, bucket]).withColumn(name, F.col("_base") + F.col("_own")).drop("_base", "_own")


def slots(spark, quota: Sequence[int], goals: Sequence[float], block: int) -> DataFrame:
    """(source_no, rank, slot): which source each slot of the schedule draws from, and its rank there.

    Slots beyond a source's quota are left out; a source that comes out short gets its missing slots at the end.
    """
    total = sum(goals)
    count = -(-int(total) // block) if total else 0
    edges, at = [], 0.0
    for goal in goals:
        at += goal
        edges.append(int(round(POINTS * at / total)) if total else 0)
    point = (F.pmod(F.col("id"), F.lit(POINTS)) * F.lit(STEP)) % F.lit(POINTS)
    source = F.size(F.filter(F.array(*[F.lit(e) for e in edges] or [F.lit(0)]), lambda e: e <= point)).cast("int")
    dealt = spark.range(count).select(
        F.col("id").alias("slot"), source.alias("source_no"), F.floor(F.col("id") / CHUNK).cast("long").alias("_chunk"),
        F.lit(1).cast("long").alias("_one"))
    ranked = _running(dealt, "source_no", "_chunk", ["slot"], "_one", "rank")
    reached = ranked.groupBy("source_no").agg((F.max("rank") + 1).alias("_n"))
    wanted = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quota)] or [(0, 0)], "source_no int, _quota long")
    short = wanted.join(F.broadcast(reached), "source_no", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter("_n < _quota").select(
        "source_no", F.explode(F.sequence(F.col("_n"), F.col("_quota") - 1)).alias("rank"))
    made_up = short.withColumn("slot", F.lit(count) + F.col("rank"))
    return ranked.join(F.broadcast(wanted), "source_no").filter("rank < _quota").select("source_no", "rank", "slot").unionByName(
        made_up.select("source_no", "rank", "slot"))


class Mix:
    """A mix of docs(text, source, ...): its sources with their targets, and the schedule of word spans."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK):
        spark = docs.sparkSession
        kept = sized(docs.select("doc_id", "source", "text")).select(
            "doc_id", "source", F.col("_size").alias("size"), F.xxhash64("doc_id", "text").alias("text_hash"))
        self.rows = materialised(kept, "sizes")
        self.block, self.most = block, most
        # one row per source of the mix, as many as there are weights to set
        found = [(r["source"], r["n"], r["rows"]) for r in self.rows.groupBy("source").agg(
            F.sum("size").alias("n"), F.count("*").alias("rows")).collect()]
        found.sort(key=lambda r: (r[0] is None, r[0] or ""))
        self.names, self.sizes = [r[0] for r in found], [r[1] for r in found]
        self.goals = targets(self.sizes, weights, most)
        self.whole = [min(int(round(g)), most * n) for g, n in zip(self.goals, self.sizes)]
        self.buckets = max(1, -(-sum(r[2] for r in found) // BUCKET))
        self.sources = spark.createDataFrame(
            list(zip(range(len(found)), self.names, self.sizes, self.goals, self.whole)) or [(0, None, 0, 0.0, 0)],
            "source_no int, source string, source_size long, target double, whole long")

    @cached_property
    def placed(self) -> DataFrame:
        """Rows of documents with the place of their first word on their source's line; equal rows come once, with their count.

        They are written once: the schedule and what joins it read them, and each of their plans stays small on the driver.
        """
        merged = self.rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("copies"))
        numbered = merged.join(F.broadcast(self.sources), merged.source.eqNullSafe(self.sources.source)).drop(self.sources.source)
        spread = numbered.withColumn("_order", F.xxhash64("text_hash", "doc_id", F.lit(7))).withColumn(
            "_bucket", F.floor((F.col("_order") / F.lit(2.0 ** 64) + 0.5) * self.buckets).cast("long")).withColumn(
            "_words", F.col("size") * F.col("copies"))
        return materialised(_running(spread, "source_no", "_bucket", ["_order", "doc_id", "text_hash"], "_words", "place"), "placed")

    def spans(self) -> DataFrame:
        """(slot, source_no, doc_id, text_hash, from_word, n_words): the schedule; from_word counts through a document's copies."""
        quota = [-(-n // self.block) for n in self.whole]
        epoch = F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))).alias("_epoch")
        copies = self.placed.filter("_words > 0").select("*", epoch).withColumn(
            "_from", F.col("_epoch") * F.col("source_size") + F.col("place")).filter("_from < whole").withColumn(
            "_to", F.least(F.col("_from") + F.col("_words"), F.col("whole")))
        cut = copies.withColumn("rank", F.explode(F.sequence(
            F.floor(F.col("_from") / self.block).cast("long"), F.floor((F.col("_to") - 1) / self.block).cast("long"))))
        dealt = slots(self.rows.sparkSession, quota, self.goals, self.block)
        begin = F.greatest(F.col("_from"), F.col("rank") * self.block)
        return cut.join(dealt, ["source_no", "rank"]).select(
            "slot", "source_no", "doc_id", "text_hash", (begin - F.col("_from")).alias("from_word"),
            (F.least(F.col("_to"), (F.col("rank") + 1) * self.block) - begin).alias("n_words"))

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) for every row; equal rows share what the mix takes of them.

        A null text and one without words have size 0 and are taken 0 times; a null source is a source of its own, the last;
        null ids are kept. An empty table gives an empty result.
        """
        drawn = self.spans().groupBy("source_no", "doc_id", "text_hash").agg(F.sum("n_words").alias("_taken"))
        placed = self.placed
        joined = placed.join(
            drawn, (placed.source_no == drawn.source_no) & placed.doc_id.eqNullSafe(drawn.doc_id) & (placed.text_hash == drawn.text_hash),
            "left").select(placed["*"], F.coalesce("_taken", F.lit(0)).alias("_taken"))
        share = F.floor(F.col("_taken") / F.col("copies")).cast("long")
        rest = F.col("_taken") - share * F.col("copies")
        return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
            "doc_id", "source", "size", "source_size", "target", (share + (F.col("_copy") <= rest).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) as often as the mix takes them, up to ``most`` times, with docs' own columns.

    A document of which at least half a copy more is taken gets that copy whole; one without words is not in the mix.
    """
    docs, restore = set_aside(docs, ("doc_id", "text", "source"))
    mix = Mix(docs, weights, most, block)
    drawn = materialised(mix.spans().groupBy("source_no", "doc_id", "text_hash").agg(F.sum("n_words").alias("_taken")), "drawn")
    placed = mix.placed.select("source_no", "doc_id", "text_hash", "source", "_words").alias("p")
    times = drawn.alias("d").join(placed, (F.col("d.source_no") == F.col("p.source_no")) & (F.col("d.text_hash") == F.col("p.text_hash"))
                                  & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select(
        F.col("p.doc_id").alias("_id"), F.col("p.source").alias("_source"), F.col("p.text_hash").alias("_hash"),
        F.round(F.col("_taken") / F.col("_words")).cast("int").alias("_times")).filter("_times > 0")
    hashed = docs.withColumn("_text_hash", F.xxhash64("doc_id", "text"))
    return restore(hashed.join(
        times, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_text_hash") == F.col("_hash"))
    ).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))
