"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of ``K`` words is hashed, building on the hashes of shorter runs; of every ``W`` successive hashes the smallest is
kept, the rightmost if it occurs more than once, with its position. Two texts that share K + W - 1 words in a row share a
kept hash.
"""

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import NULL_ID, SPACE, shuffle_width

K = 5
W = 4
_POSITIONS = 2 ** 31 - 1


def _shifted(column: Column, by: int) -> Column:
    return F.slice(column, by + 1, F.size(column))


def with_fingerprint(rows: DataFrame, text: str, name: str, keep_positions: bool = False) -> DataFrame:
    """rows with the kept hashes of a text column as ``name``: array<long>, in order of position, repeats left out.

    With positions, ``name``_at holds a struct (hash, position) for every kept place. The arrays in between are columns of
    their own, since Spark would compute a nested array function anew wherever it is used twice.
    """
    h, p = f"_{name}_h", f"_{name}_p"
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+"), "")
    rows = rows.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    done, hashed = 1, h
    while done * 2 <= K:
        part = f"_{name}_{done * 2}"
        rows = rows.withColumn(part, F.zip_with(hashed, _shifted(F.col(hashed), done), lambda a, b: F.xxhash64(a, b)))
        done, hashed = done * 2, part
    for extra in range(done, K):
        part = f"_{name}_{extra + 1}"
        rows = rows.withColumn(part, F.zip_with(hashed, _shifted(F.col(h), extra), lambda a, b: F.xxhash64(a, b)))
        hashed = part
    grams = F.slice(hashed, 1, F.when(F.size(h) == 0, 0).otherwise(F.greatest(F.size(h) - (K - 1), F.lit(1))))
    packed = F.transform(grams, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR((F.lit(_POSITIONS) - i).cast("long")))
    rows = rows.withColumn(p, packed)
    least, low = p, 1
    while low < W:
        step = min(low, W - low)
        part = f"_{name}_min{low + step}"
        rows = rows.withColumn(part, F.zip_with(least, _shifted(F.col(least), step), lambda a, b: F.least(a, b)))
        least, low = part, low + step
    windows = F.when(F.size(p) == 0, 0).otherwise(F.greatest(F.size(p) - (W - 1), F.lit(1)))
    at = f"{name}_at"
    rows = rows.withColumn(at, F.array_distinct(F.slice(least, 1, windows)))
    rows = rows.withColumn(name, F.array_distinct(F.transform(at, lambda x: F.shiftright(x, 32))))
    made = [c for c in rows.columns if c.startswith(f"_{name}_")]
    if not keep_positions:
        return rows.drop(*made)
    places = F.transform(at, lambda x: F.struct(
        F.shiftright(x, 32).alias("hash"), (F.lit(_POSITIONS) - x.bitwiseAND(F.lit(2 ** 32 - 1))).cast("int").alias("position")))
    return rows.withColumn(at, places).drop(*made)


def digest(at: Column) -> Column:
    """32 hex digits for the kept hashes and positions."""
    halves = [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), at)), 16, "0")) for seed in (1, 2)]
    return F.concat(*halves)


def likeness(a: str, b: str) -> Column:
    """Shared among all hashes of two fingerprints; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, 1.0).otherwise(common / F.greatest(every, F.lit(1)))


def with_next(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """docs(doc_id, text) dealt into ranges of (doc_id, hash of the text), and the window in which the next row is the next document.

    An id that fills several ranges, such as a null one, is cut by the hashes of its texts; equal rows stay in one range. Every range also holds a ghost of the first row of the following one, the last range that of the very first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "_id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("_hash", F.xxhash64("text"))
    buckets = buckets or 3 * shuffle_width(spark)
    edges = rows.agg(F.percentile_approx("_id", [i / buckets for i in range(1, buckets)] or [0.5], 100_000)).first()[0] or []
    # hashes are spread evenly, so an id that is an edge n times is cut into n even parts
    times = Counter(edges)
    edges = sorted((e, -2 ** 63 + j * 2 ** 64 // n) for e, n in times.items() for j in range(n))
    at = F.struct(F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    places = F.array(*[F.struct(F.lit(e).cast("long").alias("id"), F.lit(h).cast("long").alias("hash")) for e, h in edges])
    number = F.size(F.filter(places, lambda e: e <= at)) if edges else F.lit(0)
    rows = rows.withColumn("_bucket", number.cast("int"))
    # one row per range
    heads = sorted((r["_bucket"], r["low"]["_id"], r["low"]["_hash"]) for r in rows.groupBy("_bucket").agg(
        F.min(F.struct("_id", "_hash")).alias("low")).collect())
    before = [(b, i, x, heads[k - 1][0], int(k == 0)) for k, (b, i, x) in enumerate(heads)]
    ghosts = spark.createDataFrame(before, "_bucket int, _low long, _low_hash long, _ghost_of int, _last int")
    own = F.struct(F.col("_bucket"), F.lit(0).alias("ghost"), F.lit(0).alias("last"))
    ghost = F.struct(F.col("_ghost_of").alias("_bucket"), F.lit(1).alias("ghost"), F.col("_last").alias("last"))
    is_head = (F.col("_id") == F.col("_low")) & (F.col("_hash") == F.col("_low_hash"))
    dealt = rows.join(F.broadcast(ghosts), "_bucket").withColumn(
        "_place", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own)))).select(
        "doc_id", "text", "_id", "_hash", F.col("_place._bucket").alias("_range"), F.col("_place.ghost").alias("_ghost"),
        F.col("_place.last").alias("_last"))
    return dealt, Window.partitionBy("_range").orderBy("_last", "_id", "_hash", "_ghost")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs(doc_id, text).

    The edited text has the first characters of the next document, by doc_id, in place of its last quarter; after the last
    document comes the first. A null text is empty, a null doc_id comes first, rows with one doc_id follow in the order of
    their texts' hashes. Texts of fewer than K words have one hash for all of them, texts without words none. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows, place = with_next(docs)
    rows = rows.withColumn("_next_text", F.lead("text").over(place))
    rows = with_fingerprint(rows, "text", "own")
    rows = rows.withColumn("next", F.lead("own").over(place)).filter("_ghost = 0")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next_text", F.lit(1), cut))
    rows = with_fingerprint(rows.withColumn("n_chars", n.cast("long")).withColumn("_edited", edited), "_edited", "edited")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), digest(F.col("own_at")).alias("fingerprint"),
        digest(F.col("edited_at")).alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"))
