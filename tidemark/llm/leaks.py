"""Benchmark passages in documents by a prefix-filtered set join.

An item's windows are sets of shingles. Containment of a whole window needs all of them, so the necessary prefix of a
window, in the order of rarity over all documents, is its rarest shingle: only where a document has that one can the window
be. Such places are joined to the windows, dropped where the window would leave the document, and verified word by word.
Everything is array and SQL functions; what says which shingles to look at is a bit set of a fixed largest size.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import materialised

WINDOW = 10
SHINGLE = 3
#: Bits for each shingle of the items, two of which are set, and the most bits that the set may have: one megabyte. Where that
#: is less, more other shingles pass; the join drops them.
BITS_EACH = 64
MOST_BITS = 2 ** 23
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_HITS = "cast(array() as array<struct<size:int,pos:int,token:bigint,first:int,context:array<string>>>)"


def words(text: Column) -> Column:
    """The words of a text, of letters a-z (A-Z become these), digits and all beyond ASCII; a null text has none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _SEPARATORS), "")


def shingle_hash(of: Column, at: Column, size: int) -> Column:
    """The hash of ``size`` words from the 0-based place ``at``."""
    return F.xxhash64(F.lit(size), *[F.get(of, at + k) for k in range(size)])


def _places(of: Column, size: int) -> Column:
    """All places at which ``size`` words begin."""
    n = F.size(of) - size
    return F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows of items(item_id, text), which items have them).

    windows has window_id, size (of its shingles) and words; owners has window_id and item_id as a string.
    """
    of = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    long = F.greatest(F.lit(0), F.size("w") - window)
    every = of.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), long), lambda i: F.slice("w", i + 1, F.lit(window)))).alias("words"))
    named = every.select("item_id", F.sha2(F.array_join("words", " "), 256).alias("window_id"), "words")
    windows = materialised(named.groupBy("window_id").agg(F.first("words").alias("words")).withColumn(
        "size", F.least(F.size("words"), F.lit(shingle))), "windows")
    return windows, materialised(named.select("window_id", "item_id").distinct(), "owners")


def _slots(token: Column, bits: int) -> list[tuple[Column, Column]]:
    """(word, bit in it) of the two places of a token."""
    def place(of: Column) -> tuple[Column, Column]:
        return F.shiftright(of, 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int"), of.bitwiseAND(F.lit(63)).cast("int")
    return [place(token), place(F.shiftright(token, 32))]


def bit_set(tokens: DataFrame) -> tuple[Column, int]:
    """(the words of a bit set that holds all of tokens(token), its number of bits as a power of two).

    Its size follows the number of tokens up to MOST_BITS, which bounds what passes the driver and goes into the plan.
    """
    need, bits = BITS_EACH * tokens.count(), 64
    while bits < min(need, MOST_BITS):
        bits *= 2
    one = F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), b).alias("bit")) for w, b in _slots(F.col("token"), bits)])
    filled = {r["word"]: r["bits"] for r in tokens.select(F.explode(one).alias("one")).groupBy("one.word").agg(
        F.bit_or("one.bit").alias("bits")).collect()}
    # one constant: a split text folds into a single literal array
    return F.split(F.lit(",".join(str(filled.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>"), bits


def _is_set(bits: Column, n: int, token: Column) -> Column:
    first, second = (F.call_function("shiftright", F.get(bits, w), b).bitwiseAND(F.lit(1)) == 1 for w, b in _slots(token, n))
    return first & second


def _known_places(of: Column, size: int, bits: Column, n: int) -> Column:
    return F.filter(_places(of, size), lambda i: _is_set(bits, n, shingle_hash(of, i, size)))


def _own_shingles(sizes: list[int]) -> Column:
    """(token, offset) of all shingles of a window's words, which are of one size."""
    def of_size(size: int) -> Column:
        return F.transform(_places(F.col("words"), size), lambda i: F.struct(
            shingle_hash(F.col("words"), i, size).alias("token"), i.alias("offset")))
    return F.coalesce(*[F.when(F.col("size") == s, of_size(s)) for s in sizes])


def shingle_counts(of: DataFrame, sizes: list[int], bits: Column, n: int) -> DataFrame:
    """(token, n) over all rows of of(w), for the shingles in a bit set; rows are pre-aggregated in every task."""
    def of_size(size: int) -> Column:
        return F.transform(_known_places(F.col("w"), size, bits, n), lambda i: shingle_hash(F.col("w"), i, size))
    return of.select(F.explode(F.concat(*map(of_size, sizes))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rarest(windows: DataFrame, counts: DataFrame, sizes: list[int]) -> DataFrame:
    """(window_id, words, size, token, offset) of windows that can occur: their rarest shingle, and where it is in them.

    A window one of whose shingles occurs in no document cannot occur. Ties go to the smaller hash, then to the left.
    """
    each = windows.select("window_id", F.explode(_own_shingles(sizes)).alias("one")).select("window_id", "one.token", "one.offset")
    n = F.coalesce("n", F.lit(0)).alias("n")
    best = each.join(counts, "token", "left").groupBy("window_id").agg(F.min(F.struct(n, "token", "offset")).alias("best"))
    return best.filter("best.n > 0").join(windows, "window_id").select("window_id", "words", "size", "best.token", "best.offset")


def _sizes(windows: DataFrame) -> list[int]:
    """The sizes of shingles that windows have: at most SHINGLE numbers."""
    return sorted(r["size"] for r in windows.select("size").distinct().collect())


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, verified occurrences of windows(window_id, words, size) in docs(doc_id, text)).

    documents has doc_id, text_hash and n_words for every row, occurrences has doc_id, text_hash, window_id, start and end.
    Documents are cut into words twice: to count the windows' shingles over all of them, and to find the rarest.
    """
    of = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), words(F.col("text")).alias("w"))
    sizes = _sizes(windows)
    if not sizes:
        nothing = windows.select(
            F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), "window_id", F.lit(0).alias("start"),
            F.lit(0).alias("end"))
        return of.select("doc_id", "text_hash", F.size("w").alias("n_words")), nothing
    every = windows.select(F.explode(_own_shingles(sizes)).alias("one")).select("one.token").distinct()
    counts = shingle_counts(of, sizes, *bit_set(every))
    prefixes = materialised(rarest(windows, counts, sizes), "prefixes")
    sizes = _sizes(prefixes)
    bits = bit_set(prefixes.select("token").distinct())

    def hits(s: int) -> Column:
        def one(i: Column) -> Column:
            first = F.greatest(F.lit(0), i - (window - s))
            return F.struct(
                F.lit(s).alias("size"), i.alias("pos"), shingle_hash(F.col("w"), i, s).alias("token"), first.alias("first"),
                F.slice("w", first + 1, i - first + window).alias("context"))
        return F.transform(_known_places(F.col("w"), s, *bits), one)

    found = F.concat(*map(hits, sizes)) if sizes else F.expr(_NO_HITS)
    kept = materialised(of.select("doc_id", "text_hash", F.size("w").alias("n_words"), found.alias("hits")), "hits")
    places = kept.filter(F.size("hits") > 0).select("doc_id", "text_hash", "n_words", F.explode("hits").alias("h")).select(
        "doc_id", "text_hash", "n_words", "h.*")
    start = F.col("pos") - F.col("offset")
    met = places.join(prefixes, ["token", "size"]).withColumn("start", start).withColumn("end", start + F.size("words")).filter(
        # length and positional bounds, then the words themselves
        (F.col("start") >= 0) & (F.col("end") <= F.col("n_words"))).filter(
        F.slice("context", F.col("start") - F.col("first") + 1, F.size("words")) == F.col("words"))
    return kept.select("doc_id", "text_hash", "n_words"), met.select("doc_id", "text_hash", "window_id", "start", "end")


def covered(spans: Column) -> Column:
    """The number of places in the union of sorted (start, end) spans."""
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(spans, nothing, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["reach"]))).alias("n"),
        F.greatest(s["reach"], x["end"]).alias("reach")), lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of docs(doc_id, text).

    items(item_id, text) give windows of ``window`` consecutive words, or one of all their words if they have fewer; n_hit
    are the document's words in occurrences of windows, spans where these are. n_items counts the items with such windows and
    items_sha256 names them: item_ids sorted as strings. Null texts and texts without words have no words and no windows. Items
    without an item_id hit words but are neither counted nor named, several texts of one item_id are one item. Every row of docs
    has a row, repeated ones and ones without doc_id too. Empty docs give an empty result, empty items hit nothing. Other columns
    are ignored.
    """
    windows, owners = item_windows(items, window, shingle)
    rows, met = occurrences(docs, windows, window)
    per_doc = materialised(met.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("window_id")).alias("found")).withColumn(
        "set_id", F.sha2(F.array_join("found", ","), 256)), "hit")
    # documents with the same windows name the same items: these are gathered once for all of them
    sets = per_doc.groupBy("set_id").agg(F.first("found").alias("found")).select("set_id", F.explode("found").alias("window_id"))
    named = sets.join(owners.filter("item_id is not null"), "window_id").groupBy("set_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids")).select(
        "set_id", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    hit = per_doc.join(named, "set_id", "left").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), covered(F.col("spans")).cast("long").alias("n_hit"), "n_items",
        "items_sha256", "spans")
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))
