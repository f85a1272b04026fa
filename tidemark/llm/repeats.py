"""Removal of long repeated word sequences by recompression.

Every text is parsed by the same rounds: a short run of one symbol and then pairs of a left and a right symbol get one name,
the hash of what they stand for, so a name means the same in every task. A symbol's boundaries depend on a few words
around it, hence equal windows are cut into equal symbols away from their edges. Each window picks one such interior symbol;
successive windows that pick the same one make a span. The symbol is shared with the words around it that all these windows
hold. One that occurs in one kind of span only needs no more work: the first of these equal spans is new and the others are
repeats. Where it is shared by different spans, their windows are named and compared one by one. Spans and windows are named
by 96 bits of hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import NULL_ID, WordHashes, by_batch, mixed, word_hashes, words_of

WINDOW = 20
#: Rounds: longest symbol, in words, that may still become part of a pair. The run round before them looks two words around.
ROUNDS = (1, 1, 2)
RUN = 2
#: Words around a boundary on which it depends, and the longest symbol that the rounds make.
CONTEXT = RUN + sum(ROUNDS)
LONGEST = 2 * max(ROUNDS)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bits of a symbol's name among the 96 that name a span.
_SYMBOL = 40
#: What a task knows of a span by itself: nothing, that it repeats an earlier one, that its windows must be compared.
_OPEN, _REPEAT, _COMPARE = 0, 1, 2
#: At most so many spans per symbol and batch go to the symbol's own task; more are known to differ.
_TOLD = 2
#: A place in a text is packed into 26 bits; a text of about 400 MB has so many words.
MOST_WORDS = 2 ** 26
_SPANS = pa.schema([("name", pa.int64()), ("rest", pa.int64()), ("doc", pa.int64()), ("copy", pa.int32())])
_SPANS_DDL = "name long, rest long, doc long, copy int"
_WINDOWS = pa.schema([
    ("a", pa.int64()), ("b", pa.int32()), ("doc", pa.int64()), ("copy", pa.int32()), ("start", pa.int32()), ("n", pa.int32()),
    ("known", pa.bool_())])
_WINDOWS_DDL = "a long, b int, doc long, copy int, start int, n int, known boolean"
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def parse(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, begin, length in words) of the symbols of all texts after the last round; edges are where texts begin."""
    names, begin = hashes.copy(), np.arange(len(hashes))
    length = np.ones(len(hashes), dtype=np.int64)
    opens = np.zeros(len(hashes) + 1, dtype=bool)
    opens[edges] = True

    def joined(merge: np.ndarray, salt: int) -> None:
        """Merge each symbol marked in merge with the next one."""
        nonlocal names, begin, length
        at = np.flatnonzero(merge)
        with np.errstate(over="ignore"):
            names[at] = mixed(mixed(names[at], salt) * np.uint64(3) + names[at + 1], salt + 1)
        length[at] += length[at + 1]
        keep = np.ones(len(names), dtype=bool)
        keep[at + 1] = False
        names, begin, length = names[keep], begin[keep], length[keep]

    if len(names) > 1:
        same = (names[1:] == names[:-1]) & ~opens[begin[1:]]
        before, after = np.concatenate(([False], same[:-1])), np.concatenate((same[1:], [False]))
        joined(np.concatenate((same & ~before & ~after, [False])), 11)
    for k, limit in enumerate(ROUNDS):
        if len(names) < 2:
            break
        right = (mixed(names, 100 + k) & np.uint64(1)).astype(bool)
        short = length <= limit
        merge = ~right[:-1] & right[1:] & short[:-1] & short[1:] & ~opens[begin[1:]]
        joined(np.concatenate((merge, [False])), 200 + 2 * k)
    return names, begin, length


def picked(names: np.ndarray, begin: np.ndarray, length: np.ndarray, n_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of the symbol that the window at each position picks or -1, names by begin, lengths in words by begin).

    A window picks, among its symbols at least CONTEXT words from both edges, one of the longest with the smallest hash.
    """
    zone = window - 2 * CONTEXT
    key = np.full(n_words + window, np.iinfo(np.uint64).max, dtype=np.uint64)
    size = np.zeros(n_words + window, dtype=np.int64)
    named = np.zeros(n_words + window, dtype=np.uint64)
    key[begin] = (mixed(names, 5) >> np.uint64(4)) | ((LONGEST - length).astype(np.uint64) << np.uint64(60))
    size[begin], named[begin] = length, names
    best = np.full(n_words, np.iinfo(np.uint64).max, dtype=np.uint64)
    at = np.full(n_words, -1, dtype=np.int64)
    for d in range(zone):
        place = np.arange(n_words) + CONTEXT + d
        fits = (size[place] > 0) & (size[place] <= zone - d) & (key[place] < best)
        best[fits], at[fits] = key[place][fits], place[fits]
    return at, named, size


def whole_windows(edges: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Whether a window that begins at a word ends in the same text."""
    end = np.repeat(edges[1:], np.diff(edges))
    return np.arange(n_words) + window <= end


class Names:
    """Polynomial hashes of any word sequences in an array of word hashes."""

    def __init__(self, hashes: np.ndarray, base: int, salt: int):
        n = len(hashes)
        self.salt = salt
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)
            self.back = np.cumprod(np.full(n, pow(base, -1, 2 ** 64), dtype=np.uint64), dtype=np.uint64)
            self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed(hashes, salt) * power, dtype=np.uint64)))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[start + length] - self.sums[start]) * self.back[start] + np.uint64(1) * np.asarray(length).astype(np.uint64), self.salt + 1)


def _spread(doc: np.ndarray, start: np.ndarray, salt: int) -> np.ndarray:
    """Hashes that deal rows evenly."""
    return mixed(mixed(doc.astype(np.uint64), 7) + start.astype(np.uint64), salt)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by the keys, the position of the first row with the same keys."""
    n = len(keys[0])
    fresh = np.ones(n, dtype=bool)
    if n:
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else np.zeros(0, dtype=np.int64)


def _spans(window: int):
    known = WordHashes()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, copy = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        hashes, edges = word_hashes(batch.column(2).to_pylist(), known)
        n_words = len(hashes)
        at, _, size = picked(*parse(hashes, edges), n_words, window)
        at[~whole_windows(edges, n_words, window)] = -1
        change = np.flatnonzero(np.concatenate((at[1:] != at[:-1], [True]))) if n_words else np.zeros(0, dtype=np.int64)
        begin = np.concatenate(([0], change[:-1] + 1)).astype(np.int64)[:len(change)]
        use = at[begin] >= 0
        first, n = begin[use], (change - begin + 1)[use]
        none, middle = np.zeros(0, dtype=np.uint64), at[first]
        # equal windows agree in the symbol they pick and in CONTEXT words on both sides of it
        symbol = Names(hashes, _BASES[1], 35).of(middle - CONTEXT, size[middle] + 2 * CONTEXT) if len(first) else none
        symbol = symbol >> np.uint64(64 - _SYMBOL)
        span = Names(hashes, _BASES[0], 31).of(first, n + (window - 1)) if len(first) else none
        span = span >> np.uint64(_SYMBOL - 32)
        text = np.searchsorted(edges, first, side="right") - 1
        d, c, s = doc[text], copy[text], first - edges[text]
        if len(s) and s.max() >= MOST_WORDS:
            raise ValueError(f"a text of {MOST_WORDS} words or more")
        order = np.lexsort((s, c, d, span, symbol))
        symbol, span, d, c, s, n = (x[order] for x in (symbol, span, d, c, s, n))
        lead = _groups(symbol, span)
        repeat = (d != d[lead]) | (c != c[lead]) | (s != s[lead])
        again = ~repeat & (lead != np.arange(len(lead)))
        # how many different spans of its symbol are before a span's own
        kind = np.cumsum(lead == np.arange(len(lead)))
        kind = kind - kind[_groups(symbol)] if len(lead) else kind
        status = np.where(repeat, _REPEAT, np.where(kind >= _TOLD, _COMPARE, _OPEN))
        symbol = np.where(status == _OPEN, symbol, _spread(d, s, 8) >> np.uint64(64 - _SYMBOL))
        high, low = span >> np.uint64(32), span & np.uint64(0xFFFFFFFF)
        place = (s.astype(np.uint64) << np.uint64(6)) | (status.astype(np.uint64) << np.uint64(4)) | n.astype(np.uint64)
        name, rest = (symbol << np.uint64(64 - _SYMBOL)) | high, (low << np.uint64(32)) | place
        keep = ~again
        return pa.RecordBatch.from_arrays([
            pa.array(name[keep].view(np.int64)), pa.array(rest[keep].view(np.int64)), pa.array(d[keep]), pa.array(c[keep])], schema=_SPANS)
    return by_batch(make, _SPANS, rows=4096)


def _runs(text: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, n) of the maximal runs that ranges of windows make in each text."""
    out: list[list[int]] = []
    order = np.lexsort((start, text))
    for t, a, k in zip(text[order].tolist(), start[order].tolist(), n[order].tolist()):
        if out and out[-1][0] == t and a <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], a + k - out[-1][1])
        else:
            out.append([t, a, k])
    return [tuple(r) for r in out]


def _windows(window: int):
    known = WordHashes()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, copy = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = batch.column(3)
        spans = lists.flatten()
        of_text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        first, n = spans.field("first").to_numpy().astype(np.int64), spans.field("n").to_numpy().astype(np.int64)
        repeat = spans.field("repeat").to_numpy(zero_copy_only=False)
        runs = _runs(of_text[repeat], first[repeat], n[repeat])
        asked = np.zeros(batch.num_rows, dtype=bool)
        asked[of_text[~repeat]] = True
        texts = [t.as_py() if use else None for t, use in zip(batch.column(2), asked)]
        hashes, edges = word_hashes(texts, known)
        n_words = len(hashes)
        wanted = np.zeros(n_words + 1, dtype=np.int64)
        begin = first[~repeat] + edges[of_text[~repeat]]
        np.add.at(wanted, begin, 1)
        np.add.at(wanted, begin + n[~repeat], -1)
        at = np.flatnonzero(np.cumsum(wanted[:n_words]) > 0)
        a, b = (Names(hashes, base, 41 + k).of(at, window) if len(at) else np.zeros(0, np.uint64) for k, base in enumerate(_BASES))
        b >>= np.uint64(32)
        text = np.searchsorted(edges, at, side="right") - 1
        d, c, s = doc[text], copy[text], at - edges[text]
        order = np.lexsort((s, c, d, b, a))
        a, b, d, c, s, text = (x[order] for x in (a, b, d, c, s, text))
        lead = _groups(a, b)
        later = (d != d[lead]) | (c != c[lead]) | (s != s[lead])
        runs += _runs(text[later], s[later], np.ones(int(later.sum()), dtype=np.int64))
        fresh = lead == np.arange(len(lead))
        ri, rs, rn = (np.array(x, dtype=np.int64) for x in zip(*runs)) if runs else (np.zeros(0, dtype=np.int64),) * 3
        both = lambda x, y: pa.array(np.concatenate((x, y)))
        count = int(fresh.sum())
        return pa.RecordBatch.from_arrays([
            both(a[fresh].view(np.int64), _spread(doc[ri], rs, 9).view(np.int64)),
            both(b[fresh].astype(np.uint32).view(np.int32), np.zeros(len(ri), dtype=np.int32)), both(d[fresh], doc[ri]), both(c[fresh], copy[ri]),
            both(s[fresh].astype(np.int32), rs.astype(np.int32)), both(np.ones(count, dtype=np.int32), rn.astype(np.int32)),
            both(np.zeros(count, dtype=bool), np.ones(len(ri), dtype=bool))], schema=_WINDOWS)
    return by_batch(make, _WINDOWS, rows=4096)


def _removal(window: int, with_text: bool):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, ranges in zip(batch.column(0), batch.column(1), batch.column(2)):
            words = words_of(text.as_py())
            n = len(words)
            ranges = ranges.as_py()
            if ranges:
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, [r["start"] for r in ranges], 1)
                np.add.at(edge, [r["start"] + r["n"] - 1 + window for r in ranges], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
            kept = b" ".join(words)
            rows.append((doc.as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)
    return by_batch(make, _RESULT)


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of docs(doc_id, text); other columns are ignored.

    A word is removed if a window of ``window`` words around it also starts earlier: at a smaller doc_id, or earlier in the
    document. A null text has no words and the hash of nothing. A null doc_id is before all others. Rows that share a doc_id
    and a text are one document and all get its result; different texts of one doc_id are ordered by their hash.
    ``kept`` is null unless asked for. A text of 2**26 words or more is refused. An empty table gives an empty result.
    """
    if window - 2 * CONTEXT < 2 * LONGEST - 1:
        raise ValueError(f"a window needs at least {2 * CONTEXT + 2 * LONGEST - 1} words")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"))
    several = ids.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    copy = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if several else F.lit(0)
    key = ["doc", "copy"] if several else ["doc"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), copy.alias("copy"), "text")
    symbol = F.shiftrightunsigned("name", 64 - _SYMBOL)
    # dealt by the symbol without shipping it a second time; both windows below find their rows together
    found = rows.mapInArrow(_spans(window), _SPANS_DDL).repartition(symbol).withColumn("symbol", symbol)
    span, first = F.shiftrightunsigned("rest", 32).alias("span"), F.shiftrightunsigned(F.shiftleft("rest", 32), 38).cast("int")
    place = F.struct("doc", "copy", first.alias("first"))
    own, status = Window.partitionBy("symbol", "name", span), F.shiftright("rest", 4).bitwiseAND(F.lit(3))
    names = Window.partitionBy("symbol")
    judged = found.withColumn("kinds", F.struct(
        F.min(F.struct("name", span)).over(names).alias("low"), F.max(F.struct("name", span)).over(names).alias("high"))).withColumn(
        "origin", F.min(place).over(own)).select(
        "doc", "copy", first.alias("first"), F.col("rest").bitwiseAND(F.lit(15)).cast("int").alias("n"),
        ((status == _REPEAT) | ((status == _OPEN) & (place > F.col("origin")))).alias("repeat"),
        ((status == _COMPARE) | ((status == _OPEN) & (F.col("kinds.low") != F.col("kinds.high")))).alias("compare")).filter("repeat or compare")
    spans = judged.groupBy(*key).agg(F.collect_list(F.struct("first", "n", "repeat")).alias("spans"))
    windows = rows.join(spans, key).select("doc", "copy", "text", "spans").mapInArrow(_windows(window), _WINDOWS_DDL)
    place = F.struct("doc", "copy", "start")
    later = windows.withColumn("origin", F.min(place).over(Window.partitionBy("a", "b"))).filter(
        F.col("known") | (place > F.col("origin")))
    ranges = later.groupBy(*key).agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    result = rows.join(ranges, key, "left").select("doc", "text", "ranges").mapInArrow(
        _removal(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return result.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
