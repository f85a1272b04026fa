"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class, word before). The frequent tokens and the end have classes of their
own, other words are classed by their last bytes. The class factor is a softmax over hashed n-gram and skip features of the last
three classes, whose contexts training counts once; each gradient update is one distributed pass over them. In a class there is a
feature for each token and one for each pair of words that training holds, without a bound on either. With c the training counts
and M the strength of the prior, a token's weight is the log of its share of the class, (c(token) + 1) / room, a pair's is
log(1 + c(pair) / (M * share)), and the softmax has the normaliser (c(word before, class) + M) / M in closed form.
Pairs are counted and looked up in one shuffle: every text sends its pairs to buckets, where those of training are counted and
all are scored.
"""

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import NULL_ID, materialised, mixed, shuffle_width, slices, small_batches

SINGLES = 40
SUFFIXES = 23
#: Class 0 is the end, then the frequent tokens, then the suffix classes; one more number marks the place before a text.
CLASSES = 1 + SINGLES + SUFFIXES
START = CLASSES
ORDER = CLASSES + 1
HASH_BITS = 13
STEPS = 20
RATE = 0.15
#: Strength of the Gaussian prior that draws the weights to those of the class frequencies.
PRIOR = 20.0
#: Strength of the prior that draws the tokens after a word to those of their class.
PAIR_PRIOR = 100.0
#: Tokens whose counts travel with the scoring code, with those of the classes after them; all others are counted in the buckets.
HEAD = 65_536
#: Training tokens for each bucket of pairs, about.
BUCKET = 2_000_000
#: Records of a bucket that are counted at a time, about.
PART = 200_000
ROWS = 2048
#: No word holds a line end.
END_TOKEN = xxhash.xxh64_intdigest(b"\n") - 2 ** 64 * (xxhash.xxh64_intdigest(b"\n") >> 63)
#: (classes back, classes back) of the features: n-grams and skips.
FEATURES = ((), (1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 2, 3))
#: First of the numbers under which the classes after frequent words are counted, beside the contexts.
AFTER = ORDER ** 3 * CLASSES
LEARN, SCORE = 1, 2
#: What a bucket holds of a pair: a pair of a rare token, of a frequent token, or a rare word before a class.
RARE, FREQUENT, BEFORE = 0, 1, 2
_TALLY = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("kind", pa.binary()), ("n", pa.binary())])
_COUNTS = pa.schema([("token", pa.int64()), ("kind", pa.int32()), ("c", pa.int64())])
_SEEN = pa.schema([("context", pa.int64()), ("targets", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_GRADIENT = pa.schema([("loss", pa.float64()), ("gradient", pa.binary())])
_RECORD = {"key": np.uint64, "sub": np.uint32, "code": np.uint8, "doc": np.uint16, "n": np.uint32}
_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("records", pa.int64()), ("home", pa.binary()),
                   *[(c, pa.binary()) for c in _RECORD]])
_SENT_DDL = "bucket int, batch long, records long, home binary, " + ", ".join(f"{c} binary" for c in _RECORD)
_HOME = np.dtype([("id", "i8"), ("tokens", "i8"), ("known", "i8"), ("base", "f8"), ("score", "f8"), ("doc", "i8")])
_SUM = {"doc": np.uint16, "known": np.uint32, "base": np.float64, "score": np.float64}
_SUMS = pa.schema([("batch", pa.int64()), ("records", pa.int64()), ("home", pa.binary()), *[(c, pa.binary()) for c in _SUM]])
_SUMS_DDL = "batch long, records long, home binary, " + ", ".join(f"{c} binary" for c in _SUM)
_SCORED = pa.schema([("doc", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_DDL = "doc long, n_tokens long, n_known long, base_score double, score double"


def kind_of(word: bytes) -> int:
    """Number of a word's suffix class."""
    return xxhash.xxh32_intdigest(word[-2:]) % SUFFIXES


@cache
def _kinds() -> np.ndarray:
    """kind_of for words that end in each byte and, from 256 on, in each two bytes."""
    return np.array([kind_of(bytes([x])) for x in range(256)] + [kind_of(bytes([x >> 8, x & 255])) for x in range(1 << 16)])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of all texts, each with an end; where each text begins, and the end; token and kind of each number).

    The last number is the end's.
    """
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")  # Arrow splits slices of arrays wrongly
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary())
    lengths = np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    edges = np.concatenate(([0], np.cumsum(lengths + 1)))
    numbers = np.full(edges[-1], len(distinct), dtype=np.int64)
    inside = np.ones(len(numbers), dtype=bool)
    inside[edges[1:] - 1] = False
    numbers[inside] = coded.indices.to_numpy(zero_copy_only=False)
    data, sizes = flat(distinct, np.uint8)
    last = np.cumsum(sizes) - 1
    every, ends = data.tobytes(), (last + 1).tolist()
    tokens = np.fromiter((xxhash.xxh64_intdigest(every[a:b]) for a, b in zip([0, *ends], ends)), dtype=np.uint64, count=len(ends)).view(np.int64)
    kinds = _kinds()[np.where(sizes > 1, 256 + data[last - 1].astype(np.int64) * 256, 0) + data[last]] if len(last) else last
    return numbers, edges, np.append(tokens, END_TOKEN), np.append(kinds, -1)


def dealt(bucket: np.ndarray, columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(buckets, rows of each, the columns' values as one binary value for each bucket)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    return packed(bucket, [c[order] for c in columns])


def packed(group: np.ndarray, columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """dealt() for rows that lie in order of their groups."""
    first = starts(group)
    edges = np.append(first, len(group))
    return group[first], np.diff(edges), [pa.Array.from_buffers(pa.binary(), len(first), [
        None, pa.py_buffer((edges * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]) for c in columns]


def flat(column: pa.Array | pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of packed arrays, how many each row has)."""
    array = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(array):
        return np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
    wide = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    edges = np.frombuffer(array.buffers()[1], dtype=wide)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    if edges[-1] == edges[0]:
        return np.zeros(0, dtype=kind), np.zeros(len(array), dtype=np.int64)
    return np.frombuffer(array.buffers()[2], dtype=kind, offset=edges[0], count=(edges[-1] - edges[0]) // size), np.diff(edges) // size


def starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, dtype=np.int64)


def tallied(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, in order of the keys; the sum of n over the key's places)."""
    order = np.argsort(keys)
    first = starts(keys[order])
    return order[first], np.add.reduceat(n[order], first) if len(first) else n


def counts_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place the sum of n over all places with its key."""
    order = np.argsort(keys)
    first = starts(keys[order])
    out = np.empty(len(keys), dtype=np.int64)
    if len(first):
        out[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(keys))))
    return out


def _tally(texts: DataFrame, keyed: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, spread: bool) -> DataFrame:
    """Rows for each bucket with packed (key, kind, n) of texts(text); keyed gives these for some texts, n may be summed.

    A bucket holds whole contexts, or keys by their hash if they are spread.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def summed() -> tuple:
            key, kind, n = (np.concatenate(x) for x in zip(*held))
            at, n = tallied(key, n)
            return key[at], kind[at], n

        def out() -> pa.RecordBatch:
            key, kind, n = summed()
            bucket = mixed(key.view(np.uint64), 62) % np.uint64(width) if spread else key // CLASSES % width
            found, _, columns = dealt(bucket.astype(np.int32), (key, kind, n))
            return pa.RecordBatch.from_arrays([pa.array(found), *columns], schema=_TALLY)

        for batch in batches:
            for part in slices(batch, ROWS, 4 << 20):
                held.append(keyed(part.column(0)))
            if sum(len(h[0]) for h in held) > 2_000_000:
                held = [summed()]
                if len(held[0][0]) > 1_000_000:
                    yield out()
                    held = []
        if held:
            yield out()
    return texts.mapInArrow(run, "bucket int, key binary, kind binary, n binary")


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, kind, n = (flat(rows.column(c), t)[0] for c, t in (("key", np.int64), ("kind", np.int8), ("n", np.int64)))
    at, n = tallied(key, n)
    return key[at], kind[at], n


def word_counts(texts: DataFrame) -> DataFrame:
    """(token, kind, c) of all distinct tokens of texts(text); the end has kind -1."""
    def keyed(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, _, tokens, kinds = read(part)
        return tokens, kinds.astype(np.int8), np.bincount(numbers, minlength=len(tokens))

    def merge(rows: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(_merged(rows), _COUNTS)], schema=_COUNTS)
    return _tally(texts, keyed, shuffle_width(texts.sparkSession), True).groupBy("bucket").applyInArrow(merge, "token long, kind int, c long")


def places(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each token is in the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, at, -1)


def classed(tokens: np.ndarray, kinds: np.ndarray, singles: dict[int, int]) -> np.ndarray:
    """Class of each token; the last is the end."""
    known = np.array(sorted(singles), dtype=np.int64)
    own = places(tokens, known)
    out = np.where(own >= 0, np.array([singles[t] for t in known.tolist()] + [0])[own], 1 + SINGLES + kinds)
    out[-1] = 0
    return out


def before(numbers: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """The number before each, or start."""
    out = np.concatenate(([start], numbers[:-1]))
    out[edges[:-1]] = start
    return out


def contexts(classes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The last three classes before each token as one number."""
    place = np.arange(len(classes)) - np.repeat(edges[:-1], np.diff(edges))
    out = np.zeros(len(classes), dtype=np.int64)
    for back in (1, 2, 3):
        before = np.concatenate((np.full(min(back, len(classes)), START), classes[:-back]))[:len(classes)]
        out = out * ORDER + np.where(place >= back, before, START)
    return out


def features(context: np.ndarray, bits: int = HASH_BITS) -> np.ndarray:
    """Hashed feature numbers of each context, one row each."""
    back = {1: context // ORDER ** 2, 2: context // ORDER % ORDER, 3: context % ORDER}
    out = []
    for k, parts in enumerate(FEATURES):
        value = np.full(len(context), k, dtype=np.uint64)
        for b in parts:
            value = value * np.uint64(ORDER + 1) + back[b].astype(np.uint64) + np.uint64(1)
        out.append(mixed(value, 51 + k) >> np.uint64(64 - bits))
    return np.stack(out, axis=1).astype(np.int64)


def log_softmax(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log probabilities of all classes, one row for each context."""
    logits = np.zeros((len(context), CLASSES), dtype=np.float32)
    for column in features(context).T:
        logits += weights[column]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


class Model:
    """Counts and weights: what scoring needs, all of it bounded but for the token counts and the texts, whose pairs are features."""

    def __init__(self, texts: DataFrame, counts: DataFrame, total: int, distinct: int, ends: int, singles: dict[int, int],
                 kinds: dict[int, tuple[int, int]], head: tuple[np.ndarray, np.ndarray], after: np.ndarray, weights: np.ndarray):
        self.texts, self.counts, self.total, self.distinct, self.ends = texts, counts, total, distinct, ends
        self.singles, self.kinds, self.head, self.after, self.weights = singles, kinds, head, after, weights

    def room(self) -> np.ndarray:
        """The denominator of each suffix class: its tokens, one more for each distinct one and one for all unknown words."""
        return np.array([sum(self.kinds.get(k, (0, 0))) + 1 for k in range(SUFFIXES)], dtype=np.float64)


def train(texts: DataFrame, steps: int = STEPS, rate: float = RATE, prior: float = PRIOR) -> Model:
    """Fit the model to texts(text): every document counts, in the vocabulary, in each gradient and in the pairs."""
    small_batches(texts.sparkSession)
    counts = materialised(word_counts(texts), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter("kind >= 0").orderBy(F.desc("c"), "token").limit(HEAD).select("token", "c").toArrow()
    tokens, times = frequent.column(0).to_numpy(), frequent.column(1).to_numpy()
    singles = {int(t): 1 + i for i, t in enumerate(tokens[:SINGLES])}
    rest = counts.filter("kind >= 0").filter(~F.col("token").isin(list(singles))) if singles else counts.filter("kind >= 0")
    kinds = {r["kind"]: (r["c"], r["v"]) for r in rest.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    order = np.argsort(tokens)
    head = (tokens[order], times[order])
    known = head[0]

    def keyed(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, edges, tokens, kinds = read(part)
        of = classed(tokens, kinds, singles)
        classes = of[numbers]
        # the place before a text counts as one more frequent word
        last = np.append(places(tokens, known), len(known))[before(numbers, edges, len(tokens))]
        pair = (classes > SINGLES) & (last >= 0)
        key = np.concatenate((contexts(classes, edges) * CLASSES + classes, AFTER + last[pair] * CLASSES + classes[pair]))
        key, n = np.unique(key, return_counts=True)
        return key, np.zeros(len(key), dtype=np.int8), n

    def merge(rows: pa.Table) -> pa.Table:
        key, _, n = _merged(rows)
        context, target = key // CLASSES, key % CLASSES
        edges = pa.array(np.append(first := starts(context), len(key)).astype(np.int32))
        return pa.Table.from_arrays([
            pa.array(context[first]), pa.ListArray.from_arrays(edges, pa.array(target)), pa.ListArray.from_arrays(edges, pa.array(n))], schema=_SEEN)

    # a row for each three classes and each frequent word that occur: ORDER ** 3 and HEAD + 1 of them exist, none is left out
    seen = materialised(_tally(texts, keyed, shuffle_width(texts.sparkSession), False).groupBy("bucket").applyInArrow(
        merge, "context long, targets array<long>, n array<long>"), "contexts")
    table = seen.filter(F.col("context") < ORDER ** 3).coalesce(8)
    after = np.zeros((len(known) + 1, SUFFIXES), dtype=np.int64)
    found = seen.filter(F.col("context") >= ORDER ** 3).toArrow()
    row = np.repeat(found.column(0).to_numpy() - ORDER ** 3, pc.list_value_length(found.column(1)).to_numpy())
    after[row, pc.list_flatten(found.column(1)).to_numpy() - 1 - SINGLES] = pc.list_flatten(found.column(2)).to_numpy()

    weights = np.zeros((1 << HASH_BITS, CLASSES), dtype=np.float32)
    frequency = np.ones(CLASSES)
    ends = counts.filter("kind < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    frequency[0] = max(1, ends)
    frequency[1:1 + min(SINGLES, len(times))] = times[:SINGLES]
    for k, (c, _) in kinds.items():
        frequency[1 + SINGLES + k] = c
    weights[features(np.zeros(1, dtype=np.int64))[0][0]] += np.log(frequency / frequency.sum())
    start, mean, square = weights, np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1 if total else 0):
        found = table.mapInArrow(_gradients(weights), "loss double, gradient binary").toArrow()
        gradient = sum(np.frombuffer(g.as_py(), dtype=np.float32).reshape(weights.shape) for g in found.column(1))
        gradient = (gradient + prior * (weights - start)) / np.float32(total)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        pace = rate * (1 - (step - 1) / steps)
        weights = (weights - pace * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return Model(texts, counts, total, distinct, ends, singles, kinds, head, after, weights)


def _gradients(weights: np.ndarray):
    """A mapInArrow function: one row per task with the gradient of the log loss over the task's contexts."""
    def run(batches):
        gradient, loss = np.zeros(weights.shape, dtype=np.float64), 0.0
        for batch in batches:
            context = batch.column(0).to_numpy().astype(np.int64)
            lists, n = batch.column(1), batch.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            target = lists.flatten().to_numpy().astype(np.int64)
            chance = log_softmax(weights, context)
            loss -= float((chance[row, target] * n).sum())
            total = np.bincount(row, weights=n, minlength=batch.num_rows)
            wrong = np.exp(chance) * total[:, None]
            np.subtract.at(wrong, (row, target), n)
            for column in features(context).T:
                order = np.argsort(column, kind="stable")
                sorted_column = column[order]
                first = np.flatnonzero(np.concatenate(([True], sorted_column[1:] != sorted_column[:-1])))
                gradient[sorted_column[first]] += np.add.reduceat(wrong[order], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.astype(np.float32).tobytes()])], schema=_GRADIENT)
    return run


def _sends(model: Model, buckets: int):
    """A mapInArrow function of (doc, use, text): what a batch knows of its documents, and the records of its pairs by bucket."""
    total, distinct, singles, ends = model.total, model.distinct, model.singles, model.ends
    (head_tokens, head_counts), after, weights = model.head, model.after, model.weights

    def send(batch: pa.RecordBatch, name: bytes, chances: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, use = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
        numbers, edges, tokens, kinds = read(batch.column(2))
        own = xxhash.xxh64_intdigest(name + doc.tobytes()) >> 1
        size, rows = len(tokens), batch.num_rows
        of = classed(tokens, kinds, singles)
        classes, text = of[numbers], np.repeat(np.arange(rows), np.diff(edges))
        context = contexts(classes, edges)
        needed = np.zeros(ORDER ** 3, dtype=bool)
        needed[context] = True
        needed = np.flatnonzero(needed & ~known)
        for k in range(0, len(needed), 20_000):
            chances[needed[k:k + 20_000]] = log_softmax(weights, needed[k:k + 20_000])
        known[needed] = True
        chance = chances[context, classes] / np.log(10)

        place = places(tokens, head_tokens)
        count = np.where(place >= 0, np.append(head_counts, 0)[place], 0)
        count[-1] = ends
        here = place >= 0
        here[-1] = True
        base = np.where(here, np.log10((count + 1) / (total + distinct + 1)), 0)
        # pairs whose second word shares its class with others
        last = before(numbers, edges, size)
        inside = classes > SINGLES
        pair, n = np.unique((text[inside] * (size + 1) + last[inside]) * size + numbers[inside], return_counts=True)
        row, first, second = pair // size // (size + 1), pair // size % (size + 1), pair % size
        kind, first_place = kinds[second], np.append(place, len(head_tokens))[first]
        after_known = first_place >= 0
        room_after = np.where(after_known, -n * np.log10(after[first_place, kind] + PAIR_PRIOR), 0)
        sums = [np.bincount(text, weights=w, minlength=rows) for w in (chance, base[numbers], (here & (count > 0))[numbers])]
        home = np.zeros(rows, dtype=_HOME)
        home["id"], home["tokens"], home["known"], home["doc"] = doc, np.diff(edges), sums[2], np.arange(rows)
        home["base"], home["score"] = sums[1], sums[0] + np.bincount(row, weights=room_after, minlength=rows)

        word = np.append(tokens, ~END_TOKEN).view(np.uint64)
        rare = ~here[second]
        far, far_n = np.unique(((row * (size + 1) + first) * SUFFIXES + kind)[~after_known], return_inverse=True)
        far_n = np.bincount(far_n, weights=n[~after_known], minlength=len(far)).astype(np.int64)
        key = np.concatenate((np.where(rare, word[second], word[first]), word[far // SUFFIXES % (size + 1)]))
        sub = np.concatenate((np.where(rare, mixed(word, 63)[first] >> np.uint64(32), place[second].astype(np.uint64)), np.zeros(len(far), dtype=np.uint64)))
        code = np.concatenate((kind + np.where(rare, RARE, FREQUENT) * 32, far % SUFFIXES + BEFORE * 32))
        row, n = np.concatenate((row, far // SUFFIXES // (size + 1))), np.concatenate((n, far_n))
        bucket = (_together(key, sub, code) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(row.astype(np.uint16), kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        records = (key[order], sub[order], code[order], (row | use[row] << 12)[order], n[order])
        found, sizes, columns = packed(bucket[order], [r.astype(t) for r, t in zip(records, _RECORD.values())])
        none = [pa.nulls(1, pa.binary())] * len(_RECORD)
        yield pa.RecordBatch.from_arrays([
            pa.array([own % buckets], pa.int32()), pa.array([own], pa.int64()), pa.array([-len(order)], pa.int64()),
            pa.array([home[use & SCORE > 0].tobytes()], pa.binary()), *none], schema=_SENT)
        yield pa.RecordBatch.from_arrays([
            pa.array(found.astype(np.int32)), pa.array(np.full(len(found), own)), pa.array(sizes), pa.nulls(len(found), pa.binary()), *columns], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        # the class factor of the contexts met so far
        chances, known = np.empty((ORDER ** 3, CLASSES), dtype=np.float32), np.zeros(ORDER ** 3, dtype=bool)
        for batch in batches:
            for part in slices(batch, ROWS, 4 << 20):
                yield from send(part, b"%d %d " % (task, k), chances, known)
                k += 1
    return run


def _together(key: np.ndarray, sub: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What records need the same bucket by: rare tokens are counted over all their pairs, the pairs of a frequent word are spread."""
    return np.where(code < 32, mixed(key, 62), _group(key, sub, code))


def _group(key: np.ndarray, sub: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What is counted together; frequent tokens and rare words before a class need the kind, too."""
    with np.errstate(over="ignore"):
        return mixed(key + mixed(sub.astype(np.uint64) << np.uint64(8) | code.astype(np.uint64), 64), 65)


def _adds(model: Model):
    """An applyInArrow function of a bucket: counts its records' keys in training and sums the scores by batch and document.

    Records are counted in parts by what is counted together, so that a bucket needs little more than its own bytes.
    """
    room, scale, head_counts = model.room(), model.total + model.distinct + 1, np.append(model.head[1], 0)

    def part_sums(key: np.ndarray, sub: np.ndarray, code: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """What each record adds to (known, base, score) of its document; no other record is counted together with these."""
        learnt = n * (doc >> 12 & LEARN)
        kind, sort = code & 31, code >> 5
        pairs = counts_of(_group(key, sub, code), learnt)
        rare, words = np.flatnonzero(sort == RARE), sort != BEFORE
        times = np.where(sort == FREQUENT, head_counts[np.where(sort == FREQUENT, sub, 0)], 0)
        times[rare] = counts_of(key[rare], learnt[rare])
        share = np.where(words, (times + 1) / room[kind], 1)
        score = n * np.log10(pairs + PAIR_PRIOR * share) * np.where(words, 1, -1)
        base, known = np.zeros(len(n)), np.zeros(len(n), dtype=np.int64)
        base[rare] = n[rare] * np.log10((times[rare] + 1) / scale)
        known[rare] = n[rare] * (times[rare] > 0)
        return known, base, score

    def add(rows: pa.Table) -> pa.Table:
        without = pc.is_null(rows.column("home"))
        at_home = rows.select(["batch", "records", "home"]).filter(pc.invert(without))
        batch, records = (rows.column(c).filter(without).to_numpy() for c in ("batch", "records"))
        (key, sizes), *others = [flat(rows.column(c).filter(without), t) for c, t in _RECORD.items()]
        sub, code, doc, n = (x for x, _ in others)
        # the records of one document in one batch have one sum
        blob = np.repeat(np.arange(len(batch), dtype=np.int32), sizes)
        first = starts(blob * np.int64(ROWS) + (doc & 0xFFF))
        place = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(doc))))
        blob, held = blob[first], doc[first]
        summed = [np.zeros(len(first)) for _ in range(3)]
        parts = 1 + len(key) // PART
        part = np.zeros(len(key), dtype=np.uint16)
        for k in range(0, len(key), PART):
            here = slice(k, k + PART)
            part[here] = mixed(_together(key[here], sub[here], code[here]), 66) % np.uint64(parts)
        for k in range(parts):
            at = np.flatnonzero(part == k)
            for total, own in zip(summed, part_sums(key[at], sub[at].astype(np.int64), code[at].astype(np.int64), doc[at], n[at].astype(np.int64))):
                total += np.bincount(place[at], weights=own, minlength=len(first))
        wanted = held >> 12 & SCORE > 0
        found, _, columns = packed(blob[wanted], [x[wanted].astype(t) for x, t in zip((held & 0xFFF, *summed), _SUM.values())])
        left = np.setdiff1d(np.arange(len(batch)), found)  # batches that only learn here
        parts = [pa.RecordBatch.from_arrays([
            pa.array(batch[found]), pa.array(records[found]), pa.nulls(len(found), pa.binary()), *columns], schema=_SUMS)]
        parts += [pa.RecordBatch.from_arrays([
            pa.array(b), pa.array(r), h, *[pa.nulls(len(b), pa.binary())] * len(_SUM)], schema=_SUMS) for b, r, h in (
            (batch[left], records[left], pa.nulls(len(left), pa.binary())),
            (at_home.column("batch").to_numpy(), at_home.column("records").to_numpy(), at_home.column("home").combine_chunks().cast(pa.binary())))]
        return pa.Table.from_batches(parts, schema=_SUMS)
    return add


def _total(rows: pa.Table) -> pa.Table:
    """The documents of a batch with the sums of their parts."""
    if pc.sum(rows.column("records")).as_py() != 0:
        raise RuntimeError("a batch of documents was read again with other rows; store the input first")
    home = np.frombuffer(rows.column("home").drop_null()[0].as_py(), dtype=_HOME)
    doc, *found = [flat(rows.column(c).drop_null(), t)[0] for c, t in _SUM.items()]
    known, base, score = (np.bincount(doc, weights=x, minlength=ROWS)[home["doc"]] for x in found)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((
        home["id"], home["tokens"], home["known"] + known.astype(np.int64), home["base"] + base, home["score"] + score), _SCORED)], schema=_SCORED)


def _score(rows: DataFrame, model: Model) -> DataFrame:
    small_batches(rows.sparkSession)
    buckets = max(shuffle_width(rows.sparkSession), model.total // BUCKET)
    sent = rows.mapInArrow(_sends(model, buckets), _SENT_DDL)
    found = sent.groupBy("bucket").applyInArrow(_adds(model), _SUMS_DDL).groupBy("batch").applyInArrow(_total, _SCORED_DDL)
    return found.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_tokens", "n_known", "base_score", "score")


def _rows(docs: DataFrame, use: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), use.alias("use"), F.col("text").cast("string").alias("text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of docs(doc_id, text).

    A null text has only the end. The model's texts are read again for their pairs.
    """
    learnt = model.texts.select(F.lit(NULL_ID).alias("doc"), F.lit(LEARN).alias("use"), F.col("text").cast("string").alias("text"))
    return _score(_rows(docs, F.lit(SCORE)).unionByName(learnt), model)


def scored(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text).

    Learns from the rows whose crc32 of the doc_id as text is not 2 modulo 7; a null doc_id counts as the empty text.
    base_score is an add-one unigram model's, score this model's log10 probability of the whole text with its end. Words
    that training lacks share one place in their class. Other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text")), steps)
    rows = _rows(docs, F.when(held_out(F.col("doc_id")), SCORE).otherwise(LEARN | SCORE))
    return _score(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
