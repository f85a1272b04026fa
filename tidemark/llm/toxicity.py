"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; each logistic model sees the text's terms and the probabilities of the
categories before it. In training these are out-of-fold predictions, so that a later model meets earlier probabilities of
the quality it will meet in use.
"""

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_batch, materialised, slices, words_of

#: Labelled rows that training uses at most, the first by hash of their id.
SAMPLE = 12_000
#: Terms that the models see at most: the most telling ones of those in so many texts of a category, of which so many are tried.
TERMS = 2000
RARE = 3
CANDIDATES = 100_000
FOLDS = 3
PREFIXES = (4, 5, 6, 7)
ROUNDS = 250
RIDGE = 1e-3
CACHE = 400_000
_EDGE = b"\"'`.,;:!?()[]{}<>*#$%&|_-=+~/\\@^"


def terms_of(word: bytes) -> list[int]:
    """Hashes of a word without marks around it and of its beginnings; letters are counted, not bytes."""
    word = word.strip(_EDGE)
    if not word:
        return []
    text = word.decode("utf-8", "replace").lower()
    out = [xxhash.xxh64_intdigest(text, seed=1)]
    out += [xxhash.xxh64_intdigest(text[:n], seed=2) for n in PREFIXES if len(text) > n]
    return out


def _signed(value: int) -> int:
    return value - 2 ** 64 if value >> 63 else value


class Terms:
    """Counts of chosen terms in texts."""

    def __init__(self, chosen: dict[int, int]):
        self.chosen, self.known = chosen, {}

    def _learn(self, word: bytes) -> tuple[int, ...]:
        if len(self.known) >= CACHE:
            self.known.clear()
        found = self.known[word] = tuple(self.chosen[t] for t in terms_of(word) if t in self.chosen)
        return found

    def of(self, text: str | None) -> tuple[list[int], list[float]]:
        """(numbers of the chosen terms in the text, their values)."""
        words, counts, known = words_of(text, lower=True), Counter(), self.known
        for word in words:
            found = known.get(word)
            if found is None:
                found = self._learn(word)
            if found:
                counts.update(found)
        numbers = sorted(counts)
        return numbers, [value(counts[n], len(words)) for n in numbers]


def value(count: int, words: int) -> float:
    """A term's value: higher for terms that make up much of a text than for single ones in long texts."""
    return float(np.log1p(count * 400.0 / (words + 100.0)))


class Rows:
    """Sparse feature rows with some dense columns, and products with them."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray, width: int):
        self.n, self.width, self.dense = len(sizes), width, dense
        self.row = np.repeat(np.arange(self.n), sizes)
        self.column, self.value = columns.astype(np.int64), values.astype(np.float64)

    @classmethod
    def of(cls, numbers: Sequence[Sequence[int]], values: Sequence[Sequence[float]], dense: np.ndarray, width: int) -> "Rows":
        flat = [np.array([x for row in rows for x in row], dtype=kind) for rows, kind in ((numbers, np.int64), (values, np.float64))]
        return cls(np.array([len(x) for x in numbers], dtype=np.int64), *flat, dense, width)

    def times(self, weights: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.row, weights=self.value * weights[self.column], minlength=self.n)
        return sparse + self.dense @ weights[self.width:-1] + weights[-1]

    def back(self, errors: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.column, weights=self.value * errors[self.row], minlength=self.width)
        return np.concatenate((sparse, self.dense.T @ errors, [errors.sum()]))

    def only(self, keep: np.ndarray) -> "Rows":
        out = object.__new__(Rows)
        place = np.cumsum(keep) - 1
        at = keep[self.row]
        out.n, out.width, out.dense = int(keep.sum()), self.width, self.dense[keep]
        out.row, out.column, out.value = place[self.row[at]], self.column[at], self.value[at]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(rows: Rows, target: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a ridge logistic regression, by accelerated gradient steps; the last one is the intercept."""
    n, size = max(1, rows.n), rows.width + rows.dense.shape[1] + 1
    scale = np.zeros(size)
    scale[:rows.width] = np.bincount(rows.column, weights=rows.value ** 2, minlength=rows.width) / n
    scale[rows.width:-1] = (rows.dense ** 2).mean(axis=0) if rows.n else 0
    scale[-1] = 1
    per_row = np.bincount(rows.row, minlength=n).max(initial=0) + rows.dense.shape[1] + 1
    pace = 1 / (0.25 * np.sqrt(scale + 1e-6) * np.sqrt(per_row) * np.sqrt(scale.max()) + ridge)
    weights = np.zeros(size)
    rate = target.mean() if rows.n else 0.0
    weights[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    ahead, momentum = weights.copy(), 1.0
    for _ in range(rounds):
        penalty = ridge * ahead
        penalty[-1] = 0
        step = ahead - pace * (rows.back(sigmoid(rows.times(ahead)) - target) / n + penalty)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        if ((step - weights) * (ahead - step)).sum() > 0:
            following = 1.0
        ahead = step + (momentum - 1) / following * (step - weights)
        weights, momentum = step, following
    return weights


def best_cut(probability: np.ndarray, target: np.ndarray) -> float:
    """The probability from which on the most F1 is had."""
    order = np.argsort(-probability, kind="stable")
    hits = np.cumsum(target[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, target.sum()))
    k = int(np.argmax(f1)) if len(order) else 0
    if not len(order) or not target.any():
        return 0.5
    following = probability[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((probability[order[k]] + following) / 2)


class Chain:
    """Chosen terms, one model per category in order, and the cut of each category."""

    def __init__(self, categories: list[str], chosen: dict[int, int], weights: list[np.ndarray], cuts: list[float]):
        self.categories, self.chosen, self.weights, self.cuts = categories, chosen, weights, cuts

    def probabilities(self, numbers: list[list[int]], values: list[list[float]]) -> np.ndarray:
        found = np.zeros((len(numbers), 0))
        for weights in self.weights:
            rows = Rows.of(numbers, values, found, len(self.chosen))
            found = np.column_stack((found, sigmoid(rows.times(weights))))
        return found


def _seen(sample: DataFrame, categories: list[str], rare: int) -> list[int]:
    """The terms in at least ``rare`` texts of some category, the most frequent CANDIDATES of them."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text in batch.column(0):
            counts.update({t for w in set(words_of(text.as_py(), lower=True)) for t in terms_of(w)})
        return pa.RecordBatch.from_arrays([pa.array([_signed(t) for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    some = F.greatest(*[F.coalesce(c, F.lit(0)) for c in categories], F.lit(0)) > 0
    found = sample.filter(some).select("text").mapInArrow(by_batch(count, schema), "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= rare).orderBy(F.desc("n"), "term").limit(CANDIDATES).select("term").toArrow()
    return [t % 2 ** 64 for t in found.column(0).to_pylist()]


def _telling(sample: DataFrame, categories: list[str], most: int, rare: int) -> dict[int, int]:
    """Numbers of the terms that tell some category best, by the chi-square statistic of their document counts."""
    width = len(categories)
    schema = pa.schema([("number", pa.int32()), *[(f"n{k}", pa.int64()) for k in range(2 * width)]])
    terms = _seen(sample, categories, rare)
    counted = Terms({t: i for i, t in enumerate(terms)})

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables = np.zeros((2 * width, len(terms)), dtype=np.int64)
        for i, text in enumerate(batch.column(0)):
            numbers = counted.of(text.as_py())[0]
            for k in range(width):
                label = batch.column(1 + k)[i].as_py()
                if label is not None:
                    tables[2 * k + int(label > 0)][numbers] += 1
        at = np.flatnonzero(tables.any(axis=0))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(t[at]) for t in tables]], schema=schema)

    ddl = "number int, " + ", ".join(f"n{k} long" for k in range(2 * width))
    totals = sample.agg(*[F.count(F.when((F.col(c) > 0) == F.lit(bool(y)), 1)) for c in categories for y in (0, 1)]).first()
    summed = sample.select("text", *categories).mapInArrow(by_batch(count, schema), ddl).groupBy("number").agg(
        *[F.sum(f"n{k}").alias(f"n{k}") for k in range(2 * width)])
    scores = []
    for k in range(width):
        clean, bad = totals[2 * k], totals[2 * k + 1]
        a, b = F.col(f"n{2 * k + 1}").cast("double"), F.col(f"n{2 * k}").cast("double")
        c, d, n = F.lit(float(bad)) - a, F.lit(float(clean)) - b, F.lit(float(clean + bad))
        below = (a + b) * (c + d) * F.lit(float(clean)) * F.lit(float(bad))
        scores.append(F.when(below > 0, n * F.pow(a * d - b * c, F.lit(2.0)) / F.when(below > 0, below)).otherwise(0.0))
    top = summed.withColumn("score", F.greatest(*scores) if width > 1 else scores[0]).orderBy(
        F.desc("score"), "number").limit(most).select("number").toArrow()
    return {terms[number]: i for i, number in enumerate(top.column(0).to_pylist())}


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, terms: int = TERMS, rare: int = RARE,
          folds: int = FOLDS) -> Chain:
    """Fit a chain on docs(doc_id, text) and labels(doc_id, *categories) with 0, 1 or null for unknown.

    Of several labels of a document the highest counts. Rows without id or whose labels are all null are not used.
    """
    spark, categories = docs.sparkSession, list(categories)
    known = labels.filter(F.col("doc_id").isNotNull() & F.coalesce(*categories).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        *[F.max(c).cast("int").alias(c) for c in categories]).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = materialised(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).dropDuplicates(
        ["doc_id"]).select("doc_id", "text", *categories), "labelled")
    chosen = _telling(rows, categories, terms, rare)
    schema = pa.schema([("doc_id", pa.int64()), ("numbers", pa.list_(pa.int32())), ("values", pa.list_(pa.float32())), *[(c, pa.int32()) for c in categories]])
    counted = Terms(chosen)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, values = zip(*[counted.of(t.as_py()) for t in batch.column(1)])
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(numbers, schema.field(1).type), pa.array(values, schema.field(2).type),
            *[batch.column(2 + k) for k in range(len(categories))]], schema=schema)

    ddl = "doc_id long, numbers array<int>, values array<float>, " + ", ".join(f"`{c}` int" for c in categories)
    # at most ``sample`` rows of a few chosen terms
    table = rows.mapInArrow(by_batch(describe, schema), ddl).toArrow().sort_by("doc_id")
    numbers, values = (table.column(c).combine_chunks() for c in ("numbers", "values"))
    # small types, since this travels to the tasks
    sizes = np.diff(numbers.offsets.to_numpy()).astype(np.int32)
    columns, values = numbers.flatten().to_numpy().astype(np.uint16 if terms <= 65_536 else np.int32), values.flatten().to_numpy()
    fold = np.array([xxhash.xxh32_intdigest(str(i)) % folds for i in table.column("doc_id").to_pylist()], dtype=np.int64)
    weights, cuts, earlier = [], [], np.zeros((len(sizes), 0))
    for c in categories:
        label = table.column(c).to_pylist()
        given = np.array([x is not None for x in label], dtype=bool)
        target = np.array([float((x or 0) > 0) for x in label])
        data = (sizes, columns, values, earlier, len(chosen))
        model, own = _fitted(spark, data, target, given, fold, folds)
        weights.append(model)
        cuts.append(best_cut(own[given], target[given]))
        earlier = np.column_stack((earlier, own))
    return Chain(categories, chosen, weights, cuts)


def _fitted(spark, data: tuple, target: np.ndarray, given: np.ndarray, fold: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the model on all rows, each row's probability by the model without its fold), fitted as tasks of one job."""
    schema = pa.schema([("model", pa.int64()), ("weights", pa.list_(pa.float64())), ("unseen", pa.list_(pa.float64()))])

    def fit(batches):
        for batch in batches:
            for model in batch.column(0).to_pylist():
                rows, use = Rows(*data), given & (fold != model)
                weights = logistic(rows.only(use), target[use])
                unseen = sigmoid(rows.only(fold == model).times(weights))
                yield pa.RecordBatch.from_arrays([
                    pa.array([model], pa.int64()), pa.array([weights], schema.field(1).type), pa.array([unseen], schema.field(2).type)], schema=schema)

    found = spark.range(0, folds + 1, 1, folds + 1).mapInArrow(
        fit, "model long, weights array<double>, unseen array<double>").toArrow().sort_by("model")
    own = np.zeros(len(fold))
    for k in range(folds):
        own[fold == k] = found.column("unseen")[k].values.to_numpy()
    return found.column("weights")[folds].values.to_numpy().copy(), own


def predict(docs: DataFrame, chain: Chain, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row of docs(text, ...), with p_<category> and <category> for each category."""
    counted = Terms(chain.chosen)
    kept = [docs.schema[k] for k in keep]
    fields = [f for c in chain.categories for f in ((f"p_{c}", pa.float64()), (c, pa.bool_()))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, values = zip(*[counted.of(t.as_py()) for t in batch.column(0)])
        found = chain.probabilities(list(numbers), list(values))
        columns = [x for k, cut in enumerate(chain.cuts) for x in (pa.array(found[:, k]), pa.array(found[:, k] >= cut))]
        own = batch.columns[1:]
        return pa.RecordBatch.from_arrays([*own, *columns], schema=pa.schema([*[(n.name, a.type) for n, a in zip(kept, own)], *fields]))

    def batches(parts):
        for batch in parts:
            for part in slices(batch, 2048, 4 << 20):
                yield run(part)

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"`p_{c}` double, `{c}` boolean" for c in chain.categories]])
    return docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{k}`") for k in keep]).mapInArrow(batches, ddl)


def categories_of(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as the categories of the chain: poor text, toxic text, and text that is both."""
    poor, toxic = (F.col("quality") == 0).cast("int"), (F.col("toxic") > 0).cast("int")
    return labels.select("doc_id", poor.alias("poor"), toxic.alias("toxic"), (poor * toxic).alias("poor_and_toxic"))


CATEGORIES = ("poor", "toxic", "poor_and_toxic")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_poor, poor, p_toxic, toxic, p_poor_and_toxic, poor_and_toxic) for every row of docs(doc_id, text).

    A null or empty text is judged by the intercepts alone, which is clean wherever most labels are. Null labels are unknown,
    labels of unknown documents are ignored; without any labels nothing is toxic. Repeated rows are judged each for itself,
    null ids and other columns change nothing. An empty table gives an empty result.
    """
    return predict(docs, train(docs, categories_of(labels), CATEGORIES))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, with docs' own columns."""
    chain = train(docs, categories_of(labels), CATEGORIES)
    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.withColumnsRenamed(names)
    judged = predict(renamed.withColumn("text", F.col(names["text"])), chain, keep=list(names.values()))
    return judged.filter(~F.col("toxic")).select(*[F.col(n).alias(c) for c, n in names.items()])
