"""SimHash groups, long repeats, winnowing and the language model against brute force."""

import hashlib
import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import odd
from tidemark.llm import maxent, repeats, simhash, winnow
from tidemark.llm.common import words_of


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return odd.documents(spark, [])


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_simhash_groups(docs, none):
    rows = [(r[0], r[1]) for r in odd.ROWS]
    fps = [odd.simhash(t) for _, t in rows]
    wanted = Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, odd.components(fps, [d for d, _ in rows])))
    assert counted(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()) == wanted
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_links_near_fingerprints(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    values = set(centres.tolist()) | set(rng.integers(0, 2 ** 63, 300, dtype=np.uint64).tolist())
    for c in centres[:20].tolist():  # one dense group among them
        for _ in range(30 if c == centres[0] else 3):
            flips = rng.choice(64, rng.integers(1, 5), replace=False).tolist()
            values.add(c ^ sum(1 << b for b in flips))
    values = sorted(values)
    wanted = {(max(a, b), min(a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3}
    signed = lambda x: x - 2 ** 64 if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {tuple(sorted((x.u % 2 ** 64, x.v % 2 ** 64), reverse=True)) for x in simhash.links(df).collect()}
    assert found == wanted


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_every_allocation_finds_all_links(m):
    rng = np.random.default_rng(m)
    values = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    near = values ^ np.array([sum(1 << b for b in rng.choice(64, 3, replace=False).tolist()) for _ in values], dtype=np.uint64)
    allocation = simhash.Allocation(np.concatenate((values, near)), 10_000 * m, m, 3)
    chosen, _ = allocation.thresholds(values)
    assert (chosen.sum(axis=1) == 3 - m + 1).all() and chosen.min() >= -1
    index = set(zip(*(x.tolist() for x in allocation.keys(near))))
    for part, value, fp in zip(*(x.tolist() for x in allocation.probes(values))):
        index.discard((part, value, int(near[values.tolist().index(fp)])))
    left = Counter(fp for _, _, fp in index)
    assert all(left[int(n)] < m for n in near)  # each is met in some partition


def test_keep_one_of_each_group(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    rows = [(r[0], r[1]) for r in odd.ROWS]
    groups = odd.components([odd.simhash(t) for _, t in rows], [d for d, _ in rows])
    assert set(i for i in ids if i is not None) == {g for g in groups if g is not None}
    # one row of each group; an id whose texts lie in two groups keeps a row in both
    place = odd.components([odd.simhash(t) for _, t in rows], list(range(len(rows))))
    at = {(d, t): g for (d, t), g in zip(rows, place)}
    assert sorted(at[r.doc_id, r.text] for r in kept.select("doc_id", "text").collect()) == sorted(set(place))
    assert kept.dtypes == docs.dtypes and simhash.keep_one(docs.limit(0)).collect() == []


def test_repeats_against_all_windows(spark, docs, none):
    rows = [(r[0], r[1]) for r in odd.ROWS]
    wanted = odd.removal([(d, t or "") for d, t in rows])
    found = repeats.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == Counter(
        (d, *wanted[d, t or ""]) for d, t in rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)
    assert repeats.without_repeats(none).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_texts_of_few_words(spark, seed):
    """Small alphabets make runs, overlaps within a text and shared symbols of different spans."""
    rng = np.random.default_rng(seed)
    pool = [list(rng.choice(list("abc")[:2 + seed % 2], 45)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [pool[k] for k in rng.integers(0, 6, 3)]
        text = [w for p in parts for w in p[rng.integers(0, 20):]]
        for at in rng.integers(0, len(text), rng.integers(0, 4)):
            text[at] = "z"
        rows.append((i, " ".join(text)))
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    wanted = odd.removal(rows)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found} == {(d, *wanted[d, t]) for d, t in rows}


def test_names_are_the_same_everywhere():
    """Equal windows are cut into equal symbols away from their edges."""
    rng = np.random.default_rng(2)
    window = rng.integers(0, 2 ** 63, 20, dtype=np.uint64)
    seen = set()
    for _ in range(30):
        left, right = (rng.integers(0, 2 ** 63, rng.integers(0, 30), dtype=np.uint64) for _ in range(2))
        text = np.concatenate((left, window, right))
        at, named, _ = repeats.picked(*repeats.parse(text, np.array([0, len(text)])), len(text), 20)
        seen.add((int(at[len(left)]) - len(left), int(named[at[len(left)]])))
    assert len(seen) == 1 and min(seen)[0] >= repeats.CONTEXT


def test_winnowing(spark, docs, none):
    rows = sorted({(r[0], r[1] or "") for r in odd.ROWS if r[0] not in (None, 13)})
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit(3))
    found = {r.doc_id: r for r in winnow.edited_likeness(df).collect()}
    assert len(found) == len(rows)
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        assert found[doc].n_chars == len(text)
        assert found[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[doc].near_edited <= 1 and 0 <= found[doc].near_next <= 1
        if edited == text:
            assert found[doc].near_edited == 1 and found[doc].fingerprint == found[doc].edited_fingerprint
    assert found[2].fingerprint == found[3].fingerprint and found[2].near_next == 1
    assert found[1].near_next > 0.5 > found[3].near_next
    assert len(winnow.edited_likeness(docs).collect()) == len(odd.ROWS)
    assert winnow.edited_likeness(none).collect() == []


def test_winnowing_cuts_an_id_that_fills_several_ranges(spark):
    rows = [(None, f"no id {i}") for i in range(120)] + [(5, f"five {i % 90}") for i in range(120)] + [(i, f"own {i}") for i in range(6, 60)]
    dealt, place = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string"), buckets=8)
    found = dealt.withColumn("next", F.lead("text").over(place)).filter("_ghost = 0").collect()
    order = sorted((r._id, r._hash, r.text) for r in found)
    assert [x[2] for x in order] and len(order) == len(rows)
    wanted = Counter((x[2], y[2]) for x, y in zip(order, order[1:] + order[:1]))
    assert Counter((r.text, r.next) for r in found) == wanted
    ranges = Counter(r._range for r in found if r.doc_id is None), Counter(r._range for r in found if r.doc_id == 5)
    assert all(len(n) >= 3 and max(n.values()) < 80 for n in ranges)


def test_winnowing_keeps_rightmost_minima(spark):
    text = " ".join(np.random.default_rng(1).choice(list("abcd"), 300))
    df = winnow.with_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "own", keep_positions=True)
    row = df.first()
    words, grams = text.split(), []
    hashes = spark.createDataFrame([(text,)], "text string").select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h"))
    two = hashes.select("h", F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1))).alias("g2"))
    four = two.select("h", F.transform("g2", lambda x, i: F.xxhash64(x, F.get("g2", i + 2))).alias("g4"))
    grams = [x % 2 ** 64 >> 33 for x in four.select(F.transform("g4", lambda x, i: F.xxhash64(x, F.get("h", i + 4))).alias("g")).first().g][:len(words) - 4]
    wanted = []
    for i in range(len(grams) - winnow.W + 1):
        part = grams[i:i + winnow.W]
        at = i + max(k for k, g in enumerate(part) if g == min(part))
        if (grams[at], at) not in wanted:
            wanted.append((grams[at], at))
    assert [(x.hash, x.position) for x in row.own_at] == wanted
    assert set(row.own) == {h for h, _ in wanted}


def test_language_model(docs, none):
    rows = [(r[0], r[1]) for r in odd.ROWS]
    counts = Counter()
    for doc, text in rows:
        if not odd.is_held_out(doc):
            counts.update(odd.words(text, lower=True) + [None])
    total, distinct = sum(counts.values()), len(counts)
    wanted = Counter()
    for doc, text in rows:
        tokens = odd.words(text, lower=True) + [None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        wanted[doc, odd.is_held_out(doc), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 4)] += 1
    found = maxent.scored(docs, steps=3).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == wanted
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert maxent.scored(none).collect() == []


def test_language_model_is_a_distribution_and_beats_the_base(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    learn = texts.filter(~maxent.held_out(F.col("doc_id"))).select("text")
    model = maxent.train(learn, steps=12)
    chances = maxent.log_softmax(model.weights, np.arange(0, maxent.ORDER ** 3, 97))
    assert np.allclose(np.exp(chances).sum(axis=1), 1, atol=1e-4)
    counts = model.counts.filter("kind >= 0").toPandas()
    counts = counts[~counts.token.isin(list(model.singles))]
    inside = (counts.c + 1).groupby(counts.kind).sum()
    room = model.room()
    assert all(abs((inside[k] + 1) / room[k] - 1) < 1e-9 for k in inside.index)  # known words and the place of unknown ones
    sums = maxent.score(texts, model).withColumn("held", maxent.held_out(F.col("doc_id"))).groupBy("held").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert len(sums) == 2 and all(r.s > r.b for r in sums)


def reference_scores(rows, learn, weights):
    """(n_known, score) of each text by word counts, pair counts and the class factor's weights."""
    texts = [odd.words(t, lower=True) for t in learn]
    counts, pairs, after, room = Counter(w for t in texts for w in t), Counter(), Counter(), Counter()
    token = {w: xxhash.xxh64_intdigest(w) for w in counts}
    frequent = sorted(counts, key=lambda w: (-counts[w], token[w] - (token[w] >> 63 << 64)))[:maxent.SINGLES]
    own = {w: 1 + i for i, w in enumerate(frequent)}

    def class_of(word):
        return 0 if word is None else own.get(word, 1 + maxent.SINGLES + maxent.kind_of(word))

    for w in counts:
        room[class_of(w)] += counts[w] + 1
    for t in texts:
        for first, w in zip([None, *t], t):
            pairs[first, w] += 1
            after[first, class_of(w)] += 1
    found = []
    for text in rows:
        t = [*odd.words(text, lower=True), None]
        classes = [maxent.START] * 3 + [class_of(w) for w in t]
        context = np.array([(c * maxent.ORDER + b) * maxent.ORDER + a for a, b, c in zip(classes, classes[1:], classes[2:])][:len(t)])
        chance = maxent.log_softmax(weights, context)[np.arange(len(t)), classes[3:]].astype(float).sum() / math.log(10)
        for first, w in zip([None, *t], t):
            k = class_of(w)
            if k > maxent.SINGLES:
                share = (counts[w] + 1) / (room[k] + 1)
                chance += math.log10((pairs[first, w] + maxent.PAIR_PRIOR * share) / (after[first, k] + maxent.PAIR_PRIOR))
        found.append((sum(counts[w] > 0 for w in t[:-1]) + (len(learn) > 0), chance))
    return found


@pytest.mark.parametrize("head", [maxent.HEAD, 60, 0])
def test_language_model_has_the_pairs_of_words(spark, docs, head, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", max(head, maxent.SINGLES))
    rng = np.random.default_rng(7)
    vocabulary = [f"{a}{b}" for a in "abcdefghijkl" for b in ("en", "ing", "on", "t", "s", "é", "", "the", "漢")]
    extra = [" ".join(rng.choice(vocabulary, size=rng.integers(0, 90))) for _ in range(300)]
    rows = [(r[0], r[1]) for r in odd.ROWS] + list(zip(range(100, 400), extra)) + [(500 + i, extra[5]) for i in range(9)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(odd.ROWS):], "doc_id long, text string").repartition(5))
    learn = every.filter(~maxent.held_out(F.col("doc_id"))).select("text")
    model = maxent.train(learn, steps=4)
    wanted = sorted(zip([r[0] or 0 for r in rows], *zip(*reference_scores(
        [t for _, t in rows], [t for d, t in rows if not odd.is_held_out(d)], model.weights))))
    for found in (maxent.score(every, model), maxent.scored(every, steps=4)):
        got = sorted((r.doc_id or 0, r.n_known, r.score) for r in found.collect())
        assert [x[:2] for x in got] == [x[:2] for x in wanted]
        assert np.allclose([x[2] for x in got], [x[2] for x in wanted], rtol=1e-6, atol=1e-5)


def test_language_model_tells_words_of_one_class_apart(spark):
    # more than the frequent tokens; the classes of the last words and of those before them are the same in both orders
    others = [f"w{i}" for i in range(60)]
    learn = spark.createDataFrame([(" ".join(others),)] * 50 + [("grey xcat sat",)] * 20 + [("drey ycat sat",)] * 20, "text string")
    model = maxent.train(learn, steps=3)
    rows = [(1, "grey xcat sat"), (2, "grey ycat sat"), (3, "drey ycat sat"), (4, "drey xcat sat")]
    found = {r.doc_id: r.score for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found[1] > found[2] + 0.05 and found[3] > found[4] + 0.05


def test_language_model_reads_words_from_slices():
    space = "".join(map(chr, range(1, 256))) + "\u2003\u0130"
    texts = ["Ab  cd", None, "", " \t\x0b", space.join("xYz"), "é É \U0001f600 end ", "one", " a" * 30] * 3
    array = pa.array(texts)
    for start, length in ((0, 24), (3, 20), (11, 1), (9, 2)):
        numbers, edges, tokens, kinds = maxent.read(array.slice(start, length))
        for k, text in enumerate(texts[start:start + length]):
            words, found = words_of(text, lower=True), numbers[edges[k]:edges[k + 1]]
            assert tokens[found].view(np.uint64).tolist() == [xxhash.xxh64_intdigest(w) for w in [*words, b"\n"]]
            assert kinds[found].tolist() == [maxent.kind_of(w) for w in words] + [-1]


def bucket_of_records(size, batches):
    """A model and a bucket of the pairs of some batches, as scoring sends them."""
    rng = np.random.default_rng(11)
    model = SimpleNamespace(
        total=10_000_000, distinct=300_000, head=(np.arange(1000), rng.integers(1, 9000, 1000)), room=lambda: np.full(maxent.SUFFIXES, 4e5))
    sort = rng.integers(0, 3, size)
    doc = rng.integers(0, 40, size)
    drawn = {"key": rng.zipf(1.2, size) % 50_000, "sub": np.where(sort == maxent.FREQUENT, rng.integers(0, 1000, size), sort == maxent.RARE),
             "code": rng.integers(0, 4, size) + 32 * sort, "doc": doc | np.where(doc % 7 == 2, maxent.SCORE, maxent.LEARN | maxent.SCORE) << 12,
             "n": rng.integers(1, 4, size)}
    batch = np.arange(size) * batches // size
    order = np.lexsort((doc, batch))
    _, sizes, columns = maxent.packed(batch, [drawn[c][order].astype(t) for c, t in maxent._RECORD.items()])
    sent = [pa.array(np.zeros(batches, dtype=np.int32)), pa.array(np.arange(batches)), pa.array(sizes), pa.nulls(batches, pa.binary()), *columns]
    home = [pa.array([0], pa.int32()), pa.array([0]), pa.array([-size]), pa.array([b"home"]), *[pa.nulls(1, pa.binary())] * len(columns)]
    return model, pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=maxent._SENT) for x in (sent, home)])


def test_language_model_counts_a_bucket_in_parts(monkeypatch):
    model, bucket = bucket_of_records(30_000, 25)
    monkeypatch.setattr(maxent, "PART", 1_000_000)
    whole = maxent._adds(model)(bucket)
    monkeypatch.setattr(maxent, "PART", 700)
    parts = maxent._adds(model)(bucket)
    assert whole.num_rows == 26 and whole.select(["batch", "records", "home", "doc", "known"]).equals(parts.select(["batch", "records", "home", "doc", "known"]))
    for c in ("base", "score"):
        assert np.allclose(maxent.flat(whole.column(c), np.float64)[0], maxent.flat(parts.column(c), np.float64)[0], rtol=1e-9)


def test_language_model_needs_little_memory_for_a_bucket():
    size = 2_000_000
    model, bucket = bucket_of_records(size, 200)
    tracemalloc.start()
    try:
        maxent._adds(model)(bucket)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * size
