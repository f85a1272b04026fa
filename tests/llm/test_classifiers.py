"""The toxicity chain, the secret scan and the pipeline on held-out and planted cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import odd
from tidemark.llm import packing, secrets, simhash, toxicity
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return odd.documents(spark, [])


def test_logistic_separates():
    rng = np.random.default_rng(0)
    numbers = [sorted(set(rng.integers(0, 50, 6).tolist())) for _ in range(600)]
    target = np.array([float(3 in n or 7 in n) for n in numbers])
    rows = toxicity.Rows.of(numbers, [[1.0] * len(n) for n in numbers], np.zeros((600, 0)), 50)
    weights = toxicity.logistic(rows, target)
    assert ((toxicity.sigmoid(rows.times(weights)) > 0.5) == (target > 0)).mean() > 0.99


def test_chain_on_held_out_labels(spark):
    texts, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.train(texts, toxicity.categories_of(labels.filter("doc_id % 4 <> 0")), toxicity.CATEGORIES)
    assert [len(w) for w in chain.weights] == [len(chain.chosen) + k + 1 for k in range(3)]  # each sees the ones before
    rows = toxicity.predict(texts, chain).join(labels.filter("doc_id % 4 = 0").selectExpr("doc_id", "toxic as y"), "doc_id").filter("y is not null").collect()
    bad = [r for r in rows if r.y == 1]
    assert sum(r.toxic for r in bad) >= 0.7 * len(bad)
    assert sum(r.toxic for r in rows if r.y == 0) <= 0.03 * len(rows)


def test_chain_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 0, 1), (999, 0, 1), (3, 1, 0), (7, 0, None), (9, None, 0), (14, 0, 1)],
        "doc_id long, quality int, toxic int")
    found = toxicity.classified(docs, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd.ROWS)
    assert all(0 <= r.p_toxic <= 1 and r.toxic is not None for r in found)
    assert not any(r.toxic for r in toxicity.classified(docs, labels.filter("false")).collect())
    assert toxicity.classified(none, labels).collect() == []
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes


SECRET_ROWS = [
    (1, 'some words before token = "4bf92f3577b34da6a3ce929d0e0e4736aa110902" and after', "app/settings.env"),
    (2, "plain 4716253849506172 number and commit 4bf92f3577b34da6a3ce929d0e0e4736aa110902 here", "src/a.py"),
    (2, "plain 4716253849506172 number and commit 4bf92f3577b34da6a3ce929d0e0e4736aa110902 here", "src/a.py"),
    (3, None, "x"), (4, "", None), (None, 'password=Zk3vT9xQwL2mNp8RbY7s "quoted"', None),
    (5, "x " * 50_000 + 'api_key = "9a8b7c6d5e4f30214657687980919293" ' + "y " * 50_000, "conf/app.yaml"),
    (6, 'token = "4bf92f3577b34da6a3ce929d0e0e4736aa110902" twice token = "4bf92f3577b34da6a3ce929d0e0e4736aa110902"', "test/fixture.txt"),
    (7, "äöü TOKEN = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"!! ende", "d"),
]


def test_secret_scan(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "source as path")
    own = spark.createDataFrame(SECRET_ROWS, "doc_id long, text string, path string")
    rows = base.unionByName(own).withColumn("start", F.lit(1)).withColumn("label", F.lit("x")).withColumn("candidate", F.lit(2))
    found = secrets.scan(rows).collect()
    texts = {(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect() if r.text}
    pattern = re.compile(secrets.CANDIDATE)
    wanted = Counter((d, m.start(), len(m[0])) for d, t in texts for m in pattern.finditer(t))
    assert Counter((r.doc_id, r.start, r.length) for r in found) == wanted
    verdict = {(r.doc_id, r.start): r.is_secret for r in found}
    real = [(d, m.start(1)) for d, t in texts for m in re.finditer(r'(?i)(?:token|api_key) = "([0-9a-f]{32,})"|(?:password=)(\w{16,})', t) for _ in [0] if m[1]]
    assert sum(verdict[k] for k in real) >= 0.95 * len(real)
    card = [(d, m.start()) for d, t in texts for m in re.finditer(r"(?<![\w+/=-])\d{16}(?![\w+/=-])", t)]
    assert sum(verdict[k] for k in card) <= 0.05 * len(card)
    assert not verdict[2, SECRET_ROWS[1][1].index("4bf9")]


def test_scan_edges(spark, docs, none):
    assert secrets.scan(none.drop("path").withColumnRenamed("source", "path")).collect() == []
    few = secrets.scan(docs.drop("path").withColumnRenamed("source", "path")).collect()
    assert all(r.probability is not None for r in few)


def test_masking_keeps_clashing_columns(docs):
    kept = secrets.masked(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == docs.count()
    assert kept.filter("other_0 <> '7' or _secrets <> 7 or _path <> 7").count() == 0


def test_masking_keeps_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    own = spark.createDataFrame(SECRET_ROWS, "doc_id long, text string, source string").selectExpr(
        "doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    rows = base.unionByName(own)
    kept = secrets.masked(rows)
    assert kept.dtypes == rows.dtypes
    before, after = rows.collect(), kept.collect()
    assert Counter((r.doc_id, r.source) for r in before) == Counter((r.doc_id, r.source) for r in after)
    texts = " ".join(r.text or "" for r in after)
    assert not re.search(r'(?i)token = "[0-9a-f]{40}"', texts) and secrets.MASK in texts
    assert all(r.n_chars == len(r.text) for r in after if r.text and secrets.MASK in r.text)
    same = Counter((r.doc_id, r.text) for r in before if r.text is None or not re.search(secrets.CANDIDATE, r.text))
    assert not same - Counter((r.doc_id, r.text) for r in after)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.dtypes
    inputs, outputs = [docs], []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, inputs[-1], SF).write.parquet(str(tmp_path / name))
        inputs.append(spark.read.parquet(str(tmp_path / name)))
        outputs.append(inputs[-1])
    assert [o.dtypes == columns for o in outputs] == [True] * 4 + [False]
    first, kept, hidden, mixed, packed = outputs
    assert first.count() >= 0.8 * docs.count() and first.join(docs, "doc_id", "left_anti").count() == 0
    rows = first.select("doc_id", "text").collect()
    groups = odd.components([simhash.fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(groups))
    assert hidden.count() == kept.count()
    known = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert max(known.values()) <= 3 and mixed.join(hidden, ["doc_id", "text"], "left_anti").count() == 0
    places = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert places[0] <= packing.LENGTH and places[2] <= -(-places[1] // packing.LENGTH) * 1.02 + 1
    pieces = packed.filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in pieces} == known


def test_registered():
    assert sorted(QUERIES) == sorted(set(QUERIES)) and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(name, spark, sf_dir):
    from tests.compare import compare, duck_connection
    assert compare(spark, duck_connection(sf_dir), QUERIES[name], ORACLES[name], sf_dir) is None
