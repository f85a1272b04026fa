"""The whole pipeline on odd rows and on an empty table."""

import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm import odd
from tidemark.sources.storage import shared_folder


def run(spark, docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        yield name, before, docs


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd.ROWS, odd.SCHEMA).repartition(3)
    sizes = {}
    for name, before, after in run(spark, docs, tmp_path):
        sizes[name] = after.count()
        if name == "near_dedup":
            rows = before.select("doc_id", "text").collect()
            groups = odd.components([odd.simhash(r.text) for r in rows], list(range(len(rows))))
            assert after.count() == len(set(groups))
            assert not Counter(map(tuple, after.select("doc_id", "text").collect())) - Counter(map(tuple, rows))
        if name != "packing":
            assert after.dtypes == docs.dtypes
    assert sizes["secret_scan"] == sizes["near_dedup"] > 0 and sizes["packing"] > 0


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], odd.SCHEMA)
    assert [after.count() for _, _, after in run(spark, docs, tmp_path)] == [0] * 5


def test_run_leaves_only_what_it_returns(spark, sf_dir):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "tidemark"
    folder.mkdir(parents=True, exist_ok=True)
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "source_mix" in left and not left & {"toxicity", "near_dedup", "secret_scan", "fingerprints", "stars", "candidates", "words"}


@pytest.mark.parametrize("name", ["secret_scan", "source_mix"])
def test_plans_stay_small_on_the_driver(spark, sf_dir, name):
    # the driver tells its listeners the whole plan again whenever a shuffle of it has ended
    stage = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    plan = stage._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 4 and "threshold" not in plan  # nor the forest
