"""WARC transactions, packing, mixing and top-k search against brute force."""

import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from tidemark.llm import mixing, packing, topk, warc
from tidemark.llm.queries import tokenizer_files

BIG = "<p>" + "x" * 1200 + "</p>"
TRICKY = "before WARC/1.0\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\n" + "é" * 700 + "\r\n\r\nWARC/1.0\r\n\r\n\n"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (3, "http://b/\r\nx y", "small"), (4, None, "small"),
    (5, "http://c", None), (6, "http://d", ""), (7, "http://e", TRICKY), (8, "http://e", TRICKY), (10, "http://f", "\r\n\r\n"),
    (None, "http://n", BIG), (11, "http://g", "y" * 999), (12, "http://g", "y" * 999), (13, "u", "z" * 1000), (13, "u", "z" * 1000),
    (14, "long", "é\n" * 300_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return odd.documents(spark, [])


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit(1)).withColumn(
        "digest", F.lit("x")).withColumn("payload", F.lit(0)).repartition(2)


def test_warc_round_trip(spark):
    best = {}
    for page, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            best[data] = max(best.get(data, page), page)
    wanted = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = best.get(data)
        revisit = first is not None and page != first
        wanted[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    found = warc.round_trip(pages(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, found)) == wanted
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_warc_files_and_transactions(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    at, types = 0, Counter()
    while at < len(data):  # by the format's own rule: header, Content-Length bytes, two line ends
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        assert lines[0] == b"WARC/1.0"
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        types[fields[b"WARC-Type"]] += 1
        at = end + 4 + int(fields[b"Content-Length"])
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert types[b"request"] == types[b"metadata"] == len(PAGES) == types[b"response"] + types[b"revisit"]
    rows = warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert len(rows) == len(PAGES)
    html = defaultdict(set)
    for page, _, text in PAGES:
        html[page].add((text or "").encode())
    for r in rows:
        assert r.request.record_id != r.response.record_id != r.metadata.record_id
        if r.response.type == "response":
            assert bytes(r.response.payload) in html[r.metadata.page_id]
            assert r.response.declared_digest == f"sha1:{r.response.payload_digest}"


def test_warc_reading_refuses_cut_files(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="cut off"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_packing(docs, none):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_files()[0])
    wanted = Counter()
    for doc, text, *_ in odd.ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start:first if k == 0 else start + 1024]
            wanted[doc, k, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    found = packing.pack(docs, *tokenizer_files()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none, *tokenizer_files()).collect() == []


def test_encoder_on_all_texts(spark, sf_dir):
    own, whole = packing.encoder(*tokenizer_files()), None
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_files()[0])
    texts = [r.text or "" for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html")) for r in spark.read.parquet(
        f"{sf_dir}/{t}.parquet").select(F.col(c).alias("text")).collect()]
    texts += ["a  b", " a", "a ", "a \n b", "a\n b", "it's 5 o'clock", " x  y", "x  y", "a\x1c b \x1cc", "<|endoftext|>", "a <|endoftext|> b",
              "漢字 かな 한글 z", "x" * 5000 + " y", "  ", "\n", "é ́e", "a\t b \tc", "don't  'll 've"]
    for text in texts:
        assert own.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text[:80]


def test_best_two_fit_replaces_the_smallest():
    # greedy: 5 + 2 leaves 1 empty; 3 + ... no: two documents of 1 and 2 fill the gap of the 2 exactly
    lengths = [5, 2, 2, 1]
    assert sorted(sorted(lengths[i] for i in b) for b in packing.best_two_fit(lengths, 8)) in ([[1, 2, 5], [2]], [[2], [1, 2, 5]])
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 400, 3000).tolist()
    bins = packing.best_two_fit(lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sum(lengths[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 1024) + 1


def brute_targets(sizes, most=3):
    """Targets in small steps of filling: every open source rises by its weight until all words are given."""
    weights = [(1, 2, 3)[i % 3] for i in range(len(sizes))]
    level, out = 0.0, [0.0] * len(sizes)
    total = float(sum(sizes))
    for level in sorted(most * s / w for s, w in zip(sizes, weights)) + [float("inf")]:
        filled = sum(min(most * s, w * level) for s, w in zip(sizes, weights))
        if filled >= total - 1e-9:
            low, high = 0.0, min(level, total)
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(min(most * s, w * mid) for s, w in zip(sizes, weights)) < total else (low, mid)
            return [min(most * s, w * high) for s, w in zip(sizes, weights)]
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 500, 3], [0, 7, 0, 9], [1000, 1, 1, 1, 1], [5], [0, 0]])
def test_targets(sizes):
    assert np.allclose(mixing.targets(sizes), brute_targets(sizes), rtol=1e-6)
    assert abs(sum(mixing.targets(sizes)) - sum(sizes)) < 1e-6


def check_mix(rows, taken):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(odd.words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, brute_targets([sizes[s] for s in order])))
    assert Counter((r.doc_id, r.source, r.size, r.source_size, round(r.target, 3)) for r in taken) == Counter(
        (d, s, len(odd.words(t)), sizes[s], round(goals[s], 3)) for d, t, _, s, _ in rows)
    drawn = defaultdict(int)
    for r in taken:
        assert 0 <= r.taken <= 3 * r.size
        drawn[r.source] += r.taken
    assert all(abs(drawn[s] - goals[s]) <= 1 for s in order)


def test_mixing(docs, none):
    mix = mixing.Mix(docs)
    check_mix(odd.ROWS, mix.taken().collect())
    again = mixing.Mix(docs.repartition(7)).taken().select("doc_id", "source", "taken")
    assert Counter(again.collect()) == Counter(mix.taken().select("doc_id", "source", "taken").collect())
    assert mixing.Mix(none).taken().collect() == []
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert max(Counter((r.doc_id, r.text, r.source) for r in copies.collect()).values()) <= 6  # a repeated row counts twice


def test_schedule_is_even(spark):
    goals = [100_000.0, 200_000.0, 300_000.0]
    rows = mixing.slots(spark, [-(-int(g) // 64) for g in goals], goals, 64).collect()
    by_slot = sorted((r.slot, r.source_no) for r in rows)
    for share in (0.1, 0.37, 0.8):
        first = [s for _, s in by_slot[:int(len(by_slot) * share)]]
        for k in range(3):
            assert abs(first.count(k) - len(first) * (k + 1) / 6) < 8
    ranks = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.slot):
        ranks[r.source_no].append(r.rank)
    assert all(x == list(range(len(x))) for x in ranks.values())


def test_schedule_covers_each_word_once_per_epoch(docs):
    mix = mixing.Mix(docs)
    spans = mix.spans().collect()
    assert len({(s.slot, s.source_no) for s in spans}) == len({s.slot for s in spans})
    used = defaultdict(int)
    for s in spans:
        used[s.slot] += s.n_words
    assert max(used.values()) <= mix.block


VECTORS = [
    *[(i, [float(np.sin(i * k + k)) for k in range(1, 9)]) for i in range(0, 220)], (250, [0.0] * 8), (300, None), (350, [1.0, None] + [0.5] * 6),
    (400, [float("nan")] + [0.1] * 7), (450, [float("inf")] + [0.1] * 7), (None, [9.0] * 8), (500, [0.9] * 8), (501, [0.9] * 8), (501, [0.9] * 8),
    (502, [0.9] * 8), (550, [-0.003] * 8), (503, [1e6] * 8),
]


def test_top_k(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("norm", F.lit("x")).repartition(4)
    for rows in (df, df.withColumn("embedding", F.col("embedding").cast("array<float>"))):
        valid = {(r.vec_id, tuple(int(np.floor(256 * float(x))) for x in r.embedding)) for r in rows.collect()
                 if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)}
        wanted = set()
        for q, v in valid:
            if q % 50 == 0:
                scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in valid if c != q)[:5]
                wanted |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)}
        assert {tuple(r) for r in topk.top_k(rows).collect()} == wanted
        prepared = topk.quantised(rows)
        small = topk.search(prepared.filter("vec_id % 50 = 0"), prepared, buckets=5, chunk=16, block=3, seeds=9).collect()
        assert {tuple(r) for r in small} == wanted
    assert topk.top_k(df.filter("false")).collect() == []
    assert len(topk.top_k(df.filter("vec_id in (0, 1, 50)")).collect()) == 4


def test_pruning_keeps_all_that_may_reach_the_bound():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 6)) * rng.uniform(0.1, 30, size=(400, 1))
    rows = np.floor(rows)[np.argsort(-np.sqrt((np.floor(rows) ** 2).sum(axis=1)))].astype(np.int64)
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    unit = rows / np.where(norms > 0, norms, 1)[:, None]
    for q in rng.integers(-20, 20, size=(60, 6)):
        scores = rows @ q
        for least in (np.sort(scores)[-5], np.sort(scores)[-50], 0.0, -10.0):
            kept = topk.survivors(q, float(np.sqrt((q ** 2).sum())), float(least), rows, norms, unit)
            assert set(np.flatnonzero(scores >= least)) <= set(kept.tolist())
