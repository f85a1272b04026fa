"""Benchmark passages in documents, against comparing every window with every place."""

import hashlib
import re

import pytest

from tests.llm import odd
from tidemark.llm import leaks

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Items of no, few and many words, repeated ones, one id with two texts, no id, no text, and a window that two items share.
ITEMS = [
    (1, odd.SENTENCE), (2, odd.SENTENCE), (2, "seven small ships sail past the old harbour wall at dawn today and tomorrow"), (3, "One"),
    (4, "a a a"), (5, None), (6, ""), (7, "?!"), (None, "text of the"), (10, odd.LONG[:400]), (11, "Ünï-ÇÖDÉ  ß"), (12, "no such words"),
    (12, "no such words"), (20, "Fox jumps"), (9, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9")]


def cut(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_brute_force(rows, items, window):
    windows = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = cut(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i:i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        named = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, shingle", [(10, 3), (4, 3), (1, 1), (5, 5), (10, 1)])
def test_odd_rows_by_brute_force(spark, window, shingle):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' as words", "1 as token", "2 as size", "3 as window_id")
    found = leaks.contamination(odd.documents(spark), items, window, shingle).drop("spans").collect()
    assert sorted(map(tuple, found), key=str) == by_brute_force([(r[0], r[1]) for r in odd.ROWS], ITEMS, window)


def test_spans_are_where_the_windows_are(spark):
    docs = spark.createDataFrame([(1, "x a b c d y c d e z")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "A b c"), ("q", "b-c-d"), ("r", "d e")], "item_id string, text string")
    row = leaks.contamination(docs, items, window=3).first()
    assert [tuple(s) for s in row["spans"]] == [(1, 4), (2, 5), (7, 9)] and row["n_hit"] == 6 and row["n_items"] == 3


def test_a_full_bit_set_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BITS", 64)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = leaks.contamination(odd.documents(spark), items).drop("spans").collect()
    assert sorted(map(tuple, found), key=str) == by_brute_force([(r[0], r[1]) for r in odd.ROWS], ITEMS, 10)


def test_empty_tables(spark):
    docs, items = odd.documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks.contamination(docs.limit(0), items).count() == 0
    for none in (items.limit(0), items.filter("item_id = 12"), items.filter("item_id = 7")):
        found = leaks.contamination(docs, none).collect()
        assert len(found) == len(odd.ROWS) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in found)
        assert {r["items_sha256"] for r in found} == {hashlib.sha256(b"").hexdigest()}


def test_no_python_on_the_way(spark):
    plan = leaks.contamination(odd.documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("InArrow", "InPandas", "PythonUDF", "BatchEval", "ArrowEval", "CartesianProduct"))
