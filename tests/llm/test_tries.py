"""Prefix tries of conversations, against dictionaries of all prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_brute_force(sequences):
    """The nodes of {conv_id: sequence of (turn, number of words)}."""
    members, ends, kids = {}, {}, {}
    for conv, turns in sequences.items():
        turns = tuple(turns)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
            if d:
                kids.setdefault(turns[:d - 1], set()).add(turns[:d])
        ends.setdefault(turns, []).append(conv)

    def under(node):
        yield node
        for kid in kids.get(node, ()):
            yield from under(kid)
    out = []
    for node, convs in members.items():
        below = list(under(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids.get(node, ())),
            sum(1 for x in below if x not in kids), sum((len(members[x]) - 1) * x[-1][1] for x in below if x),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(out)


def rebuilt(rows):
    """{conv_id: [((role, text), words)]} of (conv_id, turn, role, text) rows whose turns are distinct."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [((r, t), len(t.split())) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def nodes(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


ROWS = [
    (0, 1, "user", "hello there"), (0, 0, None, "system  text"), (0, 2, "assistant", None), (1, 0, "user", "hi"), (1, 1, "user", "hi"),
    (2, 0, "user", "hi"), (2, 1, "user", "hi"), (3, None, "user", "first"), (3, -4, "user", ""), (3, 7, "user", "last one"),
    (20, 0, "user", "alone"), (21, 0, "u", "x"), (22, 0, "u", "x"), (45, 0, "u", "no base"), (45, 1, "u", "no base 2"), (-3, 0, "user", "minus"),
    (-20, 0, "user", "minus twenty"), (-25, 0, "user", "a"), (-25, 1, "b", "c d e"), (None, 0, "user", "no id"), (None, None, None, None),
    (50, None, None, None)] + [(c, t, "user", "the same start") for c in range(100, 140) for t in range(c % 3)] + [
    (200, t, "user", f"turn {t % 7}") for t in range(300)] + [(201, t, "user", f"turn {t % 7}") for t in range(290)]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr(
        "*", "'p' as path", "1 as words", "'t' as turns", "2 as unit", "'k' as key").repartition(5)


@pytest.mark.parametrize("limit", [1, 7, 200_000])
def test_odd_conversations_by_brute_force(spark, limit):
    found = nodes(tries.conversation_trie(table(spark, ROWS), shard_turns=limit))
    assert found == by_brute_force(rebuilt(ROWS))


def test_many_small_shards(spark):
    random.seed(5)
    rows = [(c, t, "u", "w " * random.randint(0, 2)) for c in range(-40, 200) for t in range(random.randint(1, 6))]
    found = nodes(tries.conversation_trie(table(spark, rows), shard_turns=5))
    assert found == by_brute_force(rebuilt(rows))


def test_repeated_turns_stay(spark):
    rows = [(40, 0, "u", "a b"), (40, 0, "u", "a b"), (40, 1, "u", "c")]
    found = nodes(tries.prefix_nodes(tries.paths(tries.sequences(table(spark, rows)))))
    assert [(r[1], r[4], r[5]) for r in found] == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 1)]


def test_empty_table(spark):
    assert nodes(tries.conversation_trie(table(spark, []))) == []
    assert nodes(tries.conversation_trie(table(spark, [(None, 1, "u", "x")]))) == []


def test_double_array_holds_exactly_its_paths():
    random.seed(3)
    turns = [hashlib.sha256(str(i).encode()).digest()[:tries.KEY] for i in range(40)]
    keys = sorted({b"".join(random.choice(turns) for _ in range(random.randint(0, 5))) for _ in range(3000)})
    trie = tries.DoubleArray(keys)
    every = {k[:n] for k in keys for n in range(0, len(k) + 1, tries.KEY)}
    slots = {}
    for depth, paths, at in trie.walk():
        for path, slot in zip(paths.tolist(), at.tolist()):
            slots.setdefault(keys[path][:depth * tries.KEY], set()).add(slot)
    assert set(slots) == every and all(len(s) == 1 for s in slots.values())
    assert len({s for x in slots.values() for s in x}) == len(every) == int((trie.depth >= 0).sum())
    assert len(trie.check) < 2 * len(every)
