"""Prefix trie of conversations as double arrays, one per shard of neighbouring paths.

A conversation is a path: the fixed-size keys of its turns, one after the other, so that paths in byte order have equal
prefixes side by side. Paths are dealt into ranges of that order and cut into shards of bounded size. Each shard numbers
its turns densely, packs its trie into BASE and CHECK arrays (the child of slot s over turn id c is slot BASE[s] + c, if
CHECK there names s) and walks them for its nodes. Only the nodes on a shard's first and last path can also lie in another
shard; these upper nodes are merged over all shards by their prefix, everything else is final in its shard.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import SPACE, materialised, shuffle_width, slices

KEY = 16
#: Turns of the paths that meet in one double array; a single longer path has one of its own.
SHARD_TURNS = 200_000
#: Ids of equal paths that travel as one row: those that agree in all but the last ten bits.
ID_BITS = 10
#: Leading turns that ranges of paths are cut by.
RANGE_TURNS = 64
#: Places that are tried for the children of one node before they go behind all others.
TRIES = 32
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_PATHS = pa.schema([
    ("path", pa.binary()), ("words", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string())])
_NODES = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("words", pa.int64()),
    # of nodes below an upper node: where that one is; of upper nodes: where they are, and their and their parent's prefix
    ("parent_unit", pa.int64()), ("unit", pa.int64()), ("prefix", pa.binary()), ("parent_prefix", pa.binary())])
_NODES_DDL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "words long, parent_unit long, unit long, prefix binary, parent_prefix binary")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) for turns(conv_id, turn, role, text): each conversation's (key, words) in turn order.

    A null role or text is empty, a null turn comes first, turns of one number are ordered by their keys and all kept.
    Rows without a conv_id take no part. A key is 128 bits of SHA-256; a conversation meets in one row of about 50 bytes a
    turn, without its texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    words = F.regexp_count(text, F.lit(f"[^{SPACE}]+"))
    turn = F.col("turn").cast("long")
    one = F.struct(
        turn.isNotNull().alias("has"), F.coalesce(turn, F.lit(0)).alias("turn"), key.alias("key"), words.cast("int").alias("words"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all")).select(
        "conv_id", F.transform("all", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) for conversations(conv_id, turns): the keys as one binary, and the turns' numbers of words."""
    return conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"))


def with_shared_heads(conversations: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """conversations(conv_id, turns) whose first h turns are those of the conversation at the multiple of ``group`` before them.

    h is the CRC-32 of the decimal conv_id modulo ``most + 1``. A conversation there with fewer turns gives all of them, a
    missing one none; own turns after the first h follow.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = conversations.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return conversations.withColumn("base", base).join(heads, "base", "left").select(
        "conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own)).alias("turns"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal paths follow each other with rising ids: one row per path, whose digest takes the ids as they come."""
    now = None  # path id, path, words, first id, number, digest so far
    for batch in batches:
        for part in slices(batch, 2048, 4 << 20):
            done = []
            for path_id, ids, path, words in zip(*(part.column(c).to_pylist() for c in ("path_id", "ids", "path", "words"))):
                text = ",".join(map(str, ids)).encode()
                if now is not None and now[0] == path_id:
                    now[4] += len(ids)
                    now[5].update(b"," + text)
                    continue
                if now is not None:
                    done.append(now)
                now = [path_id, path, words, ids[0], len(ids), hashlib.sha256(text)]
            yield _path_rows(done)
    if now is not None:
        yield _path_rows([now])


def _path_rows(found: list) -> pa.RecordBatch:
    columns = [[f[1] for f in found], [f[2] for f in found], [f[3] for f in found], [f[4] for f in found], [f[5].hexdigest() for f in found]]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PATHS)], schema=_PATHS)


def distinct_paths(rows: DataFrame) -> DataFrame:
    """(path, words, conv_id, n_convs, ends_sha256) for each distinct path of rows(conv_id, path, words).

    Ids of equal paths are gathered by ranges of ids first, so that however many copies a path has, a row holds a bounded
    number of them; the digest over all of them takes these rows one after the other.
    """
    some = rows.select(
        "conv_id", "path", "words", F.unhex(F.substring(F.sha2("path", 256), 1, 32)).alias("path_id"),
        F.shiftright("conv_id", ID_BITS).alias("chunk"))
    chunks = some.groupBy("path_id", "chunk").agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("path").alias("path"), F.first("words").alias("words"))
    return chunks.repartition("path_id").sortWithinPartitions("path_id", "chunk").mapInArrow(
        _digests, "path binary, words array<int>, conv_id long, n_convs long, ends_sha256 string")


class DoubleArray:
    """The trie of some sorted, distinct paths as BASE and CHECK over dense turn ids."""

    def __init__(self, keys: list[bytes]):
        self.lengths = np.array([len(k) // KEY for k in keys], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.deepest = int(self.lengths.max(initial=0))
        self._number(keys)
        self._pack()

    def at(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(the paths that have a turn below this depth, those turns' ids)."""
        alive = np.flatnonzero(self.lengths > depth)
        return alive, self.codes[self.starts[alive] + depth]

    def _number(self, keys: list[bytes]) -> None:
        """Dense turn ids by first appearance in level order, which puts the turns of siblings near each other."""
        flat = np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, 2)
        names = np.empty(len(flat), dtype=[("a", "<u8"), ("b", "<u8")])
        names["a"], names["b"] = flat[:, 0], flat[:, 1]
        known, codes = np.unique(names, return_inverse=True)
        depth = np.arange(len(flat)) - np.repeat(self.starts[:-1], self.lengths)
        order = np.argsort(depth, kind="stable")
        _, first = np.unique(codes[order], return_index=True)
        rank = np.empty(len(known), dtype=np.int64)
        rank[np.argsort(first, kind="stable")] = np.arange(len(known))
        self.codes = rank[codes] if len(known) else codes.astype(np.int64)

    def _pack(self) -> None:
        # nodes level by level: a path opens a node where it differs from the path before it
        parents, codes, depths = [np.array([-1])], [np.array([0])], [np.array([0])]
        node, count = np.zeros(len(self.lengths), dtype=np.int64), 1
        for depth in range(self.deepest):
            alive, code = self.at(depth)
            above = node[alive]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (above[1:] != above[:-1]) | (code[1:] != code[:-1])
            node[alive] = count + np.cumsum(new) - 1
            parents.append(above[new])
            codes.append(code[new])
            depths.append(np.full(int(new.sum()), depth + 1))
            count += int(new.sum())
        parent, code, depth = np.concatenate(parents), np.concatenate(codes), np.concatenate(depths)
        order = np.lexsort((code[1:], parent[1:])) + 1
        heads, begins, sizes = np.unique(parent[order], return_index=True, return_counts=True)
        used = np.zeros(2 * count + int(code.max(initial=0)) + 2, dtype=bool)
        used[0] = True
        bases, free, top = np.full(count, np.iinfo(np.int64).max // 2), 1, 1
        for k in np.argsort(-sizes, kind="stable").tolist():
            own = code[order[begins[k]:begins[k] + sizes[k]]]
            span = int(own[-1] - own[0])
            while used[free]:
                free += 1
            if free + span + 2 >= len(used):
                used = np.concatenate([used, np.zeros(len(used) + span + 2, dtype=bool)])
            slot = free
            for _ in range(TRIES):
                if not used[slot + own - own[0]].any():
                    break
                slot += 1 + int(np.argmin(used[slot + 1:]))
                if slot + span >= len(used):
                    slot = top
                    break
            else:
                slot = top
            if slot + span + 2 >= len(used):
                used = np.concatenate([used, np.zeros(len(used) + span + 2, dtype=bool)])
            used[slot + own - own[0]] = True
            top = max(top, slot + span + 1)
            bases[heads[k]] = slot - int(own[0])
        slots = np.zeros(count, dtype=np.int64)
        slots[1:] = bases[parent[1:]] + code[1:]
        self.base = np.full(top, np.iinfo(np.int64).max // 2)
        self.check = np.full(top, -1)
        self.depth = np.full(top, -1)
        self.base[slots], self.depth[slots] = bases, depth
        self.check[slots[1:]] = slots[parent[1:]]

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, paths, the slots they are in) level by level; a step that CHECK does not confirm is an error."""
        slot = np.zeros(len(self.lengths), dtype=np.int64)
        yield 0, np.arange(len(slot)), slot.copy()
        for depth in range(self.deepest):
            alive, code = self.at(depth)
            to = self.base[slot[alive]] + code
            if (to >= len(self.check)).any() or (self.check[to] != slot[alive]).any():
                raise ValueError("a path leaves its trie")
            slot[alive] = to
            yield depth + 1, alive, to


def shard_nodes(rows: list[tuple], unit: int) -> pa.Table:
    """The nodes of one shard of sorted rows (path, words, conv_id, n_convs, ends): final ones, and parts of upper ones.

    Upper nodes lie on the first path (``unit``) or the last (``unit + 1``). What they hold is the sums over their members
    here and over the children that are not upper nodes themselves.
    """
    keys = [r[0] for r in rows]
    trie = DoubleArray(keys)
    n = len(trie.check)
    flat_words = np.array([w for r in rows for w in r[1]], dtype=np.int64)
    members, copies = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    convs, least, words, ends = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.full(n, -1)
    edge = {0: np.zeros(trie.deepest + 1, np.int64), len(rows) - 1: np.zeros(trie.deepest + 1, np.int64)}
    for depth, alive, slot in trie.walk():
        np.add.at(convs, slot, copies[alive])
        np.minimum.at(least, slot, members[alive])
        if depth:
            words[slot] = flat_words[trie.starts[alive] + depth - 1]
        stops = trie.lengths[alive] == depth
        ends[slot[stops]] = alive[stops]
        for path in edge:
            found = np.flatnonzero(alive == path)
            if len(found):
                edge[path][depth] = slot[found[0]]
    upper = {}  # slot: unit in which its part counts
    for k, path in enumerate(sorted(edge)):
        for depth in range(int(trie.lengths[path]) + 1):
            upper.setdefault(int(edge[path][depth]), unit + k)
    is_upper = np.zeros(n, bool)
    is_upper[list(upper)] = True
    live = np.flatnonzero(trie.depth >= 0)
    order = live[np.argsort(-trie.depth[live], kind="stable")]
    below = order[(trie.depth[order] > 0) & ~is_upper[order]]
    children = np.zeros(n, np.int64)
    np.add.at(children, trie.check[below], 1)
    leaves = ((children == 0) & ~is_upper).astype(np.int64)
    saved = np.where(is_upper, 0, (convs - 1) * words)
    for level in np.split(below, np.flatnonzero(np.diff(trie.depth[below])) + 1) if len(below) else []:
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])

    def digest(slots: np.ndarray) -> list[str]:
        return [rows[e][4] if e >= 0 else _NO_ENDS for e in ends[slots].tolist()]

    parent = trie.check[below]
    inner = ~is_upper[parent]
    nothing = [None] * len(below)
    final = [
        pa.array(least[below]), pa.array(trie.depth[below]), pa.array(least[parent], mask=~inner), pa.array(convs[below]),
        pa.array(children[below]), pa.array(leaves[below]), pa.array(saved[below]), pa.array(digest(below)), pa.array(words[below]),
        pa.array([None if i else upper[p] for i, p in zip(inner.tolist(), parent.tolist())], pa.int64()), pa.array(nothing, pa.int64()),
        pa.array(nothing, pa.binary()), pa.array(nothing, pa.binary())]
    places, slots, prefixes, above = [], [], [], []
    for k, path in enumerate(sorted(edge)):
        hashed, before = hashlib.sha256(), None
        for depth in range(int(trie.lengths[path]) + 1):
            hashed.update(keys[path][(depth - 1) * KEY:depth * KEY] if depth else b"")
            name = hashed.copy().digest()[:KEY]
            places.append(unit + k)
            slots.append(int(edge[path][depth]))
            prefixes.append(name)
            above.append(before)
            before = name
    slots = np.array(slots, np.int64)
    counts = np.array([upper[s] == u for s, u in zip(slots.tolist(), places)], dtype=np.int64)
    shared = [
        pa.array(least[slots]), pa.array(trie.depth[slots]), pa.array([None] * len(slots), pa.int64()), pa.array(convs[slots] * counts),
        pa.array(children[slots] * counts), pa.array(leaves[slots] * counts), pa.array(saved[slots] * counts),
        pa.array([d if e >= 0 else None for d, e in zip(digest(slots), ends[slots].tolist())], pa.string()), pa.array(words[slots]),
        pa.array([None] * len(slots), pa.int64()), pa.array(places, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(above, pa.binary())]
    return pa.concat_tables([pa.Table.from_arrays(c, schema=_NODES) for c in (final, shared)])


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        held, turns = [], 0
        for batch in batches:
            for part in slices(batch, 2048, 4 << 20):
                for row in zip(*(part.column(c).to_pylist() for c in _PATHS.names)):
                    if held and turns + len(row[1]) > limit:
                        yield from shard_nodes(held, unit).to_batches(max_chunksize=10_000)
                        unit, held, turns = unit + 2, [], 0
                    held.append(row)
                    turns += len(row[1])
        if held:
            yield from shard_nodes(held, unit).to_batches(max_chunksize=10_000)
    return run


def _merged(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upper nodes over all shards, the smallest member of the upper node at each unit and depth).

    A unit is one shard's first or last path. In path order a node's units are neighbours, from u1 to u2, and the upper nodes
    below it are those first seen in u1 further down and all those first seen in the units after it up to u2: sums over
    subtrees are differences of running sums, without links from nodes to all that is above them.
    """
    whole = parts.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("ends_sha256").alias("ends_sha256"), F.max("words").alias("words"), F.max("parent_prefix").alias("parent_prefix"),
        F.min("unit").alias("u1"), F.max("unit").alias("u2"))
    shared = whole.filter("parent_prefix is not null").groupBy("parent_prefix").agg(F.count("*").alias("shared")).select(
        F.col("parent_prefix").alias("prefix"), "shared")
    children = F.col("inner") + F.coalesce("shared", F.lit(0))
    nodes = materialised(whole.join(shared, "prefix", "left").withColumn("n_children", children).withColumn(
        "leaves", F.col("leaves") + (children == 0).cast("long")).withColumn(
        "saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).drop("inner", "shared"), "upper")
    seen = parts.select("prefix", "unit", "depth").join(nodes.select("prefix", "conv_id", "u1", "leaves", "saved"), "prefix")

    def first_seen(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("unit") == F.col("u1"), F.col(name))), F.lit(0)).alias(name)

    totals = seen.groupBy("unit").agg(first_seen("leaves"), first_seen("saved")).withColumn("task", F.shiftright("unit", 32))
    tasks = totals.groupBy("task").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    tasks = tasks.select("task", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("l", "s")])
    running = Window.partitionBy("task").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    totals = materialised(totals.withColumn("leaves", F.sum("leaves").over(running)).withColumn("saved", F.sum("saved").over(running)).join(
        tasks, "task").select("unit", (F.col("leaves") + F.col("l")).alias("l"), (F.col("saved") + F.col("s")).alias("s")), "units")
    down = Window.partitionBy("u1").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    low, high = (totals.select(F.col("unit").alias(u), F.col("l").alias(f"l_{u}"), F.col("s").alias(f"s_{u}")) for u in ("u1", "u2"))
    above = nodes.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id"))
    result = nodes.withColumn("n_leaves", F.sum("leaves").over(down)).withColumn("saved_tokens", F.sum("saved").over(down)).join(
        low, "u1").join(high, "u2").join(above, "parent_prefix", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("l_u2") - F.col("l_u1")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("s_u2") - F.col("s_u1")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
    return result, seen.select(F.col("unit").alias("parent_unit"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("above"))


def prefix_nodes(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the paths of rows(conv_id, path, words), the empty one included; other columns are ignored.

    conv_id is the prefix's smallest member and names the node together with depth; parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes in its subtree), saved_tokens (words of last turns that members after the
    first repeat, over the subtree) and ends_sha256 (the ids of members that end there) follow. conv_ids are distinct and not
    null. Equal paths meet as one row with their number. An empty table gives an empty result.
    """
    distinct = materialised(distinct_paths(rows), "paths")
    sharded = distinct.repartitionByRange(shuffle_width(rows.sparkSession), F.substring("path", 1, KEY * RANGE_TURNS)).sortWithinPartitions("path")
    found = materialised(sharded.select(*_PATHS.names).mapInArrow(_shards(shard_turns), _NODES_DDL), "nodes")
    upper, places = _merged(found.filter("unit is not null"))
    final = found.filter("unit is null")
    hanging = final.filter("parent_unit is not null").withColumn("parent_depth", F.col("depth") - 1).join(
        places, ["parent_unit", "parent_depth"]).withColumn("parent_conv_id", F.col("above"))
    return final.filter("parent_unit is null").select(*COLUMNS).unionByName(hanging.select(*COLUMNS)).unionByName(upper.select(*COLUMNS))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The prefix nodes of conversations(conv_id, turn, role, text) after ``with_shared_heads``.

    Null roles and texts are empty, null turns come first, turns of one number are ordered by a hash of role and text and
    repeated rows all stay. Rows without a conv_id take no part; other columns are ignored. A conversation that is left without turns is a
    member of the root. An empty table gives an empty result.
    """
    return prefix_nodes(paths(with_shared_heads(materialised(sequences(conversations), "turns"))), shard_turns)
