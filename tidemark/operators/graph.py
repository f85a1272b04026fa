"""Load order of tables that reference each other, and the cycles among them."""

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.keyed import frequent_keys, lookup_join, union_all
from tidemark.sources.storage import stored


def _kept(df: DataFrame) -> DataFrame:
    """df by way of a written table: lineage ends there, and its size is known to the plans that read it."""
    return stored(df, "graph")[0]


def dependency_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Level per node so that every parent has a smaller level than its children.

    ``edges`` has child and parent. Members of a cycle and nodes behind one never become free; both get a null level.
    ``cyclic`` is true for the former only, ``blocked`` for the latter. Repeated edges, self-edges and, when ``nodes`` is given,
    edges that leave the node set are ignored.

    Each round frees the nodes without open parents and lowers their children's parent counts. The state is one counter
    per node, written every round, so lineage stays short and a lost executor costs one round at most. Links whose parent
    is free are dropped as soon as they are half of those that are read.
    """
    links = edges.select("child", "parent").filter("child <> parent").distinct()
    if nodes is None:
        names = links.select(F.explode(F.array("child", "parent")).alias("node")).union(
            edges.select(F.explode(F.array("child", "parent")).alias("node"))).distinct()
    else:
        names = nodes.select("node").distinct()
        for end in ("child", "parent"):
            links = lookup_join(links, names.withColumnRenamed("node", end), [end], "inner")
    links = _kept(links)
    # the parents with very many children stay the same in every round
    frequent = frequent_keys(links, ["parent"])
    waiting = _kept(
        names.select("node", F.lit(0).cast("bigint").alias("open"))
        .union(links.select(F.col("child").alias("node"), F.lit(1).cast("bigint").alias("open")))
        .groupBy("node").agg(F.sum("open").alias("open")))
    done, level, held = [], 0, None
    while True:
        # every open parent of a waiting node is a link that is still needed
        free_nodes, needed = waiting.agg(F.count_if(F.col("open") == 0), F.coalesce(F.sum("open"), F.lit(0))).first()
        if not free_nodes:
            break
        held = needed if held is None else held
        if 2 * needed < held:
            left = waiting.select(F.col("node").alias("parent"))
            links, held = _kept(lookup_join(links, left, ["parent"], "inner", frequent=frequent)), needed
        free = waiting.filter("open = 0").select("node")
        done.append(free.select("node", F.lit(level).alias("level"), F.lit(False).alias("cyclic"), F.lit(False).alias("blocked")))
        freed = lookup_join(links, free.withColumnRenamed("node", "parent"), ["parent"], "inner", frequent=frequent)
        closed = freed.select(F.col("child").alias("node"), F.lit(-1).cast("bigint").alias("open"))
        waiting = _kept(waiting.filter("open > 0").union(closed).groupBy("node").agg(F.sum("open").alias("open")))
        level += 1
    stuck = waiting.select("node")
    members = cycle_members(lookup_join(links, stuck.withColumnRenamed("node", "parent"), ["parent"], "inner", frequent=frequent))
    marked = stuck.join(members.select("node", F.lit(True).alias("cyclic")), "node", "left").select(
        "node", F.lit(None).cast("int").alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.col("cyclic").isNull().alias("blocked"))
    return union_all([*done, marked])


def _without_ends(links: DataFrame) -> tuple[DataFrame, int]:
    """(the links between nodes that have both a parent and a child, their number): others are in no cycle."""
    n = links.count()
    while n:
        parents = links.select(F.col("parent").alias("child")).distinct()
        children = links.select(F.col("child").alias("parent")).distinct()
        kept = _kept(lookup_join(lookup_join(links, parents, ["child"], "inner"), children, ["parent"], "inner"))
        left = kept.count()
        if left == n:
            break
        links, n = kept, left
    return links, n


def _coloured(links: DataFrame) -> DataFrame:
    """(node, colour): the largest node from which a node can be reached, itself included."""
    colours = _kept(links.select(F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("colour", F.col("node")))
    news = colours
    while True:
        # only nodes whose colour changed in the last round tell their children
        pushed = lookup_join(links, news.withColumnRenamed("node", "parent"), ["parent"], "inner").groupBy("child").agg(
            F.max("colour").alias("pushed"))
        colours = _kept(colours.join(pushed.withColumnRenamed("child", "node"), "node", "left").select(
            "node", F.greatest("colour", "pushed").alias("colour"), (F.col("pushed") > F.col("colour")).alias("new")))
        news = colours.filter("new").select("node", "colour")
        colours = colours.select("node", "colour")
        if news.isEmpty():
            return colours


def cycle_members(links: DataFrame) -> DataFrame:
    """(node) for every node of links(child, parent) that lies on a cycle of two or more nodes.

    Strongly connected components by colours: the largest node that reaches a node colours it, and the nodes of a colour from
    which its root can be reached are the root's component. Components leave the graph and the rest is coloured anew; nodes
    without a parent or a child left are in no cycle and go at once.
    """
    nothing = links.select(F.col("child").alias("node")).limit(0)
    links, n = _without_ends(_kept(links.select("child", "parent").filter("child <> parent").distinct()))
    found = [nothing]
    while n:
        colours = _coloured(links)
        inside = lookup_join(links, colours.select(F.col("node").alias("child"), "colour"), ["child"], "inner")
        inside = _kept(lookup_join(
            inside, colours.select(F.col("node").alias("parent"), F.col("colour").alias("other")), ["parent"], "inner").filter(
            "colour = other").select("child", "parent", "colour"))
        members = _kept(colours.filter("node = colour"))
        frontier = members
        while not frontier.isEmpty():
            back = lookup_join(inside.select("child", "parent"), frontier.withColumnRenamed("node", "child"), ["child"], "inner")
            frontier = _kept(back.select(F.col("parent").alias("node"), "colour").distinct().join(members, "node", "left_anti"))
            members = _kept(members.union(frontier))
        large = members.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour")
        found.append(members.join(large, "colour", "left_semi").select("node"))
        for end in ("child", "parent"):
            links = links.join(members.select(F.col("node").alias(end)), end, "left_anti")
        links, n = _without_ends(_kept(links.select("child", "parent")))
    return union_all(found)
