"""Connected components by frontier breadth-first search with many seeds at once.

A level works on one graph:

1. every node whose priority (degree class, then hash) beats all its neighbours' is a seed;
2. the seeds' frontiers grow together for a few rounds over the hash-partitioned adjacency rows; a node takes the smallest
   label that reaches it first; nodes that none reaches stay under their own name;
3. edges whose ends carry different labels are the collisions. They form the next, smaller graph, whose nodes are labels.

The levels end when no collision is left. High degrees win, so that a hub, which may hold a third of all rows, absorbs
its neighbours in one round. Rows of hubs are salted wherever they are joined; all aggregations combine before they shuffle.
No link, label or component ever reaches the driver, only counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize, skew_join

SALTS = 32
#: A node is hot if it holds more than 1/HOT of all edge ends and more than LEAST_HOT of them; so fewer than HOT nodes are.
HOT, LEAST_HOT = 256, 20_000


def _salt(ids: list[int], other: str) -> Column:
    """0, but for rows whose u is one of the few hot nodes a value below `SALTS` drawn from the other end."""
    return F.when(F.col("u").isin(ids), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0) if ids else F.lit(0)


def _send(edges: DataFrame, labels: DataFrame, hot: list[int]) -> DataFrame:
    """(u, v, label): every adjacency row with the label of u. Rows of hot nodes are spread over salts, and so are those nodes' labels."""
    if not hot:
        return edges.join(labels, "u")
    salts = F.when(F.col("u").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return edges.withColumn("salt", _salt(hot, "v")).join(labels.withColumn("salt", F.explode(salts)), ["u", "salt"]).drop("salt")


def _level(edges: DataFrame, prio: DataFrame, hot: list[int], rounds: int) -> DataFrame:
    """(u, label) for every node of the symmetric `edges`: one level of the search."""
    best = _send(edges, prio, hot).groupBy(F.col("v").alias("u")).agg(F.min("label").alias("near"))
    state = materialize(prio.join(best, "u").select("u", F.when(F.col("label") < F.col("near"), F.col("u")).alias("label")))
    for _ in range(rounds):
        frontier = state.where("label is not null")
        reached = _send(edges, frontier, hot).groupBy(F.col("v").alias("u")).agg(F.min("label").alias("found"))
        state = materialize(state.join(reached, "u", "left").select("u", F.coalesce("label", "found").alias("label")))
    return state.select("u", F.coalesce("label", "u").alias("label"))


def connected_components(links: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, component) for every id in `links(a bigint, b bigint)`; component is an id of the group.

    Null ends are dropped, repeated and self links allowed (an id that only links to itself is its own component). Empty input gives an empty table.
    """
    links = links.where("a is not null and b is not null")
    both = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = materialize(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    maps: list[DataFrame] = []
    while total := edges.count():
        # the smaller struct wins: high degree class, then hash; the id makes it unique
        rank = F.struct((-F.floor(F.log2(F.col("n").cast("double")))).cast("int").alias("c"), F.xxhash64("u", F.lit(len(maps))).alias("x"), F.col("u").alias("i"))
        degree = materialize(edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", rank.alias("label"), "n"))
        hot = [r.u for r in degree.where((F.col("n") * HOT > total) & (F.col("n") > LEAST_HOT)).select("u").collect()]  # fewer than HOT by the first condition
        labels = _level(edges, degree.select("u", "label"), hot, rounds)
        maps.append(labels)
        # each end in turn takes its label; a hub's rows shrink to distinct (label, hub) before the second step
        half = _send(edges, labels, hot).select(F.col("v").alias("u"), F.col("label").alias("v")).distinct()
        edges = materialize(_send(half, labels, hot).where("label <> v").select(F.col("label").alias("u"), "v").distinct())
    out = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    for m in maps:
        out = out.join(m.select(F.col("u").alias("component"), F.col("label").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return out


def named_nodes(ties: DataFrame, *key: str) -> DataFrame:
    """`ties` with `node`, a hash of the key columns: no join, so a key of a third of all rows moves nowhere. Two keys of one hash would lead to another seed."""
    for seed in range(8):
        named = materialize(ties.withColumn("node", F.xxhash64(*key, F.lit(seed))))
        # copies of a key combine ahead of the shuffle
        if named.groupBy("node").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).where("a <> b").isEmpty():
            return named
    raise RuntimeError("no seed gave every key a number of its own")


def tied(ties: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """(item, component) of the items that `ties(item, node)` ties by shared nodes, and (id, component) of the nodes.

    Nodes are keys, not items: an item only links its keys, one being the anchor, so a key of a third of all rows adds no work beyond its distinct links.
    """
    rows = ties.groupBy(item).agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    rows = materialize(rows.select(item, F.col("nodes")[0].alias("anchor"), "nodes"))
    links = rows.select(F.col("anchor").alias("a"), F.explode("nodes").alias("b")).distinct()
    comp = materialize(connected_components(links))
    return skew_join(rows.select(item, "anchor"), comp.withColumnRenamed("id", "anchor"), "anchor").select(item, "component"), comp
