"""Connected components of a graph given as links, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import discard, materialize


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _jump(parents: DataFrame) -> DataFrame:
    """The root of every node in a forest (node, parent) whose roots have no row."""
    before = None
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        stepped = materialize(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "jump")
        parents = stepped.select("node", "parent")
        done = not _any(stepped.where("moved"))
        discard(before)
        before = stepped
        if done:
            return parents


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named after its smallest node.

    In each round every node hooks to its smallest neighbour, the trees so made are flattened by pointer
    jumping and the links contracted to their roots, so at least half of the nodes that still have links
    vanish. A hub is only reduced to a minimum, with partial results on the map side.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).where("node is not null").distinct(), "nodes")
    edges = materialize(pairs.where("u <> v").distinct(), "edges")
    rounds: list[DataFrame] = []
    while _any(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")).where("parent < node"), "hooks")
        roots = _jump(hooks)
        rounds.append(roots)
        u, v = (roots.select(F.col("node").alias(c), F.col("parent").alias(f"root_{c}")) for c in "uv")
        renamed = edges.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
        old, edges = edges, materialize(renamed.where("u <> v").distinct(), "edges")
        discard(old)
        discard(hooks)
    named = nodes.withColumn("component", F.col("node"))
    for roots in rounds:
        step = roots.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        named = named.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return materialize(named, "components")
