"""Distributed connected components by hooking and contraction.

Each round hooks every node to its smallest neighbour, flattens the resulting
trees by pointer jumping and rewrites the edges between roots; the edge table
shrinks from round to round and nothing is collected. A hub's neighbours meet
in joins that AQE can split and in sums that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, store


def _flatten(parents: Stored) -> Stored:
    """Pointer jumping until every node points at a root."""
    while True:
        p = parents.df
        up = p.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = store(
            p.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "cc-up"
        )
        moved = not jumped.df.where("moved").isEmpty()
        parents.drop()
        parents = jumped
        if not moved:
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    left = store(ends, "cc-edges")
    maps: list[Stored] = []
    while not left.df.isEmpty():
        e = left.df
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hooked = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up"))
        flat = _flatten(store(hooked, "cc-up"))
        maps.append(flat)
        up = flat.df.select("node", "up")
        moved = (
            e.join(up.withColumnsRenamed({"node": "a", "up": "ra"}), "a")
            .join(up.withColumnsRenamed({"node": "b", "up": "rb"}), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        after = store(moved, "cc-edges")
        left.drop()
        left = after
    left.drop()
    if not maps:
        return edges.select(F.col(a).cast("long").alias("node"), F.col(a).cast("long").alias("component")).limit(0)
    found = maps[0].df.select("node", F.col("up").alias("component"))
    for m in maps[1:]:
        later = m.df.select(F.col("node").alias("component"), "up")
        found = found.join(later, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    done = store(found, "cc")
    for m in maps:
        m.drop()
    return done.df
