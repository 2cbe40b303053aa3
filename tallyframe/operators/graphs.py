"""Fixpoints over links: chains along matches and connected components."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, gathered

#: Rounds after which a fixpoint gives up with an error instead of returning part of the result.
MOST_ROUNDS = 200


def follow(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = MOST_ROUNDS) -> DataFrame:
    """`start` and all rows reached from it by repeating `step`, each distinct row once.

    Each round steps on from the rows that are new; rows met before are dropped, so a cycle ends. Every round writes its new rows only, and what has
    been met is read as the union of the rounds. A step that still finds new rows after `rounds` rounds is an error.
    """
    edge = cut(start.distinct())
    seen = [edge]
    for _ in range(rounds):
        new = step(edge).select(*start.columns).distinct()
        cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in start.columns]
        edge = cut(new.alias("a").join(gathered(reduce(DataFrame.unionByName, seen)).alias("b"), cond, "left_anti"))
        if edge.isEmpty():
            return gathered(reduce(DataFrame.unionByName, seen))
        seen.append(edge)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def components(edges: DataFrame, a: str, b: str, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, component) for the nodes of undirected `edges`; a component is named by its least node.

    Alternates two contractions, of each node's greater and lesser neighbours towards its least one, which settle after
    about log2(nodes) rounds whatever the diameter. Loops are allowed and give their node a component. Each round is two
    map-side combined minima joined back, so a node with many neighbours is no group to collect. Nulls are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select("u").union(e.select("v")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def both(x: DataFrame) -> DataFrame:
        return x.select("u", "v").union(x.select(F.col("v").alias("u"), F.col("u").alias("v")))

    before = None
    for _ in range(rounds):
        n = both(e)
        low = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = n.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        e = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(e)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("m")), "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
