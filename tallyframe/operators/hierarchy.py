"""Parent-child links to full hierarchies: path, depth, root, nested-set ranges, and the rows where no tree exists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT, cut, gathered

#: Blocks the children of one parent are spread over for their prefix sums.
SIBLING_BLOCKS = 64
#: Jump rounds after which the loop gives up with an error; 2^60 steps are longer than any table.
MOST_ROUNDS = 60


@dataclass
class Upward:
    """Result of the upward phase: `nodes` with their subtree sizes, and the nodes that it could not process."""

    nodes: DataFrame  # tree nodes: __id, __parent (null for a top node), __depth, __root, __size, key columns, __missing
    cyclic: DataFrame  # key columns, __in (on a cycle) or not (leads into one)


def _number(df: DataFrame, key: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """Give each node a long id and each link the id of the row it names; `__missing` where no such row exists.

    Written to the checkpoint folder in between, so that an id once given stays when a task runs again.
    """
    k = [f"__k{i}" for i in range(len(key))]
    p = [f"__p{i}" for i in range(len(key))]
    rows = df.select(*[F.col(a).alias(b) for a, b in zip(key, k)], *[F.col(a).alias(b) for a, b in zip(parent, p)])
    rows = rows.where(" and ".join(f"{c} is not null" for c in k)).groupBy(*k).agg(
        F.min(F.when(F.col(p[-1]).isNotNull(), F.struct(*p))).alias("__p")
    )
    rows = cut(rows.withColumn("__id", F.monotonically_increasing_id()))
    ids = rows.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(k)], F.col("__id").alias("__parent"))
    cond = [F.col("__p")[c] == F.col(f"__t{i}") for i, c in enumerate(p)]
    linked = rows.join(ids, cond, "left")
    return linked.select("__id", "__parent", (F.col("__p").isNotNull() & F.col("__parent").isNull()).alias("__missing"), *k)


def upward(df: DataFrame, key: Sequence[str], parent: Sequence[str]) -> Upward:
    """Subtree sizes, depths and roots by sums that travel upward; what is left over lies on or below a cycle.

    A node's link names the row whose `key` equals its `parent` columns; a null in the last parent column means "no
    link". A link to no row leaves the node a top node marked `__missing`. A link to itself is a cycle. Rows with a
    null in the key are left out; of repeated keys the least link holds; an empty table gives empty results.

    In round r every unsettled node's pointer leads 2^r links up. Its size so far, the descendants within 2^r links, is handed to
    the node it points to, and the pointer is doubled; so a tree of depth d takes log2(d) + 1 rounds. A node whose pointer passes the root is
    settled: it is written once and not again, and a round only joins the unsettled nodes to what their pointers name (by broadcast once few are left).
    When a round settles no further node, those left have no root: the targets of their ever longer pointers shrink
    to exactly the nodes on cycles.
    """
    k = [f"__k{i}" for i in range(len(key))]
    start = cut(_number(df, key, parent))
    one = F.lit(1).cast("long").alias("__size")
    settled = [start.where("__parent is null").select("__id", F.lit(0).cast("long").alias("__depth"), F.col("__id").alias("__root"))]
    active = start.where("__parent is not null").select("__id", F.col("__parent").alias("__ptr"), F.lit(1).cast("long").alias("__depth"), one)
    handed = []  # sizes handed up, per round
    left = targets = None
    for _ in range(MOST_ROUNDS):
        now = active.agg(F.count("*"), F.countDistinct("__ptr")).first()
        if now[0] == 0 or (now[0], now[1]) == (left, targets):
            break
        left, targets = now
        up = active.groupBy(F.col("__ptr").alias("__id")).agg(F.sum("__size").alias("__add"))
        handed.append(up)
        there = reduce(DataFrame.unionByName, [t.withColumn("__far", F.lit(None).cast("long")) for t in settled]).unionByName(
            active.select("__id", F.col("__depth"), F.lit(None).cast("long").alias("__root"), F.col("__ptr").alias("__far"))
        )
        to = there.select(F.col("__id").alias("__ptr"), "__far", F.col("__depth").alias("__more"), "__root")
        grown = active.join(_few(up, left, NODE_BYTES), "__id", "left").withColumn("__size", F.col("__size") + F.coalesce("__add", F.lit(0)))
        joined = gathered(to).join(_few(grown, left, NODE_BYTES), "__ptr")
        moved = cut(joined.select("__id", F.col("__far").alias("__ptr"), (F.col("__depth") + F.col("__more")).alias("__depth"), "__root", "__size"))
        settled.append(moved.where("__ptr is null").select("__id", "__depth", "__root"))
        active = moved.where("__ptr is not null").select("__id", "__ptr", "__depth", "__size")
    else:
        raise RuntimeError("the hierarchy did not settle")
    trees = gathered(reduce(DataFrame.unionByName, settled))
    sums = gathered(reduce(DataFrame.unionByName, handed)).groupBy("__id").agg(F.sum("__add").alias("__add")) if handed else None
    nodes = start.join(trees, "__id")
    nodes = nodes.withColumn("__size", one) if sums is None else nodes.join(sums, "__id", "left").withColumn("__size", F.coalesce("__add", F.lit(0)) + 1).drop("__add")
    lost = cut(active.select("__id", "__ptr"))
    on = _few(lost.select(F.col("__ptr").alias("__id")).distinct().withColumn("__in", F.lit(True)), now[1], NODE_BYTES)
    cyclic = start.join(_few(lost.select("__id"), now[0], NODE_BYTES), "__id").join(on, "__id", "left").select(*k, F.coalesce("__in", F.lit(False)).alias("__in"))
    return Upward(nodes, cyclic)


#: Bytes of a row of node numbers in a broadcast, at most.
NODE_BYTES = 128


def _few(df: DataFrame, rows: int, size: float) -> DataFrame:
    """Broadcast `df` if its counted `rows` of `size` bytes are within the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows * size <= BROADCAST_LIMIT else df


def breaks(df: DataFrame, key: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """Rows without a sound path: the key columns and `verdict` (orphan, in_cycle, below_cycle).

    An orphan's own link names no row; nodes further down from it still have a path, from the orphan.
    See `upward` for nulls, repeats and empty tables.
    """
    r = upward(df, key, parent)
    k = [F.col(f"__k{i}").alias(c) for i, c in enumerate(key)]
    return r.nodes.where("__missing").select(*k, F.lit("orphan").alias("verdict")).unionByName(
        r.cyclic.select(*k, F.when(F.col("__in"), "in_cycle").otherwise("below_cycle").alias("verdict"))
    )


def _sibling_starts(nodes: DataFrame) -> DataFrame:
    """__id, __ptr and __off: how far a node's preorder position lies behind its parent's.

    Siblings stand in the order of (hash block, id). A sum runs within each block and another over the blocks'
    totals, so that even a parent with a large share of all nodes is spread over SIBLING_BLOCKS tasks.
    """
    kids = nodes.select("__id", "__parent", "__size", F.pmod(F.xxhash64("__id"), F.lit(SIBLING_BLOCKS)).alias("__b"))
    kids = kids.where("__parent is not null")
    before = Window.partitionBy("__parent", "__b").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    inner = kids.withColumn("__w", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    blocks = kids.groupBy("__parent", "__b").agg(F.sum("__size").alias("__s"))
    earlier = Window.partitionBy("__parent").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__parent", "__b", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s"))
    return inner.join(blocks, ["__parent", "__b"]).select("__id", F.col("__parent").alias("__ptr"), (F.col("__w") + F.col("__s") + 1).alias("__off"))


def nested_sets(df: DataFrame, key: Sequence[str], parent: Sequence[str], label: str, separator: str = "/") -> DataFrame:
    """Each tree node's depth, root, path, number of descendants and preorder range.

    Columns: the key columns, `depth` (0 for a top node), `root` (the label column of the top node), `path` (labels
    from the top node down), `descendants`, `lft`, `rgt` (a node's descendants are the nodes of the same root
    with lft < their lft <= rgt) and `orphan` (the top node's own link names no row). `label` is one of the key columns.
    Nodes on or below a cycle have no path and no row here; `breaks` lists them.

    Sizes come from `upward`; positions are the sums of sibling prefix sums along the way down, doubled and settled like there.
    """
    k = [f"__k{i}" for i in range(len(key))]
    name = k[list(key).index(label)]
    nodes = cut(upward(df, key, parent).nodes)
    text = nodes.select("__id", F.col(name).cast("string").alias("__path"))
    settled = [nodes.where("__parent is null").select("__id", F.lit(0).cast("long").alias("__off"), F.col(name).cast("string").alias("__path"))]
    active = cut(_sibling_starts(nodes).join(text, "__id"))
    for _ in range(MOST_ROUNDS):
        n, size = active.agg(F.count("*"), F.coalesce(F.avg(F.octet_length("__path")), F.lit(0.0))).first()
        if n == 0:
            break
        there = reduce(DataFrame.unionByName, [t.withColumn("__far", F.lit(None).cast("long")) for t in settled]).unionByName(active.withColumnRenamed("__ptr", "__far"))
        to = there.select(F.col("__id").alias("__ptr"), "__far", F.col("__off").alias("__more"), F.col("__path").alias("__head"))
        moved = cut(
            gathered(to).join(_few(active, n, size + NODE_BYTES), "__ptr").select(
                "__id", F.col("__far").alias("__ptr"), (F.col("__off") + F.col("__more")).alias("__off"), F.concat("__head", F.lit(separator), "__path").alias("__path")
            )
        )
        settled.append(moved.where("__ptr is null").drop("__ptr"))
        active = moved.where("__ptr is not null")
    else:
        raise RuntimeError("the hierarchy did not settle")
    state = gathered(reduce(DataFrame.unionByName, settled))
    top = nodes.where("__parent is null").select(F.col("__id").alias("__root"), F.col(name).alias("root"), F.col("__missing").alias("orphan"))
    done = nodes.join(state.select("__id", "__off", "__path"), "__id").join(top, "__root")
    return done.select(
        *[F.col(c).alias(n) for c, n in zip(k, key)],
        F.col("__depth").alias("depth"),
        "root",
        F.col("__path").alias("path"),
        (F.col("__size") - 1).alias("descendants"),
        F.col("__off").alias("lft"),
        (F.col("__off") + F.col("__size") - 1).alias("rgt"),
        "orphan",
        F.col("__root").alias("tree"),
    )


def descendants_of(trees: DataFrame, wanted: DataFrame, node: str) -> DataFrame:
    """All (ancestor, descendant) pairs of the `wanted` rows of a `nested_sets` result, by their preorder ranges.

    A range is cut into at most 2·log2(n) aligned blocks of lengths 2^b, and a position lies in one block of each
    length, so the range join is an equality join on (tree, b, block) whose matches are exactly the result.
    """
    cuts = """
        filter(flatten(transform(transform(sequence(0, 40), b -> struct(
            b as b, shiftright(lo + shiftleft(1L, b) - 1, b) as l, shiftright(hi + 1, b) as h
        )), t -> array(
            struct(t.b as b, case when t.l < t.h and t.l % 2 = 1 then t.l end as at),
            struct(t.b as b, case when t.l < t.h and t.h % 2 = 1 then t.h - 1 end as at)
        ))), s -> s.at is not null)"""
    asked = wanted.where("descendants > 0").select(F.col(node).alias("ancestor"), "tree", (F.col("lft") + 1).alias("lo"), F.col("rgt").alias("hi"))
    asked = asked.select("ancestor", "tree", F.explode(F.expr(cuts)).alias("s")).select("ancestor", "tree", "s.b", "s.at")
    used = [r.b for r in asked.select("b").distinct().collect()]  # at most 41 lengths
    at = trees.select(F.col(node).alias("descendant"), "tree", "lft", F.explode(F.array(*[F.lit(b) for b in used or [0]])).alias("b"))
    at = at.select("descendant", "tree", "b", F.expr("shiftright(lft, b)").alias("at"))
    return asked.join(at, ["tree", "b", "at"]).select("ancestor", "descendant")
