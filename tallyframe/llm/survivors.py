"""One surviving record per group of duplicates, built from consistent bundles of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT, cut


@dataclass(frozen=True)
class Bundle:
    """Fields that only make sense together and are taken from one record as a whole.

    A record offers the bundle where `offered` holds. Its trust is a whole number of `points`, which are added up over the bundles
    of a survivor, and orderable columns (`trust`), the first weighing most, that decide between equal sums. `fields` are filled from the chosen record.
    """

    fields: Sequence[str]
    offered: Column
    trust: Sequence[Column]
    points: Column | None = None


def _candidates(bundles: Mapping[str, Bundle], record: str) -> dict[str, Column]:
    """Per bundle the aggregate that gives its most trusted record: its trust `t` (points, order, id) and its determinants `d`."""
    out = {}
    for n, b in bundles.items():
        points = F.lit(0) if b.points is None else b.points
        t = F.struct(points.cast("long").alias("points"), *[x.alias(f"t{i}") for i, x in enumerate(b.trust)], (-F.col(record)).alias("id"))
        out[n] = F.max(F.when(b.offered, F.struct(t.alias("t"), F.col("__d").alias("d"))))
    return out


def _roots(df: DataFrame, group: Sequence[str], record: str, bundles: Mapping[str, Bundle], determinants: Sequence[Column], at_least: int):
    """(rows, root, group columns): the rows with determinants, and per group the unconstrained maximum of each bundle with `__done`."""
    g = [f"__g{i}" for i in range(len(group))]
    names = list(bundles)
    rows = df.withColumns({n: F.col(c) for n, c in zip(g, group)} | {"__d": F.struct(*[d.alias(f"d{i}") for i, d in enumerate(determinants)])})
    root = rows.groupBy(*g).agg(F.count("*").alias("__n"), *[c.alias(n) for n, c in _candidates(bundles, record).items()])
    root = root.where((F.col("__n") >= at_least) & F.col(names[0]).isNotNull()).drop("__n")
    agree = F.lit(True)
    for i in range(len(determinants)):
        agree = agree & (F.size(F.array_distinct(F.array_compact(F.array(*[F.col(n)["d"][f"d{i}"] for n in names])))) <= 1)
    return rows, root.withColumn("__done", agree), g


def branching(df: DataFrame, group: Sequence[str], record: str, bundles: Mapping[str, Bundle], determinants: Sequence[Column], at_least: int = 2) -> DataFrame:
    """One row: how many groups have a survivor, and in how many of them the most trusted bundles contradict each other, so that the search branches."""
    _, root, _ = _roots(df, group, record, bundles, determinants, at_least)
    return root.agg(F.count("*").alias("groups"), F.count_if(~F.col("__done")).alias("branching"))


def choose_bundles(
    df: DataFrame, group: Sequence[str], record: str, bundles: Mapping[str, Bundle], determinants: Sequence[Column], at_least: int = 2
) -> DataFrame:
    """Choose, per group of at least `at_least` records, the record that gives each bundle.

    The bundles of a survivor must agree on each of the `determinants` (the functional dependencies group -> determinant must hold in
    what is built); a null agrees with any. Among the consistent choices the one of the greatest sum of points is taken; between equal
    sums the trust of the first bundle decides, then that of the second, and so on; ties fall to the record
    of the smallest id. The first bundle must be present, later ones may stay empty. A group in which no record offers the first bundle has no survivor.

    Output: the group columns and one column per bundle with the id of its record (null if empty). Null group values
    agree with each other; repeated records count as records; an empty table gives no rows; other columns of `df` are
    not touched, so their names cannot clash.

    The root of the search is one map-side combined maximum per group and bundle, without the constraints: where those choices
    agree, the bound is attained and nothing is left to branch on (`branching` counts the others). Only the records of the other groups are read again:
    candidates of one group, bundle and determinants differ in trust alone, so another combined maximum leaves one per
    distinct determinant values, and branch and bound over these lists runs inside the JVM. No list is built from records.
    """
    names = list(bundles)
    rows, root, g = _roots(df, group, record, bundles, determinants, at_least)
    root = cut(root)
    out = lambda x, ids: x.select(*[F.col(n).alias(c) for n, c in zip(g, group)], *[(-i).alias(n) for n, i in zip(names, ids)])
    done = out(root.where("__done"), [F.col(n)["t"]["id"] for n in names])
    left = root.where("not __done").select(*[F.col(n).alias(f"__r{i}") for i, n in enumerate(g)])
    size = left.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in left.columns), F.lit(64)))).first()[0]
    if size is None:
        return done
    left = F.broadcast(left) if size <= BROADCAST_LIMIT else left
    again = rows.join(left, [F.col(n).eqNullSafe(F.col(f"__r{i}")) for i, n in enumerate(g)], "left_semi")
    solved = _branch(again, g, names, _candidates(bundles, record), len(determinants))
    return done.unionByName(out(solved, [F.col(f"s.{n}.id") for n in names]))


def _branch(rows: DataFrame, g: list[str], names: list[str], cand: dict[str, Column], kinds: int) -> DataFrame:
    """The best consistent choice per group of `rows`, as the struct `s` of the sum of points and each bundle's trust."""
    best = rows.groupBy(*g, "__d").agg(*[c.alias(n) for n, c in cand.items()])
    every = best.groupBy(*g).agg(*[F.sort_array(F.collect_list(n), asc=False).alias(f"__l_{n}") for n in names])
    kind = {n: every.schema[f"__l_{n}"].dataType.elementType["t"].dataType for n in names}
    fields = [f"d{i}" for i in range(kinds)]

    def score(parts: list[Column]) -> Column:
        total = sum((F.coalesce(p["points"], F.lit(0)) for p in parts), F.lit(0).cast("long"))
        return F.struct(total.alias("points"), *[p.alias(n) for n, p in zip(names, parts)])

    tops = [F.get(F.col(f"__l_{n}"), F.lit(0))["t"] for n in names]

    def extend(level: int, chosen: list[Column], d: list[Column], best_so_far: Column) -> Column:
        """The better of `best_so_far` and the best completion of `chosen` from bundle `level` on."""
        if level == len(names):
            found = score(chosen)
            return F.when(best_so_far.isNull() | (found > best_so_far), found).otherwise(best_so_far)
        n = names[level]
        empty = F.lit(None).cast(kind[n])
        bound = lambda t: score([*chosen, t, *tops[level + 1 :]])

        def branch(acc: Column, c: Column) -> Column:
            apart = F.lit(False)
            for f, x in zip(fields, d):
                apart = apart | F.coalesce(x != c["d"][f], F.lit(False))
            skip = apart | (acc.isNotNull() & (bound(c["t"]) <= acc))
            return F.when(skip, acc).otherwise(extend(level + 1, [*chosen, c["t"]], [F.coalesce(x, c["d"][f]) for f, x in zip(fields, d)], acc))

        tried = F.aggregate(F.col(f"__l_{n}"), best_so_far, branch)
        return tried if level == 0 else extend_empty(level, chosen, d, tried, empty)

    def extend_empty(level: int, chosen: list[Column], d: list[Column], acc: Column, empty: Column) -> Column:
        left_out = [*chosen, empty, *tops[level + 1 :]]
        return F.aggregate(
            F.array(F.lit(0)), acc, lambda a, _: F.when(a.isNotNull() & (score(left_out) <= a), a).otherwise(extend(level + 1, [*chosen, empty], d, a))
        )

    nothing = F.lit(None).cast(every.select(score([F.lit(None).cast(kind[n]) for n in names]).alias("s")).schema["s"].dataType)
    free = [F.lit(None).cast(best.schema["__d"].dataType[f].dataType) for f in fields]
    return every.select(*g, extend(0, [], free, nothing).alias("s"))


def build_survivors(df: DataFrame, chosen: DataFrame, record: str, bundles: Mapping[str, Bundle], group: Sequence[str]) -> DataFrame:
    """The surviving records: group columns, per bundle the id of its record, and the bundle's fields from that record."""
    out = chosen
    for n, b in bundles.items():
        part = df.select(F.col(record).alias(n), *[F.col(f).alias(f"__x_{f}") for f in b.fields])
        out = out.join(part, n, "left")
    fields = [f for b in bundles.values() for f in b.fields]
    return out.select(*group, *bundles, *[F.col(f"__x_{f}").alias(f) for f in fields])
