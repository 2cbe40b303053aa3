"""Best-match rule joins, keep-first, ambiguity removal and value matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order.

    Spark limits each key to its first row within every partition before it shuffles, so a key of any size is cheap.
    Null keys form a group; ties beyond `order` are the caller's to break; an empty table stays empty.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def drop_ambiguous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Remove every row of each key that holds more than one distinct non-null `value`.

    Nulls in keys are equal to each other; a null value contradicts nothing. Only keys in conflict are joined back.
    """
    bad = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo < __hi")
    bad = bad.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(bad, cond, "left_anti")


def ambiguous_ids(df: DataFrame, keys: Sequence[str], value: str, record: str) -> DataFrame:
    """Ids of the rows that `drop_ambiguous` removes."""
    kept = drop_ambiguous(df, keys, value)
    return df.select(record).join(kept.select(record), record, "left_anti")


def best_match(
    left: DataFrame, record: str, rules: DataFrame, on: Sequence[str], owner: str, shared: Column, fits: Column, rank: Sequence[Column]
) -> DataFrame:
    """For each record the one rule that fits best: `record` and the struct `rule`; records without a rule are absent.

    A rule belongs to the record's `owner` or is shared by all (`shared`); it must agree on the columns `on` and meet `fits`, a
    predicate over `l` (record) and `r` (rule). Own rules beat shared ones, then `rank` decides, greatest first (its
    expressions must end in a total order). `rules` columns keep their names inside the struct, so they cannot clash.
    Nulls in `on` match nothing.

    Own and shared rules are joined apart, each on equal keys, and the candidates of a record are reduced by a map-side
    combined maximum.
    """
    r = rules.select(F.struct(*rules.columns).alias("r"), *[F.col(c).alias(f"__{c}") for c in on], F.col(owner).alias("__owner"), shared.alias("__shared"))
    r = small(r)
    lf = left.select(F.struct(*left.columns).alias("l"))
    same = [F.col(f"l.{c}") == F.col(f"__{c}") for c in on]
    own = lf.join(r, [*same, F.col(f"l.{owner}") == F.col("__owner")]).where(fits).withColumn("__own", F.lit(1))
    rest = lf.join(r.where("__shared"), same).where(fits).where(~F.col(f"l.{owner}").eqNullSafe(F.col("__owner"))).withColumn("__own", F.lit(0))
    best = own.unionByName(rest).groupBy(F.col(f"l.{record}").alias(record)).agg(
        F.max(F.struct("__own", *[c.alias(f"__r{i}") for i, c in enumerate(rank)], "r")).alias("__best")
    )
    return best.select(record, F.col("__best.r").alias("rule"))


def value_matches(
    newer: DataFrame, older: DataFrame, on: Sequence[str], amount: tuple[str, str], period: tuple[str, str], differs: Column
) -> DataFrame:
    """Pairs (`n`, `o`) in which a newer row's comparative amount and period are an older row's amount and period.

    `on` must be equal, `differs` is a predicate over `n` and `o`, and the newer period must be later. Nulls match nothing.
    """
    a = newer.select(F.struct(*newer.columns).alias("n"))
    b = older.select(F.struct(*older.columns).alias("o"))
    cond = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in on]
    cond += [F.col(f"n.{amount[0]}") == F.col(f"o.{amount[1]}"), F.col(f"n.{period[0]}") == F.col(f"o.{period[1]}")]
    return a.join(b, cond).where(differs).where(F.col(f"n.{period[1]}") > F.col(f"o.{period[1]}"))
