"""Histories of changing attributes from periodic snapshots or from updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _blocked(df: DataFrame, key: Sequence[str], moment: str, unit: str, fill: Sequence[str]) -> DataFrame:
    """Number each key's rows by `moment` in `__n` (from 1) and carry the last non-null of `fill` forward.

    Rows are windowed by (key, time block), and only one summary row per block is windowed by key alone, so a key
    that holds a large share of all rows is spread over as many tasks as it has blocks.
    """
    rows = df.withColumn("__b", F.date_trunc(unit, F.col(moment).cast("timestamp_ntz")))
    w = Window.partitionBy(*key, "__b").orderBy(moment)
    rows = rows.select(
        "*", F.row_number().over(w).alias("__i"), *[F.last(c, ignorenulls=True).over(w).alias(f"__f_{c}") for c in fill]
    )
    ends = rows.groupBy(*key, "__b").agg(
        F.max("__i").alias("__c"), *[F.max_by(f"__f_{c}", moment).alias(f"__l_{c}") for c in fill]
    )
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *key,
        "__b",
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c"),
        *[F.last(f"__l_{c}", ignorenulls=True).over(before).alias(f"__l_{c}") for c in fill],
    )
    rest = [c for c in df.columns if c not in {*key, *fill}]
    return rows.join(ends, [*key, "__b"]).select(
        *key,
        *rest,
        *[F.coalesce(f"__f_{c}", f"__l_{c}").alias(c) for c in fill],
        (F.col("__c") + F.col("__i")).alias("__n"),
    )


def _next_moment(df: DataFrame, key: Sequence[str], moment: str, unit: str, name: str) -> DataFrame:
    """Add the next `moment` of the same key: a lead within time blocks, and over the blocks' first moments."""
    rows = df.withColumn("__b", F.date_trunc(unit, F.col(moment).cast("timestamp_ntz")))
    rows = rows.withColumn("__x", F.lead(moment).over(Window.partitionBy(*key, "__b").orderBy(moment)))
    ends = rows.groupBy(*key, "__b").agg(F.min(moment).alias("__s"))
    ends = ends.select(*key, "__b", F.lead("__s").over(Window.partitionBy(*key).orderBy("__b")).alias("__s"))
    return rows.join(ends, [*key, "__b"]).withColumn(name, F.coalesce("__x", "__s")).drop("__b", "__x", "__s")


def versions(
    df: DataFrame,
    key: Sequence[str],
    moment: str,
    attributes: Mapping[str, Column],
    received: Sequence[str],
    absence: str = "silent",
    block: str = "quarter",
) -> DataFrame:
    """All versions of each key: key, valid_from, valid_to, change, attributes.

    Of several rows of one key and moment the last by `received` holds (ties: the greatest attributes). Each image is
    joined, by a full outer join that compares null-safe, with the key's image before it: without one before it the
    key is `inserted`, with other attributes it is `changed`, with none after it its life ends there. A null attribute
    means "as before". `attributes` gives the compared form of each attribute (for example without letter case).

    absence="silent": a key missing from a snapshot says nothing, so images are compared with the key's own last one.
    absence="deleted": every moment is a full snapshot; a key missing from the next one is `deleted` then (valid_to is
    that moment), and a later return is `inserted`.

    The last rows, the numbered images and the events are each read twice, so they are written once to the checkpoint folder.

    Rows with a null key or moment are left out; repeated rows count once; an empty table gives no versions. Extra
    columns are ignored, so their names cannot clash.
    """
    keys = [f"__k{i}" for i in range(len(key))]
    src = df.select(
        *[F.col(k).alias(n) for k, n in zip(key, keys)],
        F.col(moment).alias("__t"),
        F.struct(*[F.col(r).alias(f"r{i}") for i, r in enumerate(received)], *[c.alias(f"a_{n}") for n, c in attributes.items()]).alias("__s"),
    ).where(" and ".join(f"{c} is not null" for c in [*keys, "__t"]))
    last = src.groupBy(*keys, "__t").agg(F.max("__s").alias("__s"))
    names = list(attributes)
    last = last.select(*keys, "__t", *[F.col(f"__s.a_{n}").alias(n) for n in names])
    numbered = cut(_blocked(cut(last), keys, "__t", block, names))
    moments = None
    if absence == "deleted":
        # one row per snapshot, not per entity: the list of moments is as long as there are snapshots
        moments = last.select("__t").distinct().withColumn("__n", F.row_number().over(Window.orderBy("__t")).cast("long"))
        numbered = numbered.drop("__n").join(moments, "__t")
    elif absence != "silent":
        raise ValueError(f"absence must be 'silent' or 'deleted', not {absence!r}")
    now = numbered.select(*keys, "__n", "__t", F.struct(*names).alias("__new"))
    then = numbered.select(*keys, (F.col("__n") + 1).alias("__n"), F.struct(*names).alias("__old"), F.lit(True).alias("__had"))
    both = now.join(then, [*keys, "__n"], "full_outer")
    change = (
        F.when(F.col("__t").isNull(), "deleted")
        .when(F.col("__had").isNull(), "inserted")
        .when(~F.col("__new").eqNullSafe(F.col("__old")), "changed")
    )
    events = both.withColumn("change", change).where("change is not null")
    if moments is None:
        events = events.where("change <> 'deleted'")
    else:
        events = events.join(moments.withColumnRenamed("__t", "__at"), "__n").withColumn("__t", F.coalesce("__t", "__at"))
    events = _next_moment(cut(events), keys, "__t", block, "valid_to").where("change <> 'deleted'")
    return events.select(
        *[F.col(n).alias(k) for k, n in zip(key, keys)],
        F.col("__t").alias("valid_from"),
        "valid_to",
        "change",
        *[F.col(f"__new.{n}").alias(n) for n in names],
    )
