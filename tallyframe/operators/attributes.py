"""Entity-attribute-value rows into one wide row per entity with typed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_map(present: list[Column], key: str, value: str) -> Column:
    """A map from the array of (attribute, raw) structs in `present` whose raw part is not null."""
    kept = F.filter(F.array(*present), lambda s: s[value].isNotNull())
    return F.map_from_entries(kept)


def widen(
    df: DataFrame,
    entity: Sequence[str],
    attribute: Column,
    value: Column,
    order: Sequence[Column],
    columns: Mapping[str, tuple[object, str]],
    failures: str = "cast_failures",
) -> DataFrame:
    """One row per entity with a typed column for each known attribute.

    `columns` maps output column -> (attribute value, Spark type). Rows of one entity and attribute are resolved to
    one pair first: the non-null value that is greatest by `order`, then by the value itself (so ties and repeated
    rows give one defined result). The resolved pairs of an entity become one map, from which the known attributes
    are cast to their types. A value its type cannot hold leaves the column null and is kept, as text, in the map
    column `failures` under the output column's name.

    Entities without any known attribute keep a row of nulls; null entity columns form entities of their own; rows
    whose attribute is unknown or null add nothing but their entity; an empty table gives no rows. Columns of the
    input that are not named have no influence, whatever they are called.

    Both aggregations combine on the map side, and an entity's map holds at most one pair per known attribute, so a
    key with any share of all rows stays small.
    """
    known = [a for a, _ in columns.values()]
    ent = [f"__e{i}" for i in range(len(entity))]
    src = df.select(
        *[F.col(e).alias(n) for e, n in zip(entity, ent)],
        F.when(attribute.isin(known), attribute).alias("__a"),
        value.alias("__v"),
        *[o.alias(f"__o{i}") for i, o in enumerate(order)],
    )
    rank = F.struct(*[F.col(f"__o{i}") for i in range(len(order))], F.col("__v")) if len(order) != 1 else F.col("__o0")
    best = F.max_by("__v", F.when(F.col("__v").isNotNull() & F.col("__a").isNotNull(), rank))
    pairs = src.groupBy(*ent, "__a").agg(best.alias("__v"))
    wide = pairs.groupBy(*ent).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("__a").isNotNull() & F.col("__v").isNotNull(), F.struct("__a", "__v")))
        ).alias("__m")
    )
    cells, failed = [], []
    for name, (attr, kind) in columns.items():
        raw = F.element_at("__m", F.lit(attr))
        cast = raw.try_cast(kind)
        cells.append(cast.alias(name))
        failed.append(F.struct(F.lit(name).alias("k"), F.when(cast.isNull(), raw.cast("string")).alias("v")))
    return wide.select(*[F.col(n).alias(e) for e, n in zip(entity, ent)], *cells, _as_map(failed, "k", "v").alias(failures))


def empty_cells(wide: DataFrame, entity: Sequence[str], columns: Mapping[str, object], failures: str = "cast_failures") -> DataFrame:
    """(entity, attribute) of each cell of `wide` that has neither a value nor a retained cast failure.

    `columns` maps the column of `wide` to the attribute name to report.
    """
    cell = [
        F.when(F.col(c).isNull() & ~F.map_contains_key(failures, c), F.lit(name)) for c, name in columns.items()
    ]
    return wide.select(*entity, F.explode(F.array_compact(F.array(*cell))).alias("attribute"))
