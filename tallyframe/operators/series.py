"""Time series of facts: latest attributes, sign alignment, differences of running totals, residual periods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flip_sign(value: Column, weight: Column, target: Column) -> Column:
    """`value` with its sign turned where `weight` and `target` disagree; unchanged where either is null."""
    return F.when(weight * target < 0, -value).otherwise(value)


def with_latest(df: DataFrame, series: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Add `latest_<c>` for each of `columns`: its value in the first row of the series by `order` (newest first)."""
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.first(c).over(w).alias(f"latest_{c}") for c in columns])


def undo_running_total(
    df: DataFrame, series: Sequence[str], period_end: str, value: str, running: Column, order: Sequence[Column], gap: tuple[int, int] = (80, 100)
) -> Column:
    """A quarter's own amount: where `running` holds, the value less the previous row's, if that lies `gap` days before."""
    w = Window.partitionBy(*series).orderBy(*order)
    apart = F.datediff(period_end, F.lag(period_end).over(w))
    before = F.when(apart.between(*gap), F.lag(value).over(w))
    return F.when(running & before.isNotNull(), F.col(value) - before).otherwise(F.col(value))


def next_matching(df: DataFrame, partition: Sequence[str], order: Sequence[Column], match: Column, value: Column, name: str) -> DataFrame:
    """Add `name`: the `value` of the nearest following row that meets `match`, null if there is none (forward as-of)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(match, value), ignorenulls=True).over(w))


def residual(whole: DataFrame, parts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of `whole` with the sum of their `parts` taken off; rows without any part are left out. Null keys match nothing."""
    total = parts.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    return whole.join(total, list(keys)).withColumn(value, F.col(value) - F.col("__sum")).drop("__sum")


def longest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, chain_size): the longest run of comparatives through each row of the series that follow one another in a partition.

    Columns: id, first (a series begins), whole (no key of the series is null; else nothing leads anywhere), concept, value, period end (days), comparative value
    and comparative period end. A series is in the order of its period ends; of rows equal in period and value the first is led to. All links lead to earlier
    periods, so one pass forward finds how far a row reaches back, and one pass backward hands the longest run on. Rows on no run are left out.

    Python, since each row's height needs that of its comparative; a series, which the windows keep in one task as well, is held in memory.
    """

    def walk(rows: list[tuple]) -> list[tuple]:
        picked: dict = {}  # (value, period end) -> row, where a value is led to
        alike: dict = {}  # (concept, period end) -> those of them that have this concept
        height, links = [0] * len(rows), [()] * len(rows)
        for n, (_, whole, concept, value, end, c_value, c_end) in enumerate(rows):
            if not whole or end is None:
                continue
            if c_end is not None and c_end < end:
                there = picked.get((c_value, c_end)) if c_value is not None else None
                links[n] = to = (there,) if there is not None else alike.get((concept, c_end), ())
                if to:
                    height[n] = 1 + max(height[t] for t in to)
            if (value, end) not in picked:
                picked[value, end] = n
                if concept is not None:
                    alike.setdefault((concept, end), []).append(n)
        size = [0] * len(rows)
        for n in range(len(rows) - 1, -1, -1):
            if rows[n][5] is not None and rows[n][6] is not None:
                size[n] = max(size[n], height[n] + 1)
            if size[n]:
                for t in links[n]:
                    size[t] = max(size[t], size[n])
        return [(r[0], s) for r, s in zip(rows, size) if s]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([s for _, s in out], pa.int32())], ["id", "chain_size"])

    series: list[tuple] = []
    out: list[tuple] = []
    for b in batches:
        ids, first, *rest = [b.column(c).to_pylist() for c in range(8)]
        for begins, row in zip(first, zip(ids, *rest)):
            if begins and series:
                out += walk(series)
                series = []
            series.append(row)
        if len(out) > 10_000:
            yield batch(out)
            out = []
    yield batch(out + walk(series))
