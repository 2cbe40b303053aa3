from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.names import folded
from tallyframe.operators.history import versions

D = [date(2020 + i // 12, i % 12 + 1, 28) for i in range(40)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id int, d date, s string, got int")
    return {(r.id, r.valid_from, r.valid_to, r.s, r.change) for r in versions(df, ["id"], "d", {"s": folded("s")}, ["got"], **kw).collect()}


def test_silent_gaps_nulls_repeats_and_corrections(spark):
    rows = [
        (1, D[0], " Active", 1), (1, D[1], "ACTIVE ", 1), (1, D[1], "active", 1), (1, D[3], None, 1), (1, D[5], "halted", 1),
        (1, D[5], "active", 2), (1, D[9], "halted", 1), (1, D[30], "active", 1), (2, D[2], None, 1), (2, D[4], "x", 1), (None, D[1], "y", 1), (3, None, "y", 1),
    ]
    assert run(spark, rows) == {
        (1, D[0], D[9], "active", "inserted"), (1, D[9], D[30], "halted", "changed"), (1, D[30], None, "active", "changed"),
        (2, D[2], D[4], None, "inserted"), (2, D[4], None, "x", "changed"),
    }


@pytest.mark.parametrize("block", ["month", "quarter", "year"])
def test_blocks_do_not_show(spark, block):
    rows = [(1, d, None if i % 3 else f"s{i // 7}", i) for i, d in enumerate(D)]
    last, want = None, []
    for i, d in enumerate(D):
        s = last if i % 3 else f"s{i // 7}"
        if s != last:
            want.append((d, s))
        last = s
    got = sorted((f, s) for _, f, _, s, _ in run(spark, rows, block=block))
    assert got == want


def test_absence_as_deletion(spark):
    rows = [(1, D[0], "a", 1), (2, D[0], "b", 1), (1, D[1], "a", 1), (1, D[2], "a", 1), (2, D[2], "b", 1)]
    assert run(spark, rows, absence="deleted") == {(1, D[0], None, "a", "inserted"), (2, D[0], D[1], "b", "inserted"), (2, D[2], None, "b", "inserted")}
    with pytest.raises(ValueError):
        run(spark, rows, absence="other")


def test_empty_and_clashing(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(1, D[0], "a", 1, 5, 6)], "id int, d date, s string, got int, `__t` int, valid_from int")
    assert versions(df, ["id"], "d", {"s": F.col("s")}, ["got"]).count() == 1
