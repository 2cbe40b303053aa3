from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.functions.names import concept_key
from tallyframe.operators.attributes import empty_cells, widen

COLUMNS = {"a": ("x:a", "decimal(6,2)"), "b": ("x:b", "int")}


def wide(spark, rows, schema="e int, k string, v string, n int"):
    df = spark.createDataFrame(rows, schema)
    return df, widen(df, ["e"], concept_key("k"), F.col("v"), [F.col("n")], COLUMNS)


def test_pairs_casts_and_failures(spark):
    rows = [
        (1, "X:A", "1.5", 1), (1, "x_a", "2.5", 2), (1, " x:b", "seven", 1), (1, "x:a", None, 9),
        (2, "other", "1", 1), (None, "x:a", "3", 1), (3, None, "4", 1), (2, "x:b", "5", 1), (2, "x:b", "5", 1),
    ]
    _, w = wide(spark, rows)
    got = {r.e: (r.a, r.b, r.cast_failures) for r in w.collect()}
    assert got == {1: (Decimal("2.50"), None, {"b": "seven"}), 2: (None, 5, {}), None: (Decimal("3.00"), None, {}), 3: (None, None, {})}
    cells = {(r.e, r.attribute) for r in empty_cells(w, ["e"], {"a": "A", "b": "B"}).collect()}
    assert cells == {(2, "A"), (None, "B"), (3, "A"), (3, "B")}


def test_empty_table_and_ties(spark):
    assert wide(spark, [])[1].count() == 0
    _, w = wide(spark, [(1, "x:a", "1", 5), (1, "x:a", "1", 5)])
    assert [(r.a, r.b) for r in w.collect()] == [(Decimal("1.00"), None)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x:a", "1", 1, "z", 2)], "e int, k string, v string, n int, `__a` string, a int")
    w = widen(df, ["e"], F.col("k"), F.col("v"), [F.col("n")], COLUMNS)
    assert w.columns == ["e", "a", "b", "cast_failures"] and w.first().a == Decimal("1.00")
