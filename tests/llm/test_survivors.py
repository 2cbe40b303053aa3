import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.survivors import Bundle, branching, build_survivors, choose_bundles

SCHEMA = "id long, g string, a int, b int, c int, u string, t int, `__n` int, e int"


def bundles(points=False):
    worth = (lambda c: c) if points else (lambda c: None)
    return {
        "first": Bundle(["a", "u"], F.col("a").isNotNull(), [F.col("t"), F.col("a")], worth(F.coalesce("t", F.lit(0)) * 2 + F.col("a"))),
        "second": Bundle(["b"], F.col("b").isNotNull(), [F.col("t"), F.col("b")], worth(F.col("b") + 1)),
        "third": Bundle(["c"], F.col("c").isNotNull(), [F.col("c")], worth(F.col("c") * 2)),
    }


def brute(rows, points=False):
    """Try every combination of whole bundles of a group."""
    groups, out = {}, {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    less = lambda x: (x is not None, x if x is not None else 0)
    worth = (lambda x, y, z: ((x[6] or 0) * 2 + x[2], y[3] + 1 if y else 0, z[4] * 2 if z else 0)) if points else (lambda *_: (0, 0, 0))
    for g, rs in groups.items():
        if len(rs) < 2:
            continue
        best = None
        for x, y, z in itertools.product([r for r in rs if r[2] is not None], [None, *[r for r in rs if r[3] is not None]], [None, *[r for r in rs if r[4] is not None]]):
            if any(len({r[k] for r in (x, y, z) if r is not None and r[k] is not None}) > 1 for k in (5, 8)):
                continue
            p = worth(x, y, z)
            score = (sum(p), (p[0], less(x[6]), x[2], -x[0]), (y is not None, y and (p[1], less(y[6]), y[3], -y[0])), (z is not None, z and (p[2], z[4], -z[0])))
            if best is None or score > best[0]:
                best = (score, tuple(r and r[0] for r in (x, y, z)))
        if best:
            out[g] = best[1]
    return out


@pytest.mark.parametrize(("seed", "points"), [(0, False), (1, True), (2, False), (3, True), (4, True)])
def test_against_brute_force(spark, seed, points):
    r = random.Random(seed)
    some = lambda n: r.choice([None, *range(n)])
    rows = [(i, r.choice([None, *"abcdefghijklm"]), some(3), some(3), some(3), r.choice([None, "x", "y", "z"]), some(2), 1, r.choice([None, 0, 1])) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = choose_bundles(df, ["g"], "id", bundles(points), [F.col("u"), F.col("e")])
    assert {x.g: (x.first, x.second, x.third) for x in got.select("g", "first", "second", "third").collect()} == brute(rows, points)
    n = branching(df, ["g"], "id", bundles(points), [F.col("u"), F.col("e")]).first()
    assert n.groups == len(brute(rows, points)) and n.branching > 5


def test_planted_groups_branch_and_trade_off(spark):
    """Groups whose most trusted bundles disagree in unit: a lesser measure with a comparison outweighs a greater one without."""
    rows = []
    for i in range(40):
        g = f"g{i}"
        rows += [(10 * i, g, 2, None, None, "usd", 1, 0, 0), (10 * i + 1, g, 1, 2, 2, "eur", 1, 0, 0), (10 * i + 2, g, 0, 1, None, "usd", 0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for points, want in ((False, (0, 2, None)), (True, (1, 1, 1))):
        got = choose_bundles(df, ["g"], "id", bundles(points), [F.col("u")]).collect()
        assert {(int(x.g[1:]), x.first, x.second, x.third) for x in got} == {(i, 10 * i + want[0], 10 * i + want[1], None if want[2] is None else 10 * i + want[2]) for i in range(40)}
        assert branching(df, ["g"], "id", bundles(points), [F.col("u")]).first().branching == 40


def test_whole_bundles_ties_and_empty(spark):
    rows = [(5, "g", 1, None, None, "x", 1, 0), (3, "g", 1, None, 7, "x", 1, 0), (4, "g", None, 2, None, "y", 9, 0), (9, "h", None, 1, 1, None, 1, 0), (8, "h", None, 1, 1, None, 1, 0), (1, "alone", 1, 1, 1, "x", 1, 0)]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    chosen = choose_bundles(df, ["g"], "id", bundles(), [F.col("u")])
    built = build_survivors(df, chosen, "id", bundles(), ["g"]).collect()
    assert [(x.g, x.first, x.second, x.third, x.a, x.u, x.b, x.c) for x in built] == [("g", 3, None, 3, 1, "x", None, 7)]
    assert choose_bundles(df.limit(0), ["g"], "id", bundles(), [F.col("u")]).count() == 0
