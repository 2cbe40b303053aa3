import random
from datetime import date

from pyspark.sql import functions as F

from tallyframe.operators.graphs import components, follow
from tallyframe.operators.matching import best_match, drop_ambiguous, keep_first, value_matches


def test_keep_first_and_ambiguity(spark):
    rows = [(1, "a", 5), (2, "a", 5), (3, None, 1), (4, None, 2), (5, "b", None), (6, "b", 3), (7, "c", 1)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    assert {r.id for r in keep_first(df, ["k"], [F.desc("id")]).collect()} == {2, 4, 6, 7}
    assert {r.id for r in drop_ambiguous(df, ["k"], "v").collect()} == {1, 2, 5, 6, 7}
    assert drop_ambiguous(df.limit(0), ["k"], "v").count() == 0


def test_rule_ranking(spark):
    facts = spark.createDataFrame([(1, 5, "c", "x", date(2020, 3, 31)), (2, 6, "c", "", date(2020, 3, 31)), (3, 7, None, "x", date(2020, 3, 31)), (4, 5, "c", "y", date(2020, 3, 31))], "id int, company_id int, concept string, axis string, period_end date")
    rules = spark.createDataFrame(
        [(10, 0, True, "c", None, 1), (11, 5, False, "c", None, 1), (12, 5, False, "c", "x", 1), (13, 5, False, "c", "x", 2), (14, 0, True, "c", "", 1), (15, 9, False, "c", None, 9)],
        "id int, company_id int, is_global boolean, concept string, axis string, updated_at int",
    )
    fits = F.col("r.axis").isNull() | (F.col("r.axis") == F.col("l.axis"))
    rank = [F.col("r.axis").isNotNull(), F.col("r.updated_at"), -F.col("r.id")]
    got = best_match(facts, "id", rules, ["concept"], "company_id", F.col("is_global"), fits, rank)
    assert {r.id: r.rule.id for r in got.collect()} == {1: 13, 2: 14, 4: 11}


def test_value_matches(spark):
    rows = [(1, "new", 20, 10, 2), (2, "old", 10, None, 1), (3, "old", None, 10, 1), (4, "new", 10, 10, 1)]
    df = spark.createDataFrame(rows, "id int, c string, v int, cv int, p int").withColumn("cp", F.col("p") - 1)
    got = value_matches(
        df.withColumn("g", F.lit(1)), df.withColumn("g", F.lit(1)), ["g"], ("cv", "v"), ("cp", "p"), F.col("n.c") != F.col("o.c")
    ).collect()
    assert {(r.n.id, r.o.id) for r in got} == {(1, 2)}


def test_components_against_union_find(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(80)] + [(600, 600), (None, 5)]
    boss = {}

    def find(x):
        while boss.setdefault(x, x) != x:
            x = boss[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            boss[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {n.node: n.component for n in got} == {x: find(x) for x in list(boss)}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_follow_ends_on_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    start = spark.createDataFrame([(1,)], "at int")
    got = follow(start, lambda e: e.join(links, F.col("at") == F.col("a")).select(F.col("b").alias("at")))
    assert sorted(r.at for r in got.collect()) == [1, 2, 3, 4]
