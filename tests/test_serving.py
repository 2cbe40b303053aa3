"""Reads, ingestion, administration, vectors, texts and streams on small cases."""

import os
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.periods import comparative_column, fiscal_quarter, iso_date, period_type_of_column, uuid5
from tallyframe.operators.texts import chunks
from tallyframe.operators.vectors import similar, similar_indexed, similar_to_few
from tallyframe.plans.administration import csv_lines, rule_violation
from tallyframe.plans.ingest import filled_share, latest_two, melt_statement, resolve_keys, single_values, unambiguous_members
from tallyframe.plans.serving import abstract_paths, facts_by_concept_folded, in_reading_order, metric_rows, search_companies, series, similarity_indexed
from tallyframe.sources.store import TableStore, updated
from tallyframe.streaming.arrivals import follow_arrivals

EMBEDDINGS = "/root/testdata/sf0.01"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_periods(spark):
    months = {1: 4, 2: 4, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 3, 10: 3, 11: 3, 12: 4}
    assert {m: one(spark, fiscal_quarter(F.lit(date(2024, m, 28)))) for m in months} == months
    assert [one(spark, fiscal_quarter(iso_date(F.lit(x)))) for x in (None, "", "invalid-date", "2024-03-31T00:00:00")] == [None, None, None, 1]
    cases = {"": None, "Some Random Text": None, "Q1": None, "2024/03/31 (Q1)": None, "03-31-2024 (Q1)": None, "2024-03-31 (Q1)": "Q", "2024-06-30 Q2": "Q", "2024-12-31": "YTD", "2024-12-31 (YTD)": "YTD", "Q3 2024-09-30": "Q"}
    assert {c: one(spark, period_type_of_column(F.lit(c), F.lit("Income Statement"))) for c in cases} == cases
    assert one(spark, period_type_of_column(F.lit("2024-03-31 (Q1)"), F.lit("Balance Sheet"))) is None
    cols = ["2024-03-31 (Q1)", "2024-03-31", "2023-03-31 (Q1)", "2023-12-31"]
    assert [comparative_column(cols, c) for c in (cols[0], cols[1], "x y z")] == ["2023-03-31 (Q1)", "2023-12-31", None]
    assert one(spark, uuid5(F.lit("us-gaap:Revenues|Ünï|2024"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, "us-gaap:Revenues|Ünï|2024"))


def test_melt(spark):
    rows = [
        (1, 0, "us-gaap_Top", "Top [Abstract]", True, None, None, None, None, None, None, None, ""), (1, 1, "us-gaap_Head", "Head", True, None, None, None, None, None, None, None, ""),
        (1, 2, "us-gaap_Revenues", "Revenues", False, "1000000", "500000", None, False, None, None, None, ""), (1, 3, "us-gaap_Bad", "Bad", False, "invalid", "1", None, False, None, None, None, ""),
        (1, 4, "us-gaap_Revenues", "iPhone - Pro", False, "7", None, None, True, "srt:Axis", "a_iPhone", "iPhone", ""), (1, 5, "us-gaap_Net", "Net", False, "3", "2", "us-gaap_Revenues", False, None, None, None, ""), (1, 6, "", "none", False, "1", "1", None, False, None, None, None, ""),
    ]
    schema = "f int, n int, concept string, label string, abstract boolean, `2024-03-31 (Q1)` string, `2023-03-31 (Q1)` string, parent_concept string, dimension boolean, dimension_axis string, dimension_member string, dimension_member_label string, `2025-01-01 (Q1)` string"
    got = {(r.concept, r.axis): r for r in melt_statement(spark.createDataFrame(rows, schema), "Income Statement", ["f"], "n").collect()}
    assert set(got) == {("us-gaap:Head", ""), ("us-gaap:Revenues", ""), ("us-gaap:Net", ""), ("us-gaap:Revenues", "srt:Axis")}
    r, d, n = got["us-gaap:Revenues", ""], got["us-gaap:Revenues", "srt:Axis"], got["us-gaap:Net", ""]
    assert (r.value, r.comparative_value, r.position, str(r.period_end), str(r.comparative_period_end), r.period) == (1000000, 500000, 1, "2024-03-31", "2023-03-31", "Q")
    assert (d.label, d.member, d.member_label, d.position, d.parent_key) == ("Revenues", "Pro", "Pro", None, None) and n.parent_key == r.key and n.position == 2


def test_frames(spark):
    df = spark.createDataFrame([(1, 2, None, "1"), (2, None, None, ""), (3, None, None, "")], "good int, mostly int, empty int, texts string")
    assert {c: round(s) for c, s in filled_share(df, ["good", "mostly", "empty", "texts", "none"]).items()} == {"good": 100, "mostly": 33, "empty": 0, "texts": 33, "none": 0}
    m = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", None, 3), ("b", "x", 4), ("b", None, 4)], "m string, o string, v int")
    assert sorted(r.v for r in unambiguous_members(m, "m", ["o"]).collect()) == [3, 4, 4]
    assert [(r.m, r.v) for r in single_values(m, ["m"], "v", [F.asc("v")]).collect()] == [("b", 4)]
    t = latest_two(m.where("m = 'a'"), "m", "v", "o", [F.asc("o")]).first()
    assert (t.value, t.comparative_value, t.start) == (None, "y", 3)
    k = spark.createDataFrame([(1, "p", "h"), (2, "h", None), (3, "h", None), (4, "x", "nothing")], "id int, key string, parent string")
    assert {r.id: r.parent_id for r in resolve_keys(k, "id", "key", {"parent": "parent_id"}).collect()} == {1: 3, 2: None, 3: None, 4: None}


def test_series_paths_and_filters(spark):
    rows = [(1, 7, "Top", "T", None, True, None, 0, date(2024, 3, 31), None), (2, 7, "Mid", None, 1, False, 5, 1, date(2024, 3, 31), None), (3, 7, "Leaf", "L", 2, False, 6, None, date(2024, 3, 31), "usd"), (4, 7, "Leaf", "L", 9, False, 8, 2, date(2023, 3, 31), "eur"), (5, 7, "Self", "S", 5, True, None, 3, date(2024, 3, 31), None)]
    df = spark.createDataFrame(rows, "id long, company_id int, label string, normalized_label string, abstract_id long, is_abstract boolean, value int, position int, period_end date, unit string").selectExpr(
        "*", "concat('c', id) as concept", "'IS' as statement", "'' as axis", "'' as member", "1 as weight", "2024 as fiscal_year", "1 as fiscal_quarter", "'10-Q' as source_type", "false as is_synthetic")
    p = {r.id: (r.abstracts, r.abstract_concepts) for r in abstract_paths(df).collect()}
    assert p == {1: ([], []), 2: (["T"], ["c1"]), 3: (["T"], ["c1"]), 4: ([], []), 5: (["S"], ["c5"])}
    s = {r.normalized_label: r for r in series(df).collect()}
    assert [v.value for v in s["L"]["values"]] == [8, 6] and s["L"].unit == "eur"
    assert [r.id for r in in_reading_order(df).collect()] == [1, 2, 4, 5, 3]
    assert sorted(r.id for r in metric_rows(df, companies=[7], labels=["LEA"], years=(2024, None)).collect()) == [3, 4]
    with pytest.raises(ValueError):
        metric_rows(df, quarters=(0, None))


def test_search(spark):
    c = spark.createDataFrame([(1, "Apple Inc."), (2, "Microsoft Corp."), (3, "100% Apple_Pie")], "id int, name string")
    t = spark.createDataFrame([("MSFT", 2), ("AAPL", 1), ("APX", 2), ("PIE", 3)], "ticker string, company_id int")
    find = lambda p, n=20: [(r.company_id, r.ticker) for r in search_companies(c, t, p, n).collect()]
    assert find("ap") == [(1, "AAPL"), (2, "APX")] and find("100%") == [(3, "PIE")] and find("  ") == [] and find("_") == [] and len(find("ap", 0)) == 1


def test_newest_facts_in_any_spelling(spark, tmp_path):
    names = ["core-fin:NetRevenue", "CORE-FIN:NETREVENUE", "core-fin_NetRevenue", " core-fin: NetRevenue\u00a0", "core-fin:NetProfit"]
    f = [(i, 1, i, names[i % 5], i, "10-Q") for i in range(1, 21)]
    g = [(i, date(2024, 1, i), "10-Q") for i in range(1, 21)]
    spark.createDataFrame(f, "id long, company_id int, filing_id long, concept string, value int, form_type string").write.parquet(str(tmp_path / "financial_facts.parquet"))
    spark.createDataFrame(g, "id long, filing_date date, form_type string").write.parquet(str(tmp_path / "filings.parquet"))
    assert sorted(r.id for r in facts_by_concept_folded(spark, str(tmp_path)).collect()) == [8, 10, 11, 12, 13, 15, 16, 17, 18, 20]


def test_rules_and_csv(spark):
    rows = [(0, "p", True, "w", "u", True), (0, "p", False, None, "u", True), (0, None, False, None, None, True), (0, None, True, "w", None, True), (0, None, True, None, "u", True), (5, None, False, None, "u", True), (5, "p", False, "w", "u", False), (0, None, True, None, None, True)]
    df = spark.createDataFrame(rows, "company_id int, parent_concept string, is_abstract boolean, weight string, unit string, is_global boolean")
    assert [r.v for r in df.select(rule_violation().alias("v")).collect()] == ["parent and abstract", "parent without weight", "no unit", "abstract with weight", "abstract with unit", "global flag", None, None]
    t = spark.createDataFrame([("", None, 'a "b", c', ["x", "y"])], "a string, b string, c string, d array<string>")
    assert t.select(csv_lines(t, ["a", "b", "c", "d"]).alias("l")).first().l == '__EMPTY__,,"a ""b"", c",x;y'
    assert updated(t, F.lit(True), {"a": "z", "b": None}).first().a == "z"


def test_vectors(spark):
    import numpy as np

    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * r.normal(size=16)).tolist()) for i in range(400)] + [(900, None), (901, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id % 20 = 0")
    exact = {(x.query_id, x.row_id) for x in similar(df, q, "id", "id", "v", 5).collect()}
    fast = {(x.query_id, x.row_id) for x in similar_indexed(df, q, "id", "id", "v", 5, 16).collect()}
    m = np.array([v for _, v in rows[:400]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert exact == {(i, int(j)) for i in range(0, 400, 20) for j in np.argsort(-(m @ m[i]), kind="stable")[:5]}
    assert len(exact & fast) >= 0.9 * len(exact)


@pytest.mark.skipif(not os.path.isdir(EMBEDDINGS), reason="no test tables")
def test_recall_of_the_index(spark):
    """Over the query's own table, without the query itself, which is always found."""
    import numpy as np

    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{EMBEDDINGS}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    exact = {(int(ids[q]), int(ids[j])) for q in np.flatnonzero(ids % 20 == 0) for j in np.argsort(-(m @ m[q]), kind="stable")[:5] if j != q}
    found = [(r.query_id, r.row_id) for r in similarity_indexed(spark, EMBEDDINGS).collect()]
    assert len(found) == len(set(found)) == 5 * sum(ids % 20 == 0)
    assert len(exact & set(found)) > 0.93 * len(exact)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "One two. Three four! Five six? " * 30), (2, None), (3, " "), (4, "x" * 250)], "id int, t string")
    got = chunks(df, "id", "t", 100, 10).collect()
    assert all(0 < len(r.chunk) <= 111 for r in got) and {r.id for r in got} == {1, 4}
    assert "".join(r.chunk[-100:] for r in got if r.id == 4).count("x") >= 250


def test_arrivals(spark, tmp_path):
    store, seen = TableStore(spark, str(tmp_path / "s")), []
    new = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (2, 8, "b")], "id long, company_id int, x string")
    store.write("financial_facts", new.limit(0))
    for part in (new, new.withColumn("x", F.lit("c")).where("id = 1")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = follow_arrivals(spark, str(tmp_path / "in"), new.schema, store, str(tmp_path / "ck"), then=lambda s, st, c: seen.append(c))
        q.awaitTermination(60)
    assert seen == [[7, 8], [7]] and sorted((r.id, r.x) for r in store.read("financial_facts").collect()) == [(1, "c"), (2, "b")]
    store.update("financial_facts", F.col("id") == 1, {"x": "d"})
    store.upsert("financial_facts", new.where("id = 2").distinct().withColumn("x", F.lit("e")), ["id"])
    store.replace_companies("financial_facts", new.limit(0), [7])
    assert [(r.id, r.x) for r in store.read("financial_facts").collect()] == [(2, "e")]


def test_few_queries_meet_all_rows_as_pairs_do(spark):
    df = spark.createDataFrame([(i, [float((i * k) % 7 - 3) for k in range(1, 6)]) for i in range(60)] + [(90, None), (91, []), (92, [0.0] * 5), (93, [1.0, None, 1.0, 1.0, 1.0]), (94, [1.0, 2.0])], "id int, v array<double>")
    for q in (df.where("id % 9 = 0 or id > 90"), df.where("id < 0")):
        args = (df, q, "id", "id", "v", 3)
        assert sorted(similar_to_few(*args).collect()) == sorted(similar(*args).collect())
