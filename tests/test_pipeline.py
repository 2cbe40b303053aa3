"""Authored cases of the pipeline's stages."""

from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import normalization as N
from tallyframe.plans import pipeline_queries
from tallyframe.plans.refresh import refresh
from tallyframe.plans.warehouse import Stages
from tallyframe.sources.store import TableStore

FACT = ("id long, filing_id int, company_id int, form_type string, concept string, label string, is_abstract boolean, value decimal(28,6), comparative_value decimal(28,6), weight decimal(9,4), unit string, "
        "axis string, member string, member_label string, statement string, period_end date, comparative_period_end date, period string, position int, parent_id long, abstract_id long")  # fmt: skip
FILING = "id int, company_id int, form_type string, fiscal_period_end date, fiscal_year int, fiscal_quarter int"
RULE = "company_id int, concept string, statement string, normalized_label string, is_abstract boolean, is_global boolean, description string, unit string, weight decimal(9,4), parent_concept string, abstract_concept string"
DIM = "id int, company_id int, axis string, member string, member_label string, is_global boolean, normalized_axis_label string, normalized_member_label string, tags array<string>, updated_at int"
FRULE = "id long, company_id int, is_global boolean, concept string, statement string, axis string, member string, label string, form_type string, from_period date, to_period date, to_concept string, to_axis string, to_member string, to_member_label string, to_weight double, updated_at long"


def fact(i, filing=1, co=1, form="10-Q", concept="c", value=1, st="Income Statement", end=date(2024, 3, 31), **kw):
    row = dict(id=i, filing_id=filing, company_id=co, form_type=form, concept=concept, label=concept, is_abstract=False, value=None if value is None else D(value), comparative_value=None, weight=D(1), unit="usd", axis="", member="",
               member_label="", statement=st, period_end=end, comparative_period_end=None, period=None, position=i, parent_id=None, abstract_id=None)
    return tuple((row | kw).values())


def stages(spark, facts, filings=(), rules=(), dims=(), frules=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Stages(make(facts, FACT), make(filings, FILING), make(rules, RULE), make(dims, DIM), make(frules, FRULE))


Q = [date(2024, 3, 31), date(2024, 6, 30), date(2024, 9, 30), date(2024, 12, 31)]
FILINGS = [(k + 1, 1, "10-Q" if k < 3 else "10-K", Q[k], 2024, k + 1) for k in range(4)]


def quarters(spark, values, period, ends=Q, st="Income Statement"):
    facts = [fact(k + 1, k + 1, form="10-Q" if k < 3 else "10-K", value=v, end=ends[k], period=period if k < 3 else "YTD", st=st) for k, v in enumerate(values) if v is not None]
    out = stages(spark, facts, FILINGS).stage("quarterly").collect()
    return sorted((str(r.period_end), int(r.value), r.source_type) for r in out)


def test_running_totals_become_quarters(spark):
    assert [v for _, v, _ in quarters(spark, [100, 250, 420, 600], "YTD")] == [100, 150, 170, 180]
    assert [v for _, v, _ in quarters(spark, [10, 20, 30, 100], "Q")] == [10, 20, 30, 40]


def test_gaps_and_missing_quarters(spark):
    assert [(v, s) for _, v, s in quarters(spark, [100, None, 420, None], "YTD")] == [(100, "10-Q"), (420, "10-Q")]
    assert quarters(spark, [None, None, None, 600], "YTD") == []
    assert [(v, s) for _, v, s in quarters(spark, [None, None, None, 600], None, st="Balance Sheet")] == [(600, "10-K")]


def test_sign_follows_the_latest_weight(spark):
    facts = [fact(1, 1, form="10-K", value=5, weight=D(-1), end=date(2022, 12, 31)), fact(2, 2, form="10-K", value=7, end=date(2023, 12, 31))]
    out = stages(spark, facts, [(1, 1, "10-K", date(2022, 12, 31), 2022, 4), (2, 1, "10-K", date(2023, 12, 31), 2023, 4)]).stage("yearly").collect()
    assert sorted((int(r.value), int(r.weight)) for r in out) == [(-5, 1), (7, 1)]


def test_conflicts_and_equal_values(spark):
    facts = [fact(1, value=1), fact(2, value=2), fact(3, value=None), fact(4, concept="d", value=1), fact(5, concept="d", value="1.00")]
    s = stages(spark, facts)
    assert sorted(r.id for r in s.stage("base").collect()) == [4, 5]
    assert sorted((r.id, r.is_duplicate) for r in s.stage("normalized").collect()) == [("4", False), ("5", True)]


def test_labels_group_and_concepts_chain(spark):
    y = [date(2021, 12, 31), date(2022, 12, 31), date(2023, 12, 31)]
    facts = [
        fact(1, 1, concept="a", label="A", value=3, end=y[1]), fact(2, 2, concept="a", label="B", value=4, end=y[2]),
        fact(3, 1, concept="c0", label="Old", value=10, end=y[1]), fact(4, 2, concept="c1", label="New", value=20, comparative_value=D(10), comparative_period_end=y[1], end=y[2]),
        fact(5, 2, concept="n1", label="N", value=9, weight=None, comparative_value=D(8), comparative_period_end=y[1], end=y[2]), fact(6, 1, concept="n0", label="M", value=8, weight=None, end=y[1]),
    ]
    got = {r.concept: (r.normalized_label, r.source) for r in stages(spark, facts).stage("concepts").collect()}
    assert got == {"a": ("B", "grouping"), "c0": ("New", "chaining"), "c1": ("New", "chaining")}
    both = [*facts, fact(7, 2, concept="c0", label="Old", value=11, end=y[2])]
    assert "c1" not in {r.concept for r in stages(spark, both).stage("concepts").collect()}


def test_false_matches_are_dropped(spark):
    rows = [(1, "s", "c1", "c0", 2, 1, "l", "l"), (1, "s", "c0", "c1", 2, 1, "l", "l"), (1, "s", "d1", "d0", 3, 2, "l", "l"), (1, "s", "d1", "d0", 2, 1, "l", "l"), (1, "s", "e1", "e0", 2, 1, "l", "l")]
    df = spark.createDataFrame(rows, "company_id int, statement string, concept1 string, concept2 string, period_end1 int, period_end2 int, label1 string, label2 string")
    assert [r.concept1 for r in N.sound_matches(df).collect()] == ["e1"]


def test_members_of_one_name(spark):
    dim = lambda i, member, label: fact(i, i, axis="x", member=member, member_label=label)
    got = stages(spark, [dim(1, "m:one", "Americas"), dim(2, "americas", "Other"), dim(3, "m:three", "Europe")]).stage("dimensions").collect()
    group = {r.member: r.group_id for r in got}
    assert group["m:one"] == group["americas"] != group["m:three"]


def test_missing_ancestors_and_roll_up(spark):
    rule = lambda c, parent=None, w=1: (0, c, "Income Statement", c.upper(), False, True, None, "usd", D(w), parent, None)
    facts = [fact(1, concept="a", value=10), fact(2, concept="b", value=4, weight=D(-1))]
    s = stages(spark, facts, rules=[rule("a", "p"), rule("b", "p", -1), rule("p", "pp", 2), rule("pp")])
    got = {r.concept: (r.value, r.is_synthetic) for r in s.stage("normalized").collect()}
    assert got == {"a": (10, False), "b": (4, False), "p": (12, True), "pp": (12, True)}
    loop = stages(spark, facts, rules=[rule("a", "p"), rule("p", "q"), rule("q", "p")])
    assert {r.concept: r.value for r in loop.stage("normalized").collect() if r.is_synthetic} == {"p": None, "q": None}


def test_amendments_and_longer_chains_win(spark):
    e = [date(2022, 12, 31), date(2023, 12, 31)]
    facts = [fact(1, 1, form="10-K", value=5), fact(2, 2, form="10-K/A", value=5), fact(3, 1, concept="d", value=7, end=e[0]), fact(4, 2, concept="d", value=9, comparative_value=D(6), comparative_period_end=e[0], end=e[1], label="L"),
             fact(5, 3, concept="d", value=9, comparative_value=D(7), comparative_period_end=e[0], end=e[1], form="10-K", label="d"), fact(6, 3, concept="d", value=3, comparative_value=D(3), comparative_period_end=date(2030, 1, 1), end=date(2030, 1, 1))]
    got = {r.id: r.is_duplicate for r in stages(spark, facts).stage("normalized").collect()}
    assert got["1"] and not got["2"] and not got["6"]


def test_refresh_replaces_companies(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    facts = [fact(k + 1, k + 1, co=1 + (k > 1), form="10-K", concept=f"c{k}", value=k, end=Q[3]) for k in range(4)]
    s = spark.createDataFrame(facts, FACT)
    store.write("financial_facts", s)
    store.write("filings", spark.createDataFrame([(k + 1, 1 + (k > 1), "10-K", Q[3], 2024, 4) for k in range(4)], FILING))
    for name, schema in (("concept_normalization_overrides", RULE), ("dimension_normalization_overrides", DIM), ("financial_facts_overrides", FRULE)):
        store.write(name, spark.createDataFrame([], schema))
    assert refresh(spark, store, []) == []
    refresh(spark, store, [1, 2])
    first = sorted(map(str, store.read("financial_facts_normalized").drop("unit").collect()))
    refresh(spark, store, [2])
    assert sorted(map(str, store.read("financial_facts_normalized").drop("unit").collect())) == first
    store.delete("financial_facts", F.col("company_id") == 2)
    refresh(spark, store, [2])
    assert {r.company_id for r in store.read("financial_facts_normalized").collect()} == {1}
    with pytest.raises(KeyError):
        store.read("nothing")


def test_a_run_of_comparatives_may_be_long(spark):
    day = [date(2020, 1, 1) + timedelta(k) for k in range(230)]
    rows = [(str(k), False, 1, "s", "l", "", "", "c", D(k), day[k], D(k - 1) if k else None, day[k - 1] if k else None) for k in range(230)]
    rows += [("900", False, 1, "s", None, "", "", "c", D(1), day[1], D(0), day[0]), ("901", False, 1, "s", "m", "", "", "c", None, day[0], None, None), ("902", False, 1, "s", "m", "", "", "c", D(5), day[1], D(4), day[0])]
    df = spark.createDataFrame(rows, "id string, is_synthetic boolean, company_id int, statement string, normalized_label string, axis string, member string, concept string, value decimal(28,6), period_end date, comparative_value decimal(28,6), comparative_period_end date")
    got = {r.id: r.chain_size for r in N.chain_sizes(df).collect()}
    assert got == {str(k): 230 for k in range(230)} | {"900": 1, "901": 2, "902": 2}


def test_a_repeated_id_takes_the_rule_of_its_own_concept(spark):
    rule = lambda c: (0, c, "Income Statement", c.upper(), False, True, None, "usd", D(1), None, None)
    facts = [fact(1, concept="a"), fact(1, concept="b"), fact(1, concept="b")]
    got = [(r.concept, r.normalized_label) for r in stages(spark, facts, rules=[rule("a"), rule("b")]).stage("rows").collect()]
    assert sorted(got) == [("a", "A"), ("b", "B")]


def test_missing_ancestors_come_without_the_rows_of_facts(spark, monkeypatch):
    rule = lambda c, parent=None, abstract=None: (0, c, "Income Statement", c.upper(), False, True, None, "usd", D(1), parent, abstract)
    facts = [fact(1, concept="a", axis="x", member="m"), fact(2, concept="a", axis="x", member="n"), fact(3, concept="pp", axis="x", member="m"), fact(4, concept="pp", axis="x", member="n"), fact(5, filing=2, concept="a")]
    s = stages(spark, facts, rules=[rule("a", "p"), rule("p", "pp", "h"), rule("pp"), rule("h", None, "unruled"), rule("b", "p")])
    rows = lambda *_: pytest.fail("a fact stands in a row for each of its links, which nothing here needs")
    monkeypatch.setattr(N, "normalized_rows", rows)
    monkeypatch.setattr(N, "dimensions", rows)
    monkeypatch.setattr(pipeline_queries, "stages", lambda *_: s)
    key = lambda c, filing: f"Income Statement|{c}|{filing}|1"
    got = sorted(((r.id, r.parent_id, r.abstract_id) for r in pipeline_queries.synthetic_ancestors(spark, "").collect()), key=str)
    assert got == sorted([
        (key("p", 1), "3", key("h", 1)), (key("p", 1), "4", key("h", 1)), (key("h", 1), None, key("unruled", 1)),
        (key("p", 2), key("pp", 2), key("h", 2)), (key("h", 2), None, key("unruled", 2)), (key("pp", 2), None, None),
    ], key=str)
