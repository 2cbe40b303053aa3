"""Statement files, loading, retrieval and store maintenance on small cases."""

import pytest
from pyspark.sql import functions as F

from tallyframe.plans.loading import load_statements, resolve_companies, to_load, valid_facts, with_ids
from tallyframe.plans.refresh import refresh_report
from tallyframe.plans.retrieval import NOTHING, add_documents, answer, clear_documents, retrieve
from tallyframe.sources.statements import file_name, read_statements
from tallyframe.sources.store import TableStore

LINES = "filing int, row_no int, concept string, label string, abstract boolean, `2024-03-31 (Q1)` string, `2023-03-31 (Q1)` string"


def test_statement_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "x_Sales", "Sales", False, "5", "4"), (1, 1, "x_Cost", "Cost", False, "2", None)], LINES)
    for name in ("Income Statement", "Balance Sheet"):
        df.write.parquet(f"{tmp_path}/{file_name(name)}.parquet")
    with pytest.raises(FileNotFoundError):
        read_statements(spark, str(tmp_path))
    df.write.json(f"{tmp_path}/{file_name('Cash Flow Statement')}.json")
    assert list(read_statements(spark, str(tmp_path))) == ["Income Statement", "Balance Sheet", "Cash Flow Statement"]
    spark.createDataFrame([(1, 0, "x", "X", False)], "filing int, row_no int, concept string, label string, abstract boolean").write.parquet(f"{tmp_path}/{file_name('Statement of Equity')}.parquet")
    facts = load_statements(spark, str(tmp_path), ["filing"]).collect()
    assert len(facts) == 6 and {f.statement for f in facts} == {"Income Statement", "Balance Sheet", "Cash Flow Statement"} and {f.period for f in facts} == {"Q", None}


def test_what_to_load(spark):
    stored = spark.createDataFrame([("sec", "1")], "registry string, number string")
    wanted = spark.createDataFrame([(1, "sec", "1"), (2, "sec", "2"), (3, None, "1")], "id int, registry string, number string")
    for override, want in ((False, "skip"), (True, "replace")):
        assert {r.id: r.action for r in to_load(wanted, stored, override).collect()} == {1: want, 2: "load", 3: "load"}
    rows = spark.createDataFrame([(1, False, 1), (2, False, None), (3, True, None), (4, None, None)], "id int, is_abstract boolean, value int")
    assert {r.id for r in valid_facts(rows).where("violation is not null").collect()} == {2, 4}
    given = with_ids(spark.range(50).select(F.col("id").alias("k")), spark.createDataFrame([(7,)], "id long"), "id", [F.desc("k")]).collect()
    assert {r.k: r.id for r in given} == {k: 8 + 49 - k for k in range(50)}


def test_companies_of_registrants(spark):
    tickers = spark.createDataFrame([("AAA", "X", 5), ("BBB", "X", 4), ("CCC", "Y", 9)], "ticker string, exchange string, company_id int")
    seen = [(1, "X", "aaa ", 0), (1, "X", "bbb", 0), (1, "Y", "new", 1), (2, "X", "zzz", 0), (2, "Y", "ccc", 1)]
    got = resolve_companies(spark.createDataFrame(seen, "registrant int, exchange string, ticker string, place int"), tickers).collect()
    assert {(r.registrant, r.company_id, r.action, r.attach) for r in got} == {(1, 4, "exists", "NEW:Y"), (2, None, "create", "ZZZ:X")}


def test_retrieval(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "Copper prices rose. Mines opened."), (2, "Ferry tickets sold out."), (3, None), (4, "")], "doc_id long, text string")
    add_documents(store, docs)
    add_documents(store, docs.where("doc_id = 1"))
    stored = store.read("chunks")
    assert stored.count() == 2
    asked = spark.createDataFrame([(7, "why did copper prices rise"), (8, "")], "id int, question string")
    assert [(r.query_id, r.row_id) for r in retrieve(stored, asked, "id", "question", 1).collect()] == [(7, "1#0")]
    assert answer(spark, stored, "copper prices", lambda q, found: found[0], 1).startswith("Copper")
    assert answer(spark, stored, "copper", lambda q, found: 1 / 0, 1) == "Error: division by zero"
    clear_documents(store)
    assert answer(spark, store.read("chunks"), "copper", lambda q, found: "", 1) == NOTHING


def test_store_upkeep(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("parents", spark.createDataFrame([(1, None), (2, None)], "id int, updated_at timestamp"))
    store.write("children", spark.createDataFrame([(9, 1)], "id int, parent int"))
    store.update("parents", F.col("id") == 2, {})
    with pytest.raises(ValueError):
        store.delete_unreferenced("parents", F.col("id") == 1, "id", {"children": "parent", "absent": "parent"})
    with pytest.raises(KeyError):
        store.delete_unreferenced("parents", F.col("id") == 3, "id", {})
    store.delete_unreferenced("parents", F.col("id") == 2, "id", {"children": "parent"})
    assert store.clean("parents") == 2 and [r.id for r in store.read("parents").collect()] == [1] and store.clean("nothing") == 0
    assert refresh_report(spark, store)["error"].startswith("KeyError")


def test_financials_read(spark):
    from tallyframe.plans.serving import financials

    cols = "id long, company_id int, label string, normalized_label string, statement string, axis string, member string, value decimal(28,6), weight double, unit string, position int, period_end date, fiscal_year int, fiscal_quarter int, is_abstract boolean, is_synthetic boolean, source_type string, concept string, abstract_id long"
    base = ("Income Statement", "", "")
    rows = spark.createDataFrame([], cols)
    for i, (label, q, value, abstract) in enumerate([("Tax paid", 1, 5, False), ("Tax paid", 2, 6, False), ("Cash", 2, None, False), ("Head", 2, None, True)]):
        rows = rows.unionByName(spark.sql(f"select {i}L id, 1 company_id, '{label}' label, '{label}' normalized_label, '{base[0]}' statement, '' axis, '' member, cast({'null' if value is None else value} as decimal(28,6)) value, 1d weight, 'usd' unit, {i} position, date'2024-0{q}-01' period_end, 2024 fiscal_year, {q} fiscal_quarter, {abstract} is_abstract, false is_synthetic, '10-Q' source_type, 'c' concept, 3L abstract_id"))
    got = financials(rows, labels="tax;none").collect()
    assert [(g.normalized_label, [v.value for v in g["values"]], g["values"][0].label) for g in got] == [("Tax paid", [5.0, 6.0], "Tax paid")]
    assert financials(rows, form="short").first()["values"][0].asDict().keys() == {"value", "period_end"}
    assert financials(rows, form="debug").first()["values"][0].abstract_concepts == ["c"]
    for bad in ({"granularity": "daily"}, {"granularity": "yearly", "quarters": (1, 2)}, {"quarters": (0, 4)}, {"form": "long"}):
        with pytest.raises(ValueError):
            financials(rows, **bad)


def test_rules_out_and_in_again(spark):
    from tallyframe.operators.rejects import load_records
    from tallyframe.plans.administration import CONCEPT_HEADER, RULE_FILES, export_csv, import_rules, imported, rule_violation
    from tallyframe.plans.curation import RECORD_KINDS

    kinds = "company_id int, concept string, statement string, normalized_label string, is_abstract boolean, is_global boolean, abstract_concept string, parent_concept string, description string, unit string, weight double, updated_at timestamp"
    old = spark.createDataFrame([(1, 'a"b', "IS", "A, or B", False, False, None, None, "", "usd", 1.0, None), (2, "h", "BS", "H", True, False, None, None, "two\\nlines", None, None, None)], kinds)
    name, lines = export_csv(old, "concept-normalization-overrides", [1])
    assert name == "concept-normalization-overrides-1.csv" and lines.count() == 2
    _, lines = export_csv(old, "concept-normalization-overrides")
    text = [r.line for r in lines.orderBy(F.asc_nulls_first("company_id"), "line_no").collect()] + ["1,c,IS,C,no,no,,,,usd,1", "1,,IS,C,no,no,,,,usd,1", "3,d,IS,D,no,no,,p,,usd,", "1,e,IS"]
    raw = spark.createDataFrame([(i, "f", i, t) for i, t in enumerate(text, 1)], "n int, file string, no int, line string")
    key = RULE_FILES["concept-normalization-overrides"][1]
    records = load_records(raw, "n", ["file"], "no", "line", RECORD_KINDS, CONCEPT_HEADER)
    judged = import_rules(records, old, key, "n", check=rule_violation()).cache()
    assert {r.row_no: (r.outcome, r.message) for r in judged.collect()} == {
        2: ("updated", None), 3: ("updated", None), 4: ("created", None), 5: ("error", "concept is missing"), 6: ("error", "parent without weight"), 7: ("error", "columns"),
    }
    assert {r.outcome for r in import_rules(records, old, key, "n", update_existing=False).where("row_no < 4").collect()} == {"skipped"}
    new = imported(old, judged, key)
    assert new.drop("updated_at").exceptAll(old.drop("updated_at")).count() == 1 and new.count() == 3 and new.where("updated_at is null").count() == 0
