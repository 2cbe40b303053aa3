"""Loading filings: statements to facts, which filings to load, whose they are, and what a load did."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.matching import keep_first
from ..sources.statements import containing, read_statements
from ..sources.tables import table
from .ingest import latest_two, melt_statement, resolve_keys, single_values, unambiguous_members
from .registry import Registry

R = Registry()
#: Metrics that are also loaded by dimension: name -> part of the concept; and the axes.
METRICS = {"Revenue": "revenue", "OperatingIncome": "operatingincome", "CostOfGoods": "costofgoods"}
AXES = {"Product": "productorservice", "Geography": "geograph", "Segment": "segment"}


def load_statements(spark: SparkSession, folder: str, frame: Sequence[str], row_no: str = "row_no") -> DataFrame:
    """All facts of the statements in `folder`; positions and keys are per statement (see `melt_statement`).

    Statements that are optional and hold no usable period are left out like those that cannot be read.
    """
    parts = []
    for name, df in read_statements(spark, folder).items():
        try:
            parts.append(melt_statement(df, name, frame, row_no))
        except ValueError:
            if name in ("Income Statement", "Balance Sheet", "Cash Flow Statement"):
                raise
    return reduce(DataFrame.unionByName, parts)


def valid_facts(facts: DataFrame) -> DataFrame:
    """Facts with `violation`: a fact that is not abstract must have a value."""
    return facts.withColumn("violation", F.when(~F.coalesce("is_abstract", F.lit(False)) & F.col("value").isNull(), "no value"))


def with_ids(new: DataFrame, stored: DataFrame, record: str, order: Sequence[Column]) -> DataFrame:
    """`new` with ids that follow the greatest stored one, in the order of `order`; the same rows get the same ids when a load is repeated.

    Numbers are given in blocks: each of the ranges the rows are sorted into is counted, and a range's rows follow those of the ranges before.
    """
    last = stored.agg(F.coalesce(F.max(record), F.lit(0))).first()[0]
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    inside = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    counts = inside.groupBy("__p").agg(F.count("*").alias("__c"))  # one row per range
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return inside.join(F.broadcast(before), "__p").withColumn(record, (F.col("__b") + F.col("__i") + last).cast("long")).drop("__p", "__i", "__b")


def to_load(wanted: DataFrame, stored: DataFrame, override: bool = False, key: Sequence[str] = ("registry", "number")) -> DataFrame:
    """Wanted filings with what to do: `load` one that is not stored, `replace` a stored one if `override`, else `skip` it. Null keys are loaded."""
    there = stored.select(*key).distinct().withColumn("__there", F.lit(True))
    what = F.when(F.col("__there").isNull(), "load").otherwise("replace" if override else "skip")
    return wanted.join(there, list(key), "left").withColumn("action", what).drop("__there")


def resolve_companies(registrants: DataFrame, tickers: DataFrame) -> DataFrame:
    """registrant, company_id, action, attach: the company of each registrant and the tickers to add to it.

    `registrants` has one row per registrant, exchange and ticker, with `place` giving the order of the exchanges. A registrant is the company that has any of its
    tickers on its first exchange (the least company, if several); without one it is to be created, with all its tickers.
    """
    have = tickers.groupBy(F.upper(F.trim("ticker")).alias("ticker"), "exchange").agg(F.min("company_id").alias("company_id"))
    first = keep_first(registrants.select("registrant", "exchange", "place"), ["registrant"], [F.asc_nulls_last("place"), F.asc("exchange")]).select("registrant", F.col("exchange").alias("first"))
    rows = registrants.select("registrant", F.upper(F.trim("ticker")).alias("ticker"), "exchange").distinct().join(have, ["ticker", "exchange"], "left").join(first, "registrant", "left")
    new = F.when(F.col("company_id").isNull(), F.concat_ws(":", "ticker", "exchange"))
    return rows.groupBy("registrant").agg(
        F.min(F.when(F.col("exchange") == F.col("first"), F.col("company_id"))).alias("company_id"), F.array_join(F.array_sort(F.collect_set(new)), ",").alias("attach")
    ).select("registrant", "company_id", F.when(F.col("company_id").isNull(), "create").otherwise("exists").alias("action"), "attach")


def load_summary(filings: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a load did, per `by`: filings loaded, replaced and skipped, and facts of those that were not skipped. `filings` comes from `to_load`."""
    n = facts.groupBy("filing_id").agg(F.count("*").alias("__n"))
    j = filings.join(n, filings["id"] == n["filing_id"], "left").drop(n["filing_id"])
    count = lambda a: F.count_if(F.col("action") == a)
    return j.groupBy(*by).agg(
        count("load").alias("loaded"), count("replace").alias("replaced"), count("skip").alias("skipped"), F.coalesce(F.sum(F.when(F.col("action") != "skip", F.col("__n"))), F.lit(0)).alias("facts")
    )


def disaggregated(facts: DataFrame, metrics: Mapping[str, str] = METRICS, axes: Mapping[str, str] = AXES, others: Sequence[str] = ()) -> DataFrame:
    """Metrics by dimension: metric, axis, company, member, the newest value and the one before, with their periods.

    Of the facts of a metric and axis, those that a further dimension (`others`) splits go, a member's repeated values of a period stay once if they
    agree and go if they do not, and rows without a value do not count.
    """
    hits = [
        facts.where(containing(c, x) & F.col("value").isNotNull()).withColumns({"metric": F.lit(m), "dimension": F.lit(a)})
        for m, c in metrics.items() for a, x in axes.items()
    ]
    rows = reduce(DataFrame.unionByName, hits).withColumn("__m", F.struct("metric", "dimension", "company_id", "statement", "member"))
    rows = single_values(unambiguous_members(rows, "__m", list(others)), ["__m", "period_end"], "value", [F.asc("id")])
    two = latest_two(rows, "__m", "period_end", "value", [F.asc("id")])
    return two.select("__m.*", "value", "comparative_value", F.col("start").alias("period_end"), F.col("comparative_start").alias("comparative_period_end"))


# -- queries --------------------------------------------------------------------------------------------------------


@R.add("SELECT id, concept, axis FROM financial_facts WHERE lower(concept) LIKE '%revenue%' AND lower(axis) LIKE '%product%'")
def raw_fact_query(spark: SparkSession, root: str) -> DataFrame:
    """Raw facts by parts of concept and axis."""
    return table(spark, root, "financial_facts").where(containing("Revenue", "Product")).select("id", "concept", "axis")


@R.add("""SELECT c.id, c.name, c.industry, string_agg(DISTINCT t.exchange, ',' ORDER BY t.exchange) AS exchanges, string_agg(DISTINCT t.ticker, ',' ORDER BY t.ticker) AS tickers
    FROM companies c LEFT JOIN tickers t ON t.company_id = c.id GROUP BY ALL""")  # fmt: skip
def registry_metadata(spark: SparkSession, root: str) -> DataFrame:
    """What a registry tells about each company: name, industry, exchanges and tickers."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    t = table(spark, root, "tickers").groupBy("company_id").agg(listed("exchange").alias("exchanges"), listed("ticker").alias("tickers"))
    return table(spark, root, "companies").join(t, F.col("id") == F.col("company_id"), "left").select("id", "name", "industry", "exchanges", "tickers")


@R.add("SELECT id, 'no value' AS violation FROM financial_facts WHERE NOT coalesce(is_abstract, false) AND value IS NULL")
def value_invariant(spark: SparkSession, root: str) -> DataFrame:
    """Facts that are not abstract and have no value."""
    return valid_facts(table(spark, root, "financial_facts")).where("violation is not null").select("id", "violation")


_INCOMING = "SELECT * FROM filings WHERE fiscal_year >= 2018"
_STORED = "SELECT * FROM filings WHERE fiscal_year < 2020"


def _planned(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "filings")
    return to_load(f.where("fiscal_year >= 2018"), f.where("fiscal_year < 2020"))


@R.add(f"SELECT id, registry, number, CASE WHEN EXISTS (SELECT 1 FROM ({_STORED}) s WHERE s.registry = w.registry AND s.number = w.number) THEN 'skip' ELSE 'load' END AS action FROM ({_INCOMING}) w")
def filings_to_load(spark: SparkSession, root: str) -> DataFrame:
    """Which filings since 2018 to load where those before 2020 are stored."""
    return _planned(spark, root).select("id", "registry", "number", "action")


@R.add(
    f"""WITH p AS (SELECT id, company_id, EXISTS (SELECT 1 FROM ({_STORED}) s WHERE s.registry = w.registry AND s.number = w.number) AS there FROM ({_INCOMING}) w),
    n AS (SELECT filing_id, count(*) AS n FROM financial_facts GROUP BY 1)
    SELECT company_id, count(*) FILTER (NOT there) AS loaded, 0::BIGINT AS replaced, count(*) FILTER (there) AS skipped, coalesce(sum(n) FILTER (NOT there), 0)::BIGINT AS facts
    FROM p LEFT JOIN n ON n.filing_id = p.id GROUP BY company_id"""
)
def load_counts(spark: SparkSession, root: str) -> DataFrame:
    """What that load does for each company."""
    return load_summary(_planned(spark, root), table(spark, root, "financial_facts"), ["company_id"])


@R.add(
    """WITH r AS (SELECT DISTINCT company_id AS registrant, exchange, upper(trim(ticker)) AS ticker FROM ticker_snapshots WHERE ticker IS NOT NULL AND exchange IS NOT NULL),
    h AS (SELECT upper(trim(ticker)) AS ticker, exchange, min(company_id) AS company_id FROM tickers GROUP BY ALL),
    j AS (SELECT r.*, h.company_id, min(r.exchange) OVER (PARTITION BY registrant) AS first FROM r LEFT JOIN h USING (ticker, exchange))
    SELECT registrant, min(company_id) FILTER (exchange = first) AS company_id, CASE WHEN min(company_id) FILTER (exchange = first) IS NULL THEN 'create' ELSE 'exists' END AS action,
           coalesce(string_agg(DISTINCT ticker || ':' || exchange, ',' ORDER BY ticker || ':' || exchange) FILTER (company_id IS NULL), '') AS attach FROM j GROUP BY registrant"""
)
def company_resolution(spark: SparkSession, root: str) -> DataFrame:
    """The company of every registrant seen in snapshots, by any ticker on its first exchange."""
    s = table(spark, root, "ticker_snapshots").where("ticker is not null and exchange is not null")
    return resolve_companies(s.select(F.col("company_id").alias("registrant"), "exchange", "ticker", F.lit(0).alias("place")), table(spark, root, "tickers"))


@R.add("SELECT number, (SELECT max(id) FROM filings) + row_number() OVER (ORDER BY registry, number, id) AS id FROM filings WHERE fiscal_year >= 2022")
def inserted_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids given to new rows, in the order of their keys."""
    f = table(spark, root, "filings")
    new = f.where("fiscal_year >= 2022").withColumnRenamed("id", "old")
    return with_ids(new, f, "id", [F.col("registry"), F.col("number"), F.col("old")]).select("number", "id")


@R.add(
    """WITH f AS (SELECT 'Revenue' AS metric, 'Product' AS dimension, company_id, statement, member, period_end, value, id FROM financial_facts
          WHERE lower(concept) LIKE '%revenue%' AND lower(axis) LIKE '%product%' AND value IS NOT NULL),
    g AS (SELECT * EXCLUDE (n, rn) FROM (SELECT *, count(DISTINCT value) OVER w AS n, row_number() OVER (w ORDER BY id) AS rn FROM f WINDOW w AS (PARTITION BY company_id, statement, member, period_end)) WHERE n = 1 AND rn = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY company_id, statement, member ORDER BY period_end DESC, id) AS rn FROM g)
    SELECT metric, dimension, company_id, statement, member, max(value) FILTER (rn = 1) AS value, max(value) FILTER (rn = 2) AS comparative_value, max(period_end) FILTER (rn = 1) AS period_end,
           max(period_end) FILTER (rn = 2) AS comparative_period_end FROM t WHERE rn <= 2 GROUP BY ALL"""
)
def disaggregated_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Revenue by product: each member's newest value and the one before."""
    return disaggregated(table(spark, root, "financial_facts"), {"Revenue": "revenue"}, {"Product": "product"})


@R.add("SELECT f.id, g.registry, g.number FROM financial_facts f JOIN filings g ON g.id = f.filing_id WHERE g.form_type ILIKE '%A'")
def facts_by_filing(spark: SparkSession, root: str) -> DataFrame:
    """Facts of the filings that are amendments, by the filing's number."""
    g = table(spark, root, "filings").where("form_type ilike '%A'").select(F.col("id").alias("filing_id"), "registry", "number")
    return table(spark, root, "financial_facts").join(g, "filing_id").select("id", "registry", "number")


@R.add("SELECT id, (SELECT max(p.id) FROM financial_facts p WHERE p.id = f.parent_id AND p.filing_id = f.filing_id) AS parent FROM financial_facts f WHERE f.parent_id IS NOT NULL")
def resolved_parents(spark: SparkSession, root: str) -> DataFrame:
    """Parents of facts within their own filing, by key."""
    f = table(spark, root, "financial_facts")
    name = lambda c: F.concat_ws("|", F.col("filing_id").cast("string"), F.col(c).cast("string"))
    keyed = f.select("id", name("id").alias("key"), F.when(F.col("parent_id").isNotNull(), name("parent_id")).alias("up"))
    return resolve_keys(keyed, "id", "key", {"up": "parent"}).where("up is not null").select("id", "parent")
