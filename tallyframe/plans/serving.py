"""Reads over the derived tables: filtered series, label counts, latest metrics, hierarchy paths, company search, retrieval."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.matching import keep_first
from ..operators.texts import begins_with, chunks
from ..operators.vectors import similar, similar_indexed
from ..session import cut, gathered, small
from ..sources.tables import table
from .curation import SQL_KEY
from .registry import Registry
from .warehouse import facts, filings

R = Registry()


def metric_rows(
    df: DataFrame, companies: Sequence[int] | None = None, years: tuple[int | None, int | None] = (None, None), quarters: tuple[int | None, int | None] = (None, None),
    labels: Sequence[str] | None = None, normalized_labels: Sequence[str] | None = None, statement: str | None = None, axis: str | None = None,
) -> DataFrame:
    """Series rows by optional filters: bounds are inclusive, `labels` match anywhere and letter case aside (% and _ are wildcards).

    Label filters leave out abstract rows; without an axis only undimensioned rows are returned. Bad bounds raise ValueError.
    """
    if any(q is not None and not 1 <= q <= 4 for q in quarters):
        raise ValueError("quarters are 1 to 4")
    keep = [F.col("axis") == (axis or "")]
    if companies is not None:
        keep.append(F.col("company_id").isin(list(companies)))
    for c, (lo, hi) in (("fiscal_year", years), ("fiscal_quarter", quarters)):
        keep += [F.col(c) >= lo] * (lo is not None) + [F.col(c) <= hi] * (hi is not None)
    if labels is not None:
        keep += [reduce(lambda a, b: a | b, [F.col("label").ilike(f"%{x}%") for x in labels], F.lit(False)), ~F.col("is_abstract")]
    if normalized_labels is not None:
        keep += [F.col("normalized_label").isin(list(normalized_labels)), ~F.col("is_abstract")]
    if statement is not None:
        keep.append(F.col("statement") == statement)
    return df.where(reduce(lambda a, b: a & b, keep))


def in_reading_order(df: DataFrame) -> DataFrame:
    """Rows by company, statement, position (those without one last) and newest period first."""
    return df.orderBy("company_id", "statement", F.asc_nulls_last("position"), F.desc("period_end"), "id")


def abstract_paths(rows: DataFrame, hops: int = 50) -> DataFrame:
    """id and the labels and concepts of the abstract rows above each row, outermost first.

    The walk follows abstract_id among `rows` for at most `hops` links; it ends at a missing row or where it would meet a row
    again. Only abstract rows are listed; a label is the normalized label or else the label. Of rows with one id the least by its fields holds.

    The pieces of path double in every round, so `hops` links take log2(hops) rounds, and a row whose walk has ended joins no more.
    """
    field = F.struct(F.col("id"), F.col("is_abstract").alias("a"), F.coalesce("normalized_label", "label").alias("l"), F.col("concept").alias("c"))
    nodes = cut(rows.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("abstract_id").alias("up"), field.alias("own"))).alias("n")))
    own = nodes.select(F.col("id").alias("at"), F.col("n.own").alias("own"))
    state = nodes.select("id", F.col("n.up").alias("next")).join(own, F.col("next") == F.col("at"), "left")
    # `next` is the row the piece ends at; a link to no row ends the walk
    state = cut(state.select("id", F.when(F.col("own").isNotNull(), F.col("next")).alias("next"), F.array_compact(F.array("own")).alias("above")))
    ended = []
    length = 1
    while length < hops:
        ended.append(state.where("next is null"))
        going = state.where("next is not null")
        if going.isEmpty():
            break
        there = reduce(DataFrame.unionByName, [*ended, going]).select(F.col("id").alias("at"), F.col("next").alias("far"), F.col("above").alias("more"))
        state = cut(gathered(going).join(gathered(there), F.col("next") == F.col("at")).select("id", F.col("far").alias("next"), F.concat("above", "more").alias("above")))
        length *= 2
    else:
        ended.append(state)
    walked = gathered(reduce(DataFrame.unionByName, ended)).withColumn("above", F.slice("above", 1, hops))
    # links lead from each row to one: what comes after the first row met again has been met too
    ids = F.transform("above", lambda x: x["id"])
    path = F.reverse(F.filter("above", lambda x, i: (F.array_position(ids, x["id"]) == i + 1) & x["a"]))
    walked = walked.withColumn("path", path)
    return walked.select("id", F.filter(F.col("path.l"), lambda x: x.isNotNull()).alias("abstracts"), F.filter(F.col("path.c"), lambda x: x.isNotNull()).alias("abstract_concepts"))


def series(rows: DataFrame) -> DataFrame:
    """One row per (company, normalized label, statement, axis, member): the first row's weight and unit, and all values in reading order."""
    key = ["company_id", "normalized_label", "statement", "axis", "member"]
    at = F.struct(F.coalesce("position", F.lit(2**31 - 1)).alias("p"), (-F.datediff("period_end", F.lit("1900-01-01"))).alias("d"), F.col("id"))
    return rows.where("not is_abstract and value is not null").groupBy(*key).agg(
        F.min_by("weight", at).alias("weight"), F.min_by("unit", at).alias("unit"),
        F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), "label", "value", "fiscal_year", "fiscal_quarter", "period_end", "source_type", "is_synthetic"))), lambda s: s.dropFields("at")).alias("values"),
    )


def financials(
    rows: DataFrame, granularity: str = "quarterly", labels: str | None = None, normalized_labels: str | None = None, years: tuple[int | None, int | None] = (None, None),
    quarters: tuple[int | None, int | None] = (None, None), companies: Sequence[int] | None = None, statement: str | None = None, axis: str | None = None, form: str = "full",
) -> DataFrame:
    """Metric series of a quarterly or yearly table, as the financials read gives them.

    `labels` and `normalized_labels` are lists parted by `;`. Quarters may only be given for quarterly rows; a wrong granularity, form or bound raises ValueError.
    `form` is `full`, `short` (values without label and fiscal fields) or `debug` (full, with concept, source, whether a value is made up, and the concepts above it).
    Values come in reading order: by position (those without one last), the newest period first.
    """
    if granularity not in ("quarterly", "yearly"):
        raise ValueError("granularity is quarterly or yearly")
    if form not in ("full", "short", "debug"):
        raise ValueError("form is full, short or debug")
    if granularity == "yearly" and quarters != (None, None):
        raise ValueError("quarters belong to quarterly rows")
    parts = lambda s: None if s is None else [x.strip() for x in s.split(";") if x.strip()]
    found = metric_rows(rows, companies, years, quarters, parts(labels), parts(normalized_labels), statement, axis).where("not is_abstract and value is not null")
    key = ["company_id", "normalized_label", "statement", "axis", "member"]
    at = F.struct(F.coalesce("position", F.lit(2**31 - 1)).alias("p"), (-F.datediff("period_end", F.lit("1900-01-01"))).alias("d"), F.col("id"))
    fiscal = ["fiscal_year", *(["fiscal_quarter"] if granularity == "quarterly" else [])]
    fields = [F.col("value").cast("double").alias("value"), F.col("period_end")]
    if form != "short":
        fields += [F.col("label"), *[F.col(c) for c in fiscal]]
    if form == "debug":
        found = found.join(abstract_paths(rows), "id", "left")
        fields += [F.col("concept"), F.col("source_type"), F.col("is_synthetic"), F.col("abstract_concepts")]
    return found.groupBy(*key).agg(
        F.min_by("weight", at).alias("weight"), F.min_by("unit", at).alias("unit"),
        F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.struct(*fields).alias("v")))), lambda s: s["v"]).alias("values"),
    )


def latest_yearly(rows: DataFrame, limit: int) -> DataFrame:
    """Each company's `50 * limit` newest yearly rows that are not abstract and have no axis (ties: statement, label, id)."""
    w = Window.partitionBy("company_id").orderBy(F.desc("period_end"), "statement", "normalized_label", "id")
    return rows.where("not is_abstract and axis = ''").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 50 * limit).drop("__rn")


def quarterly_table(spark: SparkSession, root: str) -> DataFrame:
    """The stored quarterly series."""
    return table(spark, root, "quarterly_financials")


_ALL = "SELECT id, company_id, statement, position, period_end, value FROM quarterly_financials WHERE axis = ''"


@R.add(f"{_ALL} AND fiscal_year BETWEEN 2015 AND 2021 AND fiscal_quarter BETWEEN 2 AND 4 AND statement = 'Income Statement'")
def range_filter(spark: SparkSession, root: str) -> DataFrame:
    """Rows of some years and quarters of one statement."""
    rows = metric_rows(quarterly_table(spark, root), years=(2015, 2021), quarters=(2, 4), statement="Income Statement")
    return rows.select("id", "company_id", "statement", "position", "period_end", "value")


@R.add(f"{_ALL} AND (label ILIKE '%tax%' OR label ILIKE '%cash%') AND NOT is_abstract")
def label_contains(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose label contains one of some texts."""
    return metric_rows(quarterly_table(spark, root), labels=["tax", "cash"]).select("id", "company_id", "statement", "position", "period_end", "value")


@R.add(f"{_ALL} AND normalized_label IN ('Total assets', 'Gross margin') AND NOT is_abstract")
def label_in(spark: SparkSession, root: str) -> DataFrame:
    """Rows of some normalized labels."""
    return metric_rows(quarterly_table(spark, root), normalized_labels=["Total assets", "Gross margin"]).select("id", "company_id", "statement", "position", "period_end", "value")


@R.add(
    """SELECT company_id, normalized_label, statement, axis, member, arg_min(weight, (coalesce(position, 2147483647), -date_diff('day', DATE '1900-01-01', period_end), id)) AS weight,
    count(*) AS n_values, sum(value)::DECIMAL(38,6) AS total, string_agg(period_end::VARCHAR, ',' ORDER BY coalesce(position, 2147483647), period_end DESC, id) AS periods
    FROM quarterly_financials WHERE axis = '' AND NOT is_abstract AND value IS NOT NULL GROUP BY ALL"""
)
def financial_series(spark: SparkSession, root: str) -> DataFrame:
    """Grouped series of all companies, summarised."""
    s = series(metric_rows(quarterly_table(spark, root)))
    return s.select(
        "company_id", "normalized_label", "statement", "axis", "member", "weight", F.size("values").cast("bigint").alias("n_values"),
        F.aggregate("values", F.lit(0).cast("decimal(38,6)"), lambda a, v: (a + v["value"]).cast("decimal(38,6)")).alias("total"),
        F.array_join(F.transform("values", lambda v: v["period_end"].cast("string")), ",").alias("periods"),
    )


@R.add(
    """WITH RECURSIVE q AS (SELECT id, abstract_id, is_abstract, coalesce(normalized_label, label) AS l FROM quarterly_financials),
    w(id, nxt, seen, path, hop) AS (SELECT id, abstract_id, []::BIGINT[], []::VARCHAR[], 0 FROM q
        UNION ALL SELECT w.id, n.abstract_id, list_append(w.seen, n.id), CASE WHEN n.is_abstract AND n.l IS NOT NULL THEN list_prepend(n.l, w.path) ELSE w.path END, w.hop + 1
        FROM w JOIN q n ON n.id = w.nxt WHERE w.hop < 50 AND NOT list_contains(w.seen, n.id))
    SELECT id, array_to_string(arg_max(path, hop), ' > ') AS abstracts FROM w GROUP BY id"""
)
def abstract_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of the abstract rows above every stored row."""
    return abstract_paths(quarterly_table(spark, root)).select("id", F.array_join("abstracts", " > ").alias("abstracts"))


@R.add("SELECT normalized_label, statement, axis, member, count(*) AS n FROM quarterly_financials WHERE NOT is_abstract AND normalized_label IS NOT NULL GROUP BY ALL")
def label_counts(spark: SparkSession, root: str) -> DataFrame:
    """How often each normalized label occurs (the API orders by statement and count)."""
    return quarterly_table(spark, root).where("not is_abstract and normalized_label is not null").groupBy("normalized_label", "statement", "axis", "member").agg(F.count("*").alias("n")).orderBy("statement", F.desc("n"), "normalized_label")


@R.add(
    """SELECT id, company_id, period_end, statement, normalized_label, value FROM (SELECT *, dense_rank() OVER (PARTITION BY company_id ORDER BY period_end DESC, statement, normalized_label) AS k
    FROM (SELECT * FROM quarterly_financials WHERE NOT is_abstract AND axis = '' AND normalized_label IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY company_id, period_end, statement, normalized_label ORDER BY coalesce(position, 2147483647), id) = 1)) WHERE k <= 20"""
)
def latest_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Each company's 20 latest metrics, one per period, statement and label."""
    rows = quarterly_table(spark, root).where("not is_abstract and axis = '' and normalized_label is not null")
    one = keep_first(rows, ["company_id", "period_end", "statement", "normalized_label"], [F.coalesce("position", F.lit(2**31 - 1)), F.asc("id")])
    w = Window.partitionBy("company_id").orderBy(F.desc("period_end"), "statement", "normalized_label")
    return one.withColumn("__rn", F.row_number().over(w)).where("__rn <= 20").select("id", "company_id", "period_end", "statement", "normalized_label", "value")


def newest_facts(rows: DataFrame, filed: DataFrame, most: int = 10) -> DataFrame:
    """Each company's `most` facts of the newest filings (ties: the lower id)."""
    j = rows.join(small(filed.select(F.col("id").alias("filing_id"), "filing_date")), "filing_id")
    w = Window.partitionBy("company_id").orderBy(F.desc("filing_date"), "id")
    return j.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).select("id", "company_id", "concept", "value", "filing_date")


@R.add(
    """SELECT f.id, f.company_id, f.concept, f.value, g.filing_date FROM financial_facts f JOIN filings g ON g.id = f.filing_id WHERE f.concept = 'core-fin:NetRevenue'
    QUALIFY row_number() OVER (PARTITION BY f.company_id ORDER BY g.filing_date DESC, f.id) <= 10"""
)
def facts_by_concept(spark: SparkSession, root: str) -> DataFrame:
    """Each company's 10 newest facts of a concept in this spelling."""
    return newest_facts(table(spark, root, "financial_facts").where("concept = 'core-fin:NetRevenue'"), table(spark, root, "filings"))


@R.add(
    f"""SELECT f.id, f.company_id, f.k AS concept, f.value, g.filing_date FROM (SELECT *, {SQL_KEY} AS k FROM financial_facts) f JOIN filings g ON g.id = f.filing_id
    WHERE f.k = 'core-fin:netrevenue' QUALIFY row_number() OVER (PARTITION BY f.company_id ORDER BY g.filing_date DESC, f.id) <= 10"""
)
def facts_by_concept_folded(spark: SparkSession, root: str) -> DataFrame:
    """Each company's 10 newest facts of a concept, however it is spelt."""
    return newest_facts(facts(spark, root).where("concept = 'core-fin:netrevenue'"), filings(spark, root))


@R.add("SELECT company_id, fiscal_year, string_agg(number, ',' ORDER BY filing_date DESC, id) AS numbers, count(*) AS n FROM filings GROUP BY ALL")
def filings_by_company(spark: SparkSession, root: str) -> DataFrame:
    """Filings of each company and year, newest first."""
    f = table(spark, root, "filings").groupBy("company_id", "fiscal_year").agg(
        F.sort_array(F.collect_list(F.struct((-F.unix_date("filing_date")).alias("d"), "id", "number"))).alias("x"), F.count("*").alias("n")
    )
    return f.select("company_id", "fiscal_year", F.array_join("x.number", ",").alias("numbers"), "n")


def search_companies(companies: DataFrame, tickers: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Companies whose ticker (first) or name begins with `prefix`; one row each, at most `limit` (1 to 20), none for a blank prefix."""
    j = companies.select(F.col("id").alias("company_id"), "name").join(tickers.select("company_id", "ticker"), "company_id")
    hit = F.when(begins_with("ticker", prefix), 0).when(begins_with("name", prefix), 1)
    found = j.select("company_id", "name", "ticker", hit.alias("rank")).where(F.col("rank").isNotNull() & (F.lit(prefix.strip()) != ""))
    return keep_first(found, ["company_id"], [F.asc("rank"), F.asc("ticker")]).drop("rank").orderBy("company_id").limit(max(1, min(int(limit), 20)))


@R.add(
    """SELECT company_id, name, ticker FROM (SELECT c.id AS company_id, c.name, t.ticker, CASE WHEN lower(t.ticker) LIKE 's%' THEN 0 ELSE 1 END AS rank
    FROM companies c JOIN tickers t ON t.company_id = c.id WHERE lower(t.ticker) LIKE 's%' OR lower(c.name) LIKE 's%') QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY rank, ticker) = 1
    ORDER BY company_id LIMIT 20"""
)
def prefix_search(spark: SparkSession, root: str) -> DataFrame:
    """The company search, as a top-20 report."""
    return search_companies(table(spark, root, "companies"), table(spark, root, "tickers"), "S")


@R.add("SELECT c.id, c.name, (SELECT string_agg(ticker || ':' || exchange, ',' ORDER BY ticker, exchange) FROM tickers t WHERE t.company_id = c.id) AS tickers, "
       "(SELECT count(*) FROM filing_entities e WHERE e.company_id = c.id) AS n_entities FROM companies c")  # fmt: skip
def children_grouped(spark: SparkSession, root: str) -> DataFrame:
    """Companies with their tickers and filing entities, each fetched once."""
    t = table(spark, root, "tickers").groupBy("company_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ticker", "exchange"))), lambda s: F.concat_ws(":", s["ticker"], s["exchange"])), ",").alias("tickers"))
    e = table(spark, root, "filing_entities").groupBy("company_id").agg(F.count("*").alias("n_entities"))
    c = table(spark, root, "companies")
    return c.join(t, c.id == t.company_id, "left").drop("company_id").join(e, c.id == e.company_id, "left").select("id", "name", "tickers", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


@R.add("SELECT t.ticker, c.id AS company_id, c.name FROM tickers t JOIN companies c ON c.id = t.company_id")
def company_by_ticker(spark: SparkSession, root: str) -> DataFrame:
    """Every ticker's company, whatever the ticker's status."""
    c = table(spark, root, "companies").select(F.col("id").alias("company_id"), "name")
    return table(spark, root, "tickers").select("ticker", "company_id").join(small(c), "company_id").select("ticker", "company_id", "name")


_VECTORS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v)"""


@R.add(
    f"""WITH {_VECTORS} SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_sum(list_transform(list_zip(r.e, q.e), lambda z: (z[1] / r.len) * (z[2] / q.len))), 6) AS similarity
    FROM n q, n r WHERE q.vec_id % 20 = 0 AND list_sum(list_transform(list_zip(r.e, q.e), lambda z: (z[1] / r.len) * (z[2] / q.len))) > 0.2
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(r.e, q.e), lambda z: (z[1] / r.len) * (z[2] / q.len))) DESC, r.vec_id) <= 5"""
)
def similarity_topk(spark: SparkSession, root: str) -> DataFrame:
    """The 5 vectors most similar to each vector whose id is divisible by 20, above a threshold."""
    e = table(spark, root, "embeddings")
    return similar(e, e.where("vec_id % 20 = 0"), "vec_id", "vec_id", "embedding", 5, 0.2).withColumn("similarity", F.round("similarity", 6))


@R.add()
def similarity_indexed(spark: SparkSession, root: str) -> DataFrame:
    """The same through the index of random hyperplanes, without a threshold."""
    e = table(spark, root, "embeddings")
    return similar_indexed(e, e.where("vec_id % 20 = 0"), "vec_id", "vec_id", "embedding", 5, 64)


@R.add()
def sentence_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Documents in chunks of whole sentences."""
    return chunks(table(spark, root, "documents"), "doc_id", "text")


@R.add("SELECT count(*) AS n FROM documents")
def document_count(spark: SparkSession, root: str) -> DataFrame:
    """Number of stored documents."""
    return table(spark, root, "documents").agg(F.count("*").alias("n"))


@R.add("SELECT company_id, statement, count(*) AS n FROM financial_facts WHERE company_id IN (SELECT id FROM companies WHERE industry IS NOT NULL) GROUP BY ALL")
def company_scan(spark: SparkSession, root: str) -> DataFrame:
    """Facts of a set of companies: a semi join keeps the scan to them."""
    c = table(spark, root, "companies").where("industry is not null").select(F.col("id").alias("company_id"))
    return table(spark, root, "financial_facts").join(small(c), "company_id", "left_semi").groupBy("company_id", "statement").agg(F.count("*").alias("n"))


@R.add("SELECT f.id, f.filing_id FROM financial_facts f JOIN filings g ON g.id = f.filing_id WHERE f.period_end = g.fiscal_period_end")
def period_integrity(spark: SparkSession, root: str) -> DataFrame:
    """Facts whose period is that of their filing."""
    g = filings(spark, root).select(F.col("id").alias("filing_id"), "fiscal_period_end")
    return facts(spark, root).join(small(g), "filing_id").where("period_end = fiscal_period_end").select("id", "filing_id")


_YEARS = "(SELECT * FROM quarterly_financials WHERE source_type ILIKE '10-K%')"


@R.add(
    f"""SELECT company_id, normalized_label, statement, axis, member, count(*) AS n, sum(value::DOUBLE) AS total, string_agg(fiscal_year::VARCHAR, ',' ORDER BY coalesce(position, 2147483647), period_end DESC, id) AS years,
    coalesce(string_agg(concept, ',' ORDER BY coalesce(position, 2147483647), period_end DESC, id), '') AS concepts FROM {_YEARS}
    WHERE axis = '' AND NOT is_abstract AND value IS NOT NULL AND (label ILIKE '%tax%' OR label ILIKE '%revenue%') AND fiscal_year >= 2015 GROUP BY ALL"""
)
def yearly_financials(spark: SparkSession, root: str) -> DataFrame:
    """The financials read over yearly rows, in its debug form."""
    rows = quarterly_table(spark, root).where("source_type ilike '10-K%'")
    f = financials(rows, "yearly", labels="tax; revenue", years=(2015, None), form="debug")
    listed = lambda c: F.array_join(F.transform("values", lambda v: v[c].cast("string")), ",")
    return f.select(
        "company_id", "normalized_label", "statement", "axis", "member", F.size("values").cast("bigint").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v["value"]).alias("total"),
        listed("fiscal_year").alias("years"), listed("concept").alias("concepts"),
    )


@R.add(f"SELECT id, company_id FROM {_YEARS} WHERE NOT is_abstract AND axis = '' QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period_end DESC, statement, normalized_label, id) <= 50")
def yearly_latest(spark: SparkSession, root: str) -> DataFrame:
    """Each company's 50 newest yearly rows, as a top-k report."""
    return latest_yearly(quarterly_table(spark, root).where("source_type ilike '10-K%'"), 1).select("id", "company_id")
