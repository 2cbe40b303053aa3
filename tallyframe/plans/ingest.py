"""Wide filing statements into facts: period columns, melting, dimension rows, disaggregated metrics, key resolution."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import comparative_column, fiscal_quarter, period_type_of_column, period_type_of_dates, uuid5
from ..operators.matching import keep_first
from ..sources.tables import table
from .registry import Registry

R = Registry()
MONEY = "decimal(28,6)"
#: Marks in the label of an abstract row that carries no meaning of its own.
EMPTY_ABSTRACTS = r"\[(Abstract|Table|Line Items|Axis|Domain)\]"


def period_columns(df: DataFrame) -> list[str]:
    """Columns whose name begins with an ISO date, in their order."""
    return [c for c in df.columns if re.match(r"\d{4}-\d{2}-\d{2}", c)]


def filled_share(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of rows (percent) in which each column is neither null nor an empty text; 0 for an empty table or a missing column."""
    there = [c for c in columns if c in df.columns]
    got = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")).alias(f"c{i}") for i, c in enumerate(there)]).first()
    return {c: 0.0 for c in columns} | {c: 100.0 * got[f"c{i}"] / got["n"] if got["n"] else 0.0 for i, c in enumerate(there)}


def prefixed(c: Column) -> Column:
    """A concept with its prefix set off by a colon (the first underscore)."""
    return F.regexp_replace(c, "^([^_]*)_", "$1:")


def melt_statement(df: DataFrame, statement: str, frame: Sequence[str], row_no: str, least: float = 20.0) -> DataFrame:
    """One fact per line of wide statements: value of the latest period column and of its comparative.

    `df` has one row per line item: `frame` columns name the statement (a filing), `row_no` its place, then concept, label, abstract,
    optionally unit, weight, parent_concept, parent_abstract_concept, dimension, dimension_axis, dimension_member, dimension_member_label,
    and one column per period. Columns filled in less than `least` percent of the rows are ignored. Left out are rows without a concept, rows
    with values that hold none, and meaningless abstracts. Positions count the rows kept. Dimension rows take the label of their
    concept's first undimensioned row, have no parents and no position.
    """
    columns = period_columns(df)
    share = filled_share(df, columns)
    kept = [c for c in columns if share[c] >= least]
    if not kept:
        raise ValueError("no period column is filled enough")
    latest = max(kept)
    before = comparative_column(kept, latest)
    have = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    money = lambda c: F.expr(f"try_cast(`{c}` as {MONEY})") if c else F.lit(None).cast(MONEY)
    end = lambda c: F.to_date(F.lit(c.split(" ")[0])) if c else F.lit(None).cast("date")
    dim = F.coalesce(have("dimension", "boolean"), F.lit(False))
    label_of = have("dimension_member_label")
    repaired = F.when(F.startswith("label", F.concat(label_of, F.lit(" - "))), F.expr("substr(label, length(dimension_member_label) + 4)") if "dimension_member_label" in df.columns else F.lit(None))
    rows = df.select(
        *frame, F.col(row_no).alias("row_no"), prefixed(F.col("concept")).alias("concept"), "label", F.col("abstract").alias("is_abstract"), money(latest).alias("value"), money(before).alias("comparative_value"),
        have("weight", "double").cast("decimal(9,4)").alias("weight"), F.coalesce(have("unit"), F.when(~F.col("abstract"), "usd")).alias("unit"), dim.alias("is_dimension"), have("dimension_axis").alias("axis"),
        F.coalesce(repaired, F.translate(have("dimension_member"), "_", ":")).alias("member"), F.coalesce(repaired, label_of).alias("member_label"),
        prefixed(have("parent_concept")).alias("parent_concept"), prefixed(have("parent_abstract_concept")).alias("abstract_concept"),
    )
    rows = rows.where((F.col("concept") != "") & (F.col("is_abstract") | F.col("value").isNotNull()) & ~(F.col("is_abstract") & F.col("label").rlike(EMPTY_ABSTRACTS)))
    name = lambda c, *more: uuid5(F.concat_ws("|", F.col(c), F.lit(statement), F.lit(latest.split(" ")[0]), *[F.col(m) for m in more]))
    plain = rows.where(~F.col("is_dimension"))
    w = Window.partitionBy(*frame).orderBy("row_no")
    base = plain.withColumns({
        "position": F.row_number().over(w) - 1, "key": name("concept"), "parent_key": F.when(F.col("parent_concept").isNotNull(), name("parent_concept")),
        "abstract_key": F.when(F.col("abstract_concept").isNotNull(), name("abstract_concept")), "axis": F.lit(""), "member": F.lit(""), "member_label": F.lit(""),
    })
    first = keep_first(plain, [*frame, "concept"], [F.asc("row_no")]).select(*frame, "concept", F.col("label").alias("__l"))
    dims = rows.where("is_dimension and axis is not null and member is not null").join(first, [*frame, "concept"], "left").withColumns({
        "label": F.coalesce("__l", "label"), "position": F.lit(None).cast("int"), "key": name("concept", "axis", "member", "member_label"),
        "parent_key": F.lit(None).cast("string"), "abstract_key": F.lit(None).cast("string"),
    })
    out = [*frame, "key", "parent_key", "abstract_key", "concept", "label", "is_abstract", "value", "comparative_value", "weight", "unit", "axis", "member", "member_label", "position"]
    return base.select(out).unionByName(dims.select(out)).withColumns({
        "statement": F.lit(statement), "period_end": end(latest), "comparative_period_end": end(before), "period": period_type_of_column(F.lit(latest), F.lit(statement)),
    })


def unambiguous_members(df: DataFrame, member: str, others: Sequence[str]) -> DataFrame:
    """Without rows that a second dimension splits: a member with two or more values of it keeps only its rows without one."""
    for o in others:
        many = df.groupBy(member).agg(F.countDistinct(o).alias("__n")).where("__n >= 2").select(member)
        df = df.where(F.col(o).isNull()).unionByName(df.where(F.col(o).isNotNull()).join(many, member, "left_anti"))
    return df


def single_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """One row per key if all its rows have the same value (nulls equal), none if they differ."""
    differ = df.groupBy(*keys).agg(F.countDistinct(F.struct(value)).alias("__n")).where("__n > 1").select(*keys)
    return keep_first(df.join(differ, list(keys), "left_anti"), list(keys), order)


def latest_two(df: DataFrame, member: str, start: str, value: str, order: Sequence[Column]) -> DataFrame:
    """member, its newest value and the one before by `start`, with their starts."""
    w = Window.partitionBy(member).orderBy(F.desc(start), *order)
    top = df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    pick = lambda n, c: F.max(F.when(F.col("__rn") == n, F.col(c)))
    return top.groupBy(member).agg(pick(1, value).alias("value"), pick(2, value).alias("comparative_value"), pick(1, start).alias("start"), pick(2, start).alias("comparative_start"))


def resolve_keys(df: DataFrame, record: str, key: str, links: dict[str, str]) -> DataFrame:
    """Replace link keys by ids: `links` maps a key column to the id column to make. Of equal keys the last id counts; unknown ones are null."""
    ids = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(record).alias("__id"))
    for source, target in links.items():
        df = df.join(ids, F.col(source) == F.col("__k"), "left").withColumn(target, F.col("__id")).drop("__k", "__id")
    return df


def wide_frames(spark: SparkSession, root: str) -> DataFrame:
    """Statements in wide form, one per nation: revenue of each part type (a line) in three years (period columns)."""
    li, o, c, p = (table(spark, root, t) for t in ("lineitem", "orders", "customer", "part"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    year = lambda y: F.sum(F.when(F.year("o_orderdate") == y, cents)).alias(f"{y}-12-31")
    wide = j.groupBy(F.col("c_nationkey").alias("nation"), F.col("p_type").alias("t")).agg(year(1997), year(1998), year(1999))
    return wide.select("nation", F.col("t").alias("row_no"), F.concat(F.lit("ex_"), "t").alias("concept"), F.concat(F.lit("Sales of "), "t").alias("label"), F.lit(False).alias("abstract"), "`1997-12-31`", "`1998-12-31`", "`1999-12-31`")


@R.add(
    """WITH w AS (SELECT c_nationkey AS nation, p_type AS t, sum(round(l_extendedprice * 100)::BIGINT) FILTER (year(o_orderdate) = 1997) AS a, sum(round(l_extendedprice * 100)::BIGINT) FILTER (year(o_orderdate) = 1999) AS z
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT nation, 'ex:' || t AS concept, 'Sales of ' || t AS label, z::DECIMAL(28,6) AS value, a::DECIMAL(28,6) AS comparative_value, (row_number() OVER (PARTITION BY nation ORDER BY t) - 1)::INT AS position,
           DATE '1999-12-31' AS period_end, DATE '1997-12-31' AS comparative_period_end, 'YTD' AS period FROM w WHERE z IS NOT NULL"""
)
def melt_statements(spark: SparkSession, root: str) -> DataFrame:
    """Wide statements as facts."""
    m = melt_statement(wide_frames(spark, root), "Income Statement", ["nation"], "row_no")
    return m.select("nation", "concept", "label", "value", "comparative_value", "position", "period_end", "comparative_period_end", "period")


_SPARSE = ["value", "comparative_value", "weight", "unit", "axis", "parent_id", "abstract_id", "period"]


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS name, round(100.0 * count(*) FILTER (WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '') / count(*), 6) AS share FROM financial_facts" for c in _SPARSE))
def sparse_columns(spark: SparkSession, root: str) -> DataFrame:
    """How far columns are filled."""
    return spark.createDataFrame([(c, round(s, 6)) for c, s in filled_share(table(spark, root, "financial_facts"), _SPARSE).items()], "name string, share double")


@R.add(
    """WITH k AS (SELECT *, count(DISTINCT unit) OVER (PARTITION BY member) AS n FROM financial_facts WHERE axis <> '') SELECT id, member, unit FROM k WHERE n < 2 OR unit IS NULL"""
)
def ambiguous_members(spark: SparkSession, root: str) -> DataFrame:
    """Dimensional facts without those a second attribute splits."""
    f = table(spark, root, "financial_facts").where("axis <> ''").select("id", "member", "unit")
    return unambiguous_members(f, "member", ["unit"])


@R.add(
    """SELECT id, company_id, member, concept, period_end FROM (SELECT *, count(DISTINCT coalesce(value::VARCHAR, 'null')) OVER (PARTITION BY company_id, statement, member, concept, period_end) AS n,
    row_number() OVER (PARTITION BY company_id, statement, member, concept, period_end ORDER BY id) AS rn FROM financial_facts WHERE axis <> '') WHERE n = 1 AND rn = 1"""
)
def dup_members(spark: SparkSession, root: str) -> DataFrame:
    """Repeated members of one period: kept once if they agree, dropped if not."""
    f = table(spark, root, "financial_facts").where("axis <> ''")
    return single_values(f, ["company_id", "statement", "member", "concept", "period_end"], "value", [F.asc("id")]).select("id", "company_id", "member", "concept", "period_end")


@R.add(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) SELECT user_id, max(value) FILTER (rn = 1) AS value, max(value) FILTER (rn = 2) AS comparative_value,
    max(ts) FILTER (rn = 1) AS start, max(ts) FILTER (rn = 2) AS comparative_start FROM t WHERE rn <= 2 GROUP BY user_id"""
)
def top2_periods(spark: SparkSession, root: str) -> DataFrame:
    """The two newest values of each member."""
    return latest_two(table(spark, root, "events"), "user_id", "ts", "value", [F.asc("event_id")])


@R.add(
    """SELECT id, CASE WHEN month(fiscal_period_end) BETWEEN 3 AND 5 THEN 1 WHEN month(fiscal_period_end) BETWEEN 6 AND 8 THEN 2 WHEN month(fiscal_period_end) BETWEEN 9 AND 11 THEN 3 ELSE 4 END AS quarter,
    CASE WHEN form_type IN ('10-K', '10-K/A') THEN 'YTD' WHEN coalesce(date_diff('day', lag(fiscal_period_end) OVER w, fiscal_period_end) <= 100, true) THEN 'Q' ELSE 'YTD' END AS period
    FROM (SELECT * FROM filings WHERE fiscal_period_end IS NOT NULL) WINDOW w AS (PARTITION BY company_id ORDER BY fiscal_period_end, id)"""
)
def fiscal_periods(spark: SparkSession, root: str) -> DataFrame:
    """Fiscal quarters, and period types from the start (the end of the company's period before) and the end of a filing's period."""
    f = table(spark, root, "filings").where("fiscal_period_end is not null")
    start = F.lag("fiscal_period_end").over(Window.partitionBy("company_id").orderBy("fiscal_period_end", "id"))
    return f.select("id", fiscal_quarter(F.col("fiscal_period_end")).alias("quarter"), period_type_of_dates(start, F.col("fiscal_period_end"), F.col("form_type")).alias("period"))


_HASH = "sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(concept || '|' || statement || '|' || period_end::VARCHAR))"


@R.add(
    f"""SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS key
    FROM (SELECT id, {_HASH} AS h FROM financial_facts)"""
)
def fact_keys(spark: SparkSession, root: str) -> DataFrame:
    """Name-based UUIDs of all facts."""
    f = table(spark, root, "financial_facts")
    return f.select("id", uuid5(F.concat_ws("|", "concept", "statement", F.col("period_end").cast("string"))).alias("key"))


@R.add("SELECT id, md5(company_id || '|' || statement || '|' || concept || '|' || 'grouping') AS group_id FROM financial_facts")
def group_md5(spark: SparkSession, root: str) -> DataFrame:
    """Group ids of facts."""
    return table(spark, root, "financial_facts").select("id", F.md5(F.concat_ws("|", F.col("company_id").cast("string"), "statement", "concept", F.lit("grouping"))).alias("group_id"))


@R.add(
    """WITH k AS (SELECT *, filing_id || '|' || concept || '|' || statement AS key FROM financial_facts), l AS (SELECT k.*, p.key AS parent_key FROM k LEFT JOIN k p ON p.id = k.parent_id),
    m AS (SELECT key, max(id) AS id FROM k GROUP BY key) SELECT l.id, m.id AS resolved FROM l LEFT JOIN m ON m.key = l.parent_key"""
)
def batch_key_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Links given by key, resolved to ids."""
    f = table(spark, root, "financial_facts").select("id", "parent_id", F.concat_ws("|", F.col("filing_id").cast("string"), "concept", "statement").alias("key"))
    p = f.select(F.col("id").alias("parent_id"), F.col("key").alias("parent_key"))
    return resolve_keys(f.join(p, "parent_id", "left"), "id", "key", {"parent_key": "resolved"}).select("id", "resolved")


@R.add("SELECT id, filing_entity_id, filing_date FROM filings WHERE form_type LIKE '10-K%' QUALIFY row_number() OVER (PARTITION BY filing_entity_id ORDER BY filing_date DESC, id DESC) <= 5")
def filing_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The 5 newest annual filings of each entity."""
    w = Window.partitionBy("filing_entity_id").orderBy(F.desc("filing_date"), F.desc("id"))
    return table(spark, root, "filings").where("form_type like '10-K%'").withColumn("__rn", F.row_number().over(w)).where("__rn <= 5").select("id", "filing_entity_id", "filing_date")
