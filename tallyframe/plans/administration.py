"""Rule tables: constraints, CSV export and import, partial updates, replacement of companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.matching import keep_first
from ..sources.store import get_or_create, updated, upserted
from ..sources.tables import table
from .curation import SQL_RECORDS, override_records
from .registry import Registry

R = Registry()
CONCEPT_HEADER = "company_id concept statement normalized_label is_abstract is_global abstract_concept parent_concept description unit weight".split()
DIMENSION_HEADER = "company_id axis member member_label is_global normalized_axis_label normalized_member_label tags".split()


FACT_HEADER = "company_id concept statement axis member label form_type from_period to_period to_concept to_axis to_member to_member_label to_weight is_global".split()
#: Rule table -> header of its CSV file, and the key of a rule.
RULE_FILES = {
    "concept-normalization-overrides": (CONCEPT_HEADER, ["company_id", "concept", "statement"]),
    "dimension-normalization-overrides": (DIMENSION_HEADER, ["company_id", "axis", "member", "member_label"]),
    "financial-facts-overrides": (FACT_HEADER, None),
}


def rule_violation() -> Column:
    """The first constraint a concept rule breaks, null if it is sound.

    A rule with a parent is not abstract and has a weight; one that is not abstract has a unit; an abstract one has neither
    parent nor weight nor unit; a rule is global exactly if it belongs to company 0.
    """
    abstract = F.coalesce("is_abstract", F.lit(False))
    return (
        F.when(F.col("parent_concept").isNotNull() & abstract, "parent and abstract")
        .when(F.col("parent_concept").isNotNull() & F.col("weight").isNull(), "parent without weight")
        .when(~abstract & F.col("unit").isNull(), "no unit")
        .when(abstract & F.col("weight").isNotNull(), "abstract with weight")
        .when(abstract & F.col("unit").isNotNull(), "abstract with unit")
        .when(F.coalesce("is_global", F.lit(False)) != (F.col("company_id") == 0), "global flag")
    )


_SQL_VIOLATION = """CASE WHEN parent_concept IS NOT NULL AND is_abstract THEN 'parent and abstract' WHEN parent_concept IS NOT NULL AND weight IS NULL THEN 'parent without weight'
    WHEN is_abstract IS NOT TRUE AND unit IS NULL THEN 'no unit' WHEN is_abstract AND weight IS NOT NULL THEN 'abstract with weight' WHEN is_abstract AND unit IS NOT NULL THEN 'abstract with unit'
    WHEN coalesce(is_global, false) <> (company_id = 0) THEN 'global flag' END"""


def csv_field(c: Column) -> Column:
    """A value as a CSV field: null as nothing, an empty text as __EMPTY__, quoted where needed."""
    t = F.when(c == "", "__EMPTY__").otherwise(c)
    return F.coalesce(F.when(t.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t), F.lit(""))


def csv_lines(df: DataFrame, columns: list[str]) -> Column:
    """One CSV record of `columns`; arrays are joined with `;`."""
    kinds = dict(df.dtypes)
    text = [F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c).cast("string") for c in columns]
    return F.concat_ws(",", *[csv_field(t) for t in text])


def export_csv(df: DataFrame, table_name: str, companies: Sequence[int] | None = None, where: Column | None = None) -> tuple[str, DataFrame]:
    """(file name, lines) of a rule table as CSV, header first: `line_no` and `line`, by company and the rest of the columns. The name says which companies it holds."""
    columns = RULE_FILES[table_name][0]
    if companies is not None:
        df = df.where(F.col("company_id").isin(list(companies)))
    if where is not None:
        df = df.where(where)
    name = table_name if companies is None else f"{table_name}-{'-'.join(str(c) for c in sorted(companies))}"
    head = df.sparkSession.createDataFrame([(0, ",".join(columns))], "line_no int, line string")
    lines = df.select("company_id", csv_lines(df, columns).alias("line"))
    ranked = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("company_id").orderBy("line")))
    return f"{name}.csv", head.select(F.lit(None).cast("int").alias("company_id"), "line_no", "line").unionByName(ranked.select("company_id", "line_no", "line"))


def import_rules(records: DataFrame, stored: DataFrame, key: Sequence[str] | None, rows: str, update_existing: bool = True, check: Column | None = None) -> DataFrame:
    """`records` (see `load_records`) with what becomes of each: `row_no` (from 2, the header being row 1), `outcome` and `message`.

    A record with a reason, a blank key column or a broken constraint is an `error`; one whose key is stored is `updated`, or `skipped` without
    `update_existing`; others are `created`. Rules without a key are always created. Key columns compare null-safe, and a text key may not be blank
    unless null stands for "any" in it (member, member_label).
    """
    text = [k for k in key or ["concept", "statement"] if k not in ("company_id", "member", "member_label")]
    blank = F.lit(None).cast("string")
    for k in reversed(text):
        blank = F.when(F.coalesce(F.trim(k), F.lit("")) == "", f"{k} is missing").otherwise(blank)
    wrong = F.coalesce(F.col("reason"), blank, check if check is not None else F.lit(None).cast("string"))
    if key is None:
        j = records.withColumn("__there", F.lit(None).cast("boolean"))
    else:
        there = stored.select(*[F.col(k).alias(f"__k_{k}") for k in key]).distinct().withColumn("__there", F.lit(True))
        j = records.join(there, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key], "left")
    outcome = F.when(wrong.isNotNull(), "error").when(F.col("__there").isNull(), "created").otherwise("updated" if update_existing else "skipped")
    return j.select(*records.columns, F.col(rows).alias("row_no"), outcome.alias("outcome"), wrong.alias("message"))


def imported(stored: DataFrame, judged: DataFrame, key: Sequence[str], now: Column | None = None) -> DataFrame:
    """The rule table after an import: created and updated records in it, of several for one key the last, stamped with `now` (the current time if None)."""
    good = keep_first(judged.where("outcome in ('created', 'updated')"), list(key), [F.desc("row_no")])
    stamp = {c: (F.current_timestamp() if now is None else now).cast(dict(stored.dtypes)[c]) for c in ("created_at", "updated_at") if c in stored.columns}
    kinds = dict(stored.dtypes)
    new = good.select(*[stamp.get(c, F.col(c) if c in good.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns])
    gone = good.select(*[F.col(k).alias(f"__k_{k}") for k in key])
    return stored.join(gone, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key], "left_anti").unionByName(new)


def missing_references(df: DataFrame, key: list[str], link: str, scope: list[str]) -> DataFrame:
    """Rows whose `link` names no row of the same scope (the last key column)."""
    there = df.select(*scope, F.col(key[-1]).alias(link)).distinct()
    return df.where(F.col(link).isNotNull()).join(there, [*scope, link], "left_anti")


def import_report(spark: SparkSession, root: str) -> DataFrame:
    """What loading the concept-rule files would do: per batch the rows created, updated and refused."""
    rows = override_records(spark, root, CONCEPT_HEADER)
    lines = table(spark, root, "raw_override_lines").where("file_name = 'concept-normalization-overrides'").select("line_id", "batch_no")
    old = table(spark, root, "concept_normalization_overrides").select("company_id", "concept", "statement", F.lit(True).alias("there"))
    j = rows.join(lines, "line_id").join(old, ["company_id", "concept", "statement"], "left")
    blank = F.coalesce(F.trim("concept"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("statement"), F.lit("")).eqNullSafe("")
    refused = F.col("reason").isNotNull() | blank | rule_violation().isNotNull()
    return j.groupBy("batch_no").agg(
        F.count_if(~refused & F.col("there").isNull()).alias("created"), F.count_if(~refused & F.col("there").isNotNull()).alias("updated"), F.count_if(refused).alias("errors")
    )


@R.add(f"SELECT company_id, concept, statement, violation FROM (SELECT *, {_SQL_VIOLATION} AS violation FROM concept_normalization_overrides) WHERE violation IS NOT NULL")
def rule_violations(spark: SparkSession, root: str) -> DataFrame:
    """Concept rules that break a constraint."""
    o = table(spark, root, "concept_normalization_overrides").withColumn("violation", rule_violation())
    return o.where("violation is not null").select("company_id", "concept", "statement", "violation")


@R.add("SELECT company_id, concept, statement, parent_concept FROM concept_normalization_overrides o WHERE parent_concept IS NOT NULL AND NOT EXISTS (SELECT 1 FROM concept_normalization_overrides p "
       "WHERE p.company_id = o.company_id AND p.statement = o.statement AND p.concept = o.parent_concept)")  # fmt: skip
def dangling_parents(spark: SparkSession, root: str) -> DataFrame:
    """Concept rules whose parent is no rule of the same company and statement."""
    o = table(spark, root, "concept_normalization_overrides")
    return missing_references(o, ["company_id", "statement", "concept"], "parent_concept", ["company_id", "statement"]).select("company_id", "concept", "statement", "parent_concept")


def _sql_field(c: str) -> str:
    t = f"CASE WHEN {c} = '' THEN '__EMPTY__' ELSE {c} END"
    return f"coalesce(CASE WHEN regexp_matches({t}, '[\",\\n\\r]') THEN '\"' || replace({t}, '\"', '\"\"') || '\"' ELSE {t} END, '')"


@R.add("SELECT id, concat_ws(',', " + ", ".join(_sql_field("array_to_string(tags, ';')" if c == "tags" else f"{c}::VARCHAR") for c in DIMENSION_HEADER) + ") AS line FROM dimension_normalization_overrides")
def csv_export(spark: SparkSession, root: str) -> DataFrame:
    """Dimension rules as CSV records."""
    d = table(spark, root, "dimension_normalization_overrides")
    return d.select("id", csv_lines(d, DIMENSION_HEADER).alias("line"))


_V = "trim(raws[list_position(names, '{}')])"
_T = lambda n: f"CASE raws[list_position(names, '{n}')] WHEN '' THEN NULL WHEN '__EMPTY__' THEN '' ELSE raws[list_position(names, '{n}')] END AS {n}"
_B = lambda n: f"CASE WHEN lower({_V.format(n)}) IN ('true', '1', 'yes', 't') THEN true WHEN {_V.format(n)} <> '' THEN false END AS {n}"


@R.add(
    f"""WITH {SQL_RECORDS}, r AS (SELECT j.line_id, batch_no, reason, CASE WHEN reason IS NULL THEN try_cast({_V.format("company_id")} AS INT) END AS company_id, {_T("concept")}, {_T("statement")}, {_T("parent_concept")}, {_T("unit")},
        {_B("is_abstract")}, {_B("is_global")}, try_cast({_V.format("weight")} AS DOUBLE) AS weight FROM judged j JOIN raw_override_lines l USING (line_id) WHERE l.file_name = 'concept-normalization-overrides'),
    s AS (SELECT r.*, o.company_id IS NOT NULL AS there, reason IS NOT NULL OR coalesce(trim(r.concept), '') = '' OR coalesce(trim(r.statement), '') = '' OR ({_SQL_VIOLATION.replace("parent_concept", "r.parent_concept").replace("is_abstract", "r.is_abstract")
        .replace("weight IS", "r.weight IS").replace("unit IS", "r.unit IS").replace("is_global", "r.is_global").replace("company_id = 0", "r.company_id = 0")}) IS NOT NULL AS bad
        FROM r LEFT JOIN concept_normalization_overrides o ON o.company_id = r.company_id AND o.concept = r.concept AND o.statement = r.statement)
    SELECT batch_no, count(*) FILTER (NOT bad AND NOT there) AS created, count(*) FILTER (NOT bad AND there) AS updated, count(*) FILTER (bad) AS errors FROM s GROUP BY batch_no"""
)
def csv_rule_import(spark: SparkSession, root: str) -> DataFrame:
    """Report of importing the concept-rule files."""
    return import_report(spark, root)


@R.add("SELECT id, status, exchange FROM (SELECT id, CASE WHEN exchange = 'MIDX' THEN 'review' ELSE status END AS status, exchange FROM tickers)")
def partial_update(spark: SparkSession, root: str) -> DataFrame:
    """Only the given fields of the matching rows change."""
    return updated(table(spark, root, "tickers"), F.col("exchange") == "MIDX", {"status": "review", "exchange": None}).select("id", "status", "exchange")


@R.add("SELECT id, ticker, status FROM (SELECT t.id, coalesce(s.ticker, t.ticker) AS ticker, CASE WHEN s.id IS NULL THEN t.status ELSE s.status END AS status FROM tickers t FULL JOIN (SELECT * FROM ticker_snapshots "
       "QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC, loaded_at DESC, ticker, status NULLS LAST) = 1) s ON s.id = t.id) WHERE id IS NOT NULL")  # fmt: skip
def company_replace(spark: SparkSession, root: str) -> DataFrame:
    """Tickers with the rows of the newest snapshots upserted by id."""
    s = keep_first(table(spark, root, "ticker_snapshots"), ["id"], [F.desc("snapshot_date"), F.desc("loaded_at"), F.asc("ticker"), F.asc_nulls_last("status")])
    cols = ["id", "ticker", "status"]
    t = table(spark, root, "tickers").select(cols)
    return upserted(t, s.select(cols).join(t.select("id"), "id", "left_semi").select(cols), ["id"])


@R.add(
    """WITH w AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, exchange, company_id FROM ticker_snapshots WHERE ticker IS NOT NULL AND exchange IS NOT NULL),
    t AS (SELECT ticker, exchange, min(company_id) AS has FROM tickers GROUP BY ALL)
    SELECT ticker, exchange, company_id, CASE WHEN has = company_id THEN 'exists' WHEN has IS NOT NULL OR company_id <> min(company_id) OVER (PARTITION BY ticker, exchange) THEN 'conflict' ELSE 'created' END AS verdict
    FROM w LEFT JOIN t USING (ticker, exchange)"""
)
def ticker_mapping(spark: SparkSession, root: str) -> DataFrame:
    """Tickers seen in snapshots: known, to be created, or taken by another company."""
    seen = table(spark, root, "ticker_snapshots").select(F.upper(F.trim("ticker")).alias("ticker"), "exchange", "company_id")
    return get_or_create(table(spark, root, "tickers"), seen, ["ticker", "exchange"], "company_id")


def _sql_csv(columns: list[str], source: str, key: str) -> str:
    return f"SELECT {key}, concat_ws(',', " + ", ".join(_sql_field("array_to_string(tags, ';')" if c == "tags" else f"{c}::VARCHAR") for c in columns) + f") AS line FROM {source}"


@R.add(_sql_csv(CONCEPT_HEADER, "concept_normalization_overrides", "company_id"))
def concept_csv_export(spark: SparkSession, root: str) -> DataFrame:
    """Concept rules as CSV records."""
    _, lines = export_csv(table(spark, root, "concept_normalization_overrides"), "concept-normalization-overrides")
    return lines.where("line_no > 0").select("company_id", "line")


@R.add(
    f"""WITH {SQL_RECORDS}, r AS (SELECT j.line_id, l.line_no AS row_no, reason, try_cast({_V.format("company_id")} AS INT) AS company_id, {_T("axis")}, {_T("member")}, {_T("member_label")}
        FROM judged j JOIN raw_override_lines l USING (line_id) WHERE l.file_name = 'dimension-normalization-overrides')
    SELECT line_id, row_no, CASE WHEN reason IS NOT NULL OR coalesce(trim(r.axis), '') = '' THEN 'error' WHEN EXISTS (SELECT 1 FROM dimension_normalization_overrides d WHERE d.company_id = r.company_id
        AND d.axis IS NOT DISTINCT FROM r.axis AND d.member IS NOT DISTINCT FROM r.member AND d.member_label IS NOT DISTINCT FROM r.member_label) THEN 'updated' ELSE 'created' END AS outcome,
        coalesce(reason, CASE WHEN coalesce(trim(r.axis), '') = '' THEN 'axis is missing' END) AS message FROM r"""
)
def dimension_rule_import(spark: SparkSession, root: str) -> DataFrame:
    """What becomes of each record of the dimension-rule files."""
    name = "dimension-normalization-overrides"
    header, key = RULE_FILES[name]
    lines = table(spark, root, "raw_override_lines").where(F.col("file_name") == name).select("line_id", "line_no")
    records = override_records(spark, root, header).join(lines, "line_id")
    return import_rules(records, table(spark, root, "dimension_normalization_overrides"), key, "line_no").select("line_id", "row_no", "outcome", "message")


@R.add("SELECT company_id, concept, statement, row_number() OVER (PARTITION BY company_id ORDER BY updated_at DESC NULLS LAST, concept, statement) AS place FROM concept_normalization_overrides")
def rules_by_update(spark: SparkSession, root: str) -> DataFrame:
    """Each company's concept rules, the last updated first."""
    w = Window.partitionBy("company_id").orderBy(F.desc_nulls_last("updated_at"), "concept", "statement")
    return table(spark, root, "concept_normalization_overrides").select("company_id", "concept", "statement", F.row_number().over(w).cast("bigint").alias("place"))
