"""Queries of the general data-preparation operators: wide tables, hierarchies, rejected records, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import concept_key, folded
from ..operators.attributes import empty_cells, widen
from ..operators.hierarchy import breaks, descendants_of, nested_sets
from ..operators.history import versions
from ..operators.rejects import load_records
from ..sources.tables import table
from .registry import Registry

R = Registry()

# -- attribute-value rows into wide tables --------------------------------------------------------------------------

#: Column of the wide table -> concept, as the result spells it.
WIDE = {
    "net_revenue": "core-fin:NetRevenue",
    "cost_of_sales": "core-fin:CostOfSales",
    "operating_profit": "core-fin:OperatingProfit",
    "net_profit": "core-fin:NetProfit",
    "cash_held": "core-fin:CashHeld",
    "all_assets": "core-fin:AllAssets",
    "all_liabilities": "core-fin:AllLiabilities",
    "operating_flow": "core-fin:OperatingFlow",
}
SQL_KEY = "regexp_replace(lower(regexp_replace(concept, '[\\s\\x{00A0}]+', '', 'g')), '^([^:_]*)[:_]', '\\1:')"


def wide_facts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One row per company and period end of the undimensioned, non-abstract facts; of repeated facts the last loaded holds."""
    facts = table(spark, root, "financial_facts").where("not is_abstract and axis = ''")
    columns = {name: (concept.lower(), kind) for name, concept in WIDE.items()}
    return widen(facts, ["company_id", "period_end"], concept_key("concept"), F.col("value"), [F.col("id")], columns)


@R.add(
    f"""
    WITH f AS (SELECT company_id, period_end, {SQL_KEY} AS k, value FROM financial_facts WHERE NOT is_abstract AND axis = ''),
         c(concept) AS (VALUES {", ".join(f"('{c}')" for c in WIDE.values())}),
         full_cells AS (SELECT DISTINCT company_id, period_end, k FROM f WHERE value IS NOT NULL)
    SELECT r.company_id, strftime(r.period_end, '%Y-%m-%d') AS period_end, c.concept
    FROM (SELECT DISTINCT company_id, period_end FROM f) r CROSS JOIN c
    WHERE NOT EXISTS (SELECT 1 FROM full_cells x WHERE x.company_id = r.company_id AND x.period_end = r.period_end AND x.k = lower(c.concept))"""
)
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Empty cells of the wide table."""
    wide = wide_facts(spark, root, "decimal(28,6)")
    return empty_cells(wide, ["company_id", "period_end"], WIDE).select(
        "company_id", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.col("attribute").alias("concept")
    )


@R.add(
    f"""
    WITH f AS (SELECT company_id, period_end, id, {SQL_KEY} AS k, value FROM financial_facts WHERE NOT is_abstract AND axis = ''),
         m AS (SELECT company_id, period_end, {", ".join(f"arg_max(value, id) FILTER (k = '{c.lower()}' AND value IS NOT NULL) AS {n}" for n, c in WIDE.items())}
               FROM f GROUP BY ALL)
    SELECT company_id, period_end, {", ".join(f"try_cast({n} AS DECIMAL(20,6)) AS {n}" for n in WIDE)},
           CAST({" + ".join(f"(CASE WHEN {n} IS NOT NULL AND try_cast({n} AS DECIMAL(20,6)) IS NULL THEN 1 ELSE 0 END)" for n in WIDE)} AS INTEGER) AS failed
    FROM m"""
)
def p1_wide(spark: SparkSession, root: str) -> DataFrame:
    """The wide table itself, with the number of values its column type could not hold."""
    return wide_facts(spark, root, "decimal(20,6)").withColumn("failed", F.size("cast_failures")).drop("cast_failures")


# -- parent-child links to full hierarchies -------------------------------------------------------------------------


def links(spark: SparkSession, root: str) -> DataFrame:
    """All three kinds of links as (link, scope, name) -> (link, scope, up)."""
    q = table(spark, root, "quarterly_financials").select(
        F.lit("quarterly_abstract").alias("link"), F.lit("").alias("scope"), F.col("id").cast("string").alias("name"), F.col("abstract_id").cast("string").alias("up")
    )
    o = table(spark, root, "concept_normalization_overrides").select(
        F.concat_ws("/", F.col("company_id").cast("string"), "statement", F.lit("")).alias("scope"),
        F.col("concept").alias("name"),
        F.explode(F.create_map(F.lit("override_parent"), "parent_concept", F.lit("override_abstract"), "abstract_concept")).alias("link", "up"),
    )
    return q.unionByName(o.select("link", "scope", "name", "up"))


SQL_LINKS = """
    links AS (
        SELECT 'quarterly_abstract' AS link, '' AS scope, id::VARCHAR AS name, abstract_id::VARCHAR AS up FROM quarterly_financials
        UNION ALL SELECT 'override_parent', company_id || '/' || statement || '/', concept, parent_concept FROM concept_normalization_overrides
        UNION ALL SELECT 'override_abstract', company_id || '/' || statement || '/', concept, abstract_concept FROM concept_normalization_overrides),
    sound AS (SELECT l.link, l.scope, l.name, l.up FROM links l JOIN links p ON p.link = l.link AND p.scope = l.scope AND p.name = l.up),
    reach(link, scope, name, anc) AS (
        SELECT link, scope, name, up FROM sound
        UNION SELECT r.link, r.scope, r.name, s.up FROM reach r JOIN sound s ON s.link = r.link AND s.scope = r.scope AND s.name = r.anc),
    cyc AS (SELECT link, scope, name FROM reach WHERE name = anc)"""


@R.add(
    f"""
    WITH RECURSIVE {SQL_LINKS}
    SELECT link, scope || name AS node, 'orphan' AS verdict FROM links l
    WHERE up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links p WHERE p.link = l.link AND p.scope = l.scope AND p.name = l.up)
    UNION ALL SELECT link, scope || name, 'in_cycle' FROM cyc
    UNION ALL SELECT DISTINCT r.link, r.scope || r.name, 'below_cycle' FROM reach r JOIN cyc c ON c.link = r.link AND c.scope = r.scope AND c.name = r.anc
    WHERE NOT EXISTS (SELECT 1 FROM cyc x WHERE x.link = r.link AND x.scope = r.scope AND x.name = r.name)"""
)
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the three kinds of links without a sound path."""
    b = breaks(links(spark, root), ["link", "scope", "name"], ["link", "scope", "up"])
    return b.select("link", F.concat("scope", "name").alias("node"), "verdict")


@R.add(
    f"""
    WITH RECURSIVE {SQL_LINKS},
    tree(link, scope, name, depth, root, path, orphan) AS (
        SELECT link, scope, name, 0, name, name, up IS NOT NULL FROM links l
        WHERE NOT EXISTS (SELECT 1 FROM sound s WHERE s.link = l.link AND s.scope = l.scope AND s.name = l.name)
        UNION ALL SELECT s.link, s.scope, s.name, t.depth + 1, t.root, t.path || '/' || s.name, t.orphan
        FROM tree t JOIN sound s ON s.link = t.link AND s.scope = t.scope AND s.up = t.name),
    below AS (SELECT link, scope, anc, count(*) AS n FROM reach GROUP BY ALL)
    SELECT t.link, t.scope || t.name AS node, t.depth::BIGINT AS depth, t.root, t.path, coalesce(b.n, 0)::BIGINT AS descendants, t.orphan AS under_orphan
    FROM tree t LEFT JOIN below b ON b.link = t.link AND b.scope = t.scope AND b.anc = t.name"""
)
def p3_tree(spark: SparkSession, root: str) -> DataFrame:
    """Depth, root, path and number of descendants of every row that has a sound path."""
    t = nested_sets(links(spark, root), ["link", "scope", "name"], ["link", "scope", "up"], "name")
    return t.select("link", F.concat("scope", "name").alias("node"), "depth", "root", "path", "descendants", F.col("orphan").alias("under_orphan"))


@R.add(
    f"""
    WITH RECURSIVE {SQL_LINKS}
    SELECT anc::BIGINT AS ancestor, name::BIGINT AS descendant FROM reach r
    WHERE link = 'quarterly_abstract' AND anc::BIGINT % 20 = 0 AND NOT EXISTS (SELECT 1 FROM cyc c WHERE c.link = r.link AND c.name = r.anc)
      AND NOT EXISTS (SELECT 1 FROM reach q JOIN cyc c ON c.link = q.link AND c.name = q.anc WHERE q.link = r.link AND q.name = r.anc)"""
)
def p3_descendants(spark: SparkSession, root: str) -> DataFrame:
    """All descendants of the rows of quarterly_financials whose id is divisible by 20, by preorder ranges."""
    t = nested_sets(table(spark, root, "quarterly_financials"), ["id"], ["abstract_id"], "id")
    return descendants_of(t, t.where("id % 20 = 0"), "id")


def link_trees(spark: SparkSession, root: str) -> DataFrame:
    """Nested sets of all three kinds of links, with the node's full name."""
    t = nested_sets(links(spark, root), ["link", "scope", "name"], ["link", "scope", "up"], "name")
    return t.withColumn("node", F.concat("scope", "name"))


@R.add()
def p3_ranges(spark: SparkSession, root: str) -> DataFrame:
    """The whole descendant relation in linear size: below a node are the nodes of its link and tree with lft < their lft <= rgt.

    A tree has the name of its top node. Siblings may stand in any order, so SQL has no one answer.
    """
    return link_trees(spark, root).select("link", "node", F.concat("scope", "root").alias("tree"), "lft", "rgt")


@R.add(
    f"""
    WITH RECURSIVE {SQL_LINKS},
    lost AS (SELECT link, scope, name FROM cyc UNION SELECT r.link, r.scope, r.name FROM reach r JOIN cyc c ON c.link = r.link AND c.scope = r.scope AND c.name = r.anc)
    SELECT link, scope || anc AS ancestor, scope || name AS descendant FROM reach r
    WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.link = r.link AND l.scope = r.scope AND l.name = r.anc)"""
)
def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    """All descendants of every row that has a sound path, for the three kinds of links."""
    t = link_trees(spark, root).withColumn("at", F.struct("link", "node"))
    pairs = descendants_of(t, t, "at")
    return pairs.select("ancestor.link", F.col("ancestor.node").alias("ancestor"), F.col("descendant.node").alias("descendant"))


# -- records that fail to parse -------------------------------------------------------------------------------------

#: Fields of the override files that are not plain text.
RECORD_KINDS = {
    "company_id": "whole",
    "to_weight": "decimal",
    "weight": "decimal",
    "is_abstract": "flag",
    "is_global": "flag",
    "from_period": "date",
    "to_period": "date",
    "tags": "tags",
}
#: Fields of the three override files together.
RECORD_COLUMNS = (
    "id company_id concept statement axis member member_label label form_type from_period to_period to_concept to_axis to_member to_member_label to_weight "
    "weight normalized_label is_abstract is_global abstract_concept parent_concept description unit normalized_axis_label normalized_member_label tags"
).split()


def override_records(spark: SparkSession, root: str, columns: list[str], decided: str | None = None) -> DataFrame:
    """The uploaded override records through `load_records`."""
    return load_records(table(spark, root, "raw_override_lines"), "line_id", ["file_name", "batch_no"], "line_no", "line", RECORD_KINDS, columns, decided)


SQL_FIELD_TESTS = {
    "company_id": "NOT regexp_full_match({x}, '[+-]?[0-9]+')",
    "to_weight": r"NOT ({x} = '' OR regexp_full_match({x}, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'))",
    "is_abstract": "lower({x}) NOT IN ('', 'true', '1', 'yes', 't', 'false', '0', 'no', 'f')",
    "from_period": r"NOT ({x} = '' OR (regexp_full_match({x}, '\d{{4}}-\d\d-\d\d') AND try_cast({x} AS DATE) IS NOT NULL))",
    "tags": r"NOT ({x} = '' OR regexp_full_match({x}, '[A-Za-z0-9-]+(\s*;\s*[A-Za-z0-9-]+)*'))",
}
SQL_FIELD_TESTS |= {"weight": SQL_FIELD_TESTS["to_weight"], "is_global": SQL_FIELD_TESTS["is_abstract"], "to_period": SQL_FIELD_TESTS["from_period"]}
_x = "coalesce(list_extract(vals, list_position(names, '{n}')), '')"
_has = "list_contains(names, '{n}')"
SQL_RECORDS = rf"""
    heads AS (SELECT file_name, batch_no, list_transform(string_split(regexp_replace(line, '^\x{{FEFF}}|\r$', '', 'g'), ','), lambda n: trim(n)) AS names
              FROM raw_override_lines WHERE line_no = 1),
    recs AS (SELECT line_id, names, regexp_replace(line, '\r$', '') AS rec FROM raw_override_lines JOIN heads USING (file_name, batch_no)
             WHERE line_no <> 1 AND NOT regexp_full_match(line, '[\s\x{{00A0}}]*')),
    cut AS (SELECT line_id, names, rec, regexp_full_match(replace(replace(rec, chr(10), ' '), chr(13), ' '), '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') AS sound,
                   list_transform(regexp_extract_all(',' || rec, ',("(?:[^"]|"")*"|[^",]*)', 1),
                       lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END) AS raws FROM recs),
    flat AS (SELECT *, list_transform(raws, lambda f: regexp_replace(f, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')) AS vals FROM cut),
    judged AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(vals) <> len(names) THEN 'columns'
        WHEN {" OR ".join("(" + _has.format(n=n) + " AND " + t.format(x=_x.format(n=n)) + ")" for n, t in SQL_FIELD_TESTS.items())} THEN 'value' END AS reason FROM flat)"""


@R.add(f"WITH {SQL_RECORDS} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Records that cannot be loaded, with the first reason that holds."""
    return override_records(spark, root, RECORD_COLUMNS).where("reason is not null").select("line_id", "reason")


@R.add()
def p5_decided(spark: SparkSession, root: str) -> DataFrame:
    """How many records the reader itself refused, and how many a check of what it let pass, by reason."""
    r = override_records(spark, root, RECORD_COLUMNS, "decided").where("reason is not null")
    return r.groupBy("reason", "decided").agg(F.count("*").alias("records"))


def _flag(n: str) -> str:
    x = _x.format(n=n)
    return f"CASE WHEN lower({x}) IN ('true', '1', 'yes', 't') THEN true WHEN {x} <> '' THEN false END AS {n}"


@R.add(
    f"""
    WITH {SQL_RECORDS}
    SELECT line_id, try_cast({_x.format(n="company_id")} AS BIGINT) AS company_id, {_flag("is_abstract")}, {_flag("is_global")},
           {", ".join(f"try_cast({_x.format(n=n)} AS DOUBLE) AS {n}" for n in ("weight", "to_weight"))},
           {", ".join(f"try_cast({_x.format(n=n)} AS DATE) AS {n}" for n in ("from_period", "to_period"))},
           {", ".join(f"CASE {_x.format(n=n).replace('vals', 'raws')} WHEN '' THEN NULL WHEN '__EMPTY__' THEN '' ELSE {_x.format(n=n).replace('vals', 'raws')} END AS {n}" for n in ("concept", "axis", "member_label", "description"))},
           nullif(array_to_string(regexp_split_to_array({_x.format(n="tags")}, '\\s*;\\s*'), ';'), '') AS tags
    FROM judged WHERE reason IS NULL"""
)
def p5_rows(spark: SparkSession, root: str) -> DataFrame:
    """The sound records of all files, typed."""
    cols = ["company_id", "is_abstract", "is_global", "weight", "to_weight", "from_period", "to_period", "concept", "axis", "member_label", "description", "tags"]
    rows = override_records(spark, root, cols).where("reason is null").drop("reason")
    return rows.withColumn("tags", F.array_join("tags", ";"))


# -- histories of changing attributes -------------------------------------------------------------------------------


def ticker_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions of each ticker from the month-end snapshots."""
    t = table(spark, root, "ticker_snapshots")
    return versions(t, ["id"], "snapshot_date", {"ticker": folded("ticker"), "status": folded("status")}, ["loaded_at"], block="year")


def entity_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions of each filing entity from its updates."""
    t = table(spark, root, "filing_entity_updates")
    return versions(t, ["id"], "changed_at", {"status": folded("status")}, ["received_at", "update_id"], block="year")


def _sql_versions(entity: str, source: str, moment: str, attrs: list[str], last: str, fmt: str) -> str:
    fold = {a: f"lower(regexp_replace({a}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'))" for a in attrs}
    w = f"OVER (PARTITION BY id ORDER BY {moment})"
    return f"""
        SELECT '{entity}' AS entity, id, strftime({moment}, '{fmt}') AS valid_from, {moment}::TIMESTAMP AS since, {", ".join(f"{a}" for a in attrs)} FROM (
            SELECT *, row_number() {w} AS rn, {", ".join(f"lag({a}) {w} AS p_{a}" for a in attrs)} FROM (
                SELECT id, {moment}, {", ".join(f"last_value(x_{a} IGNORE NULLS) {w} AS {a}" for a in attrs)} FROM (
                    SELECT DISTINCT ON (id, {moment}) id, {moment}, {", ".join(f"{x} AS x_{a}" for a, x in fold.items())} FROM {source} ORDER BY id, {moment}, {last})))
        WHERE rn = 1 OR {" OR ".join(f"{a} IS DISTINCT FROM p_{a}" for a in attrs)}"""


_TICKERS = _sql_versions("ticker", "ticker_snapshots", "snapshot_date", ["ticker", "status"], "loaded_at DESC, lower(trim(ticker)) DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST", "%Y-%m-%d")
_ENTITIES = _sql_versions("filing_entity", "filing_entity_updates", "changed_at", ["status"], "received_at DESC, update_id DESC", "%Y-%m-%d %H:%M:%S")


@R.add(f"SELECT entity, id, valid_from FROM ({_TICKERS}) UNION ALL SELECT entity, id, valid_from FROM ({_ENTITIES})")
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """One row per version of a ticker or filing entity."""
    t, e = ticker_versions(spark, root), entity_versions(spark, root)
    return t.select(F.lit("ticker").alias("entity"), "id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from")).unionByName(
        e.select(F.lit("filing_entity").alias("entity"), "id", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))
    )


@R.add(
    f"""
    SELECT entity, id, since AS valid_from, lead(since) OVER (PARTITION BY entity, id ORDER BY since) AS valid_to, ticker, status,
           CASE WHEN row_number() OVER (PARTITION BY entity, id ORDER BY since) = 1 THEN 'inserted' ELSE 'changed' END AS change
    FROM (SELECT entity, id, since, ticker, status FROM ({_TICKERS}) UNION ALL SELECT entity, id, since, NULL, status FROM ({_ENTITIES}))"""
)
def p6_versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions with the time each was valid."""
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_to")]
    t, e = ticker_versions(spark, root), entity_versions(spark, root).withColumn("ticker", F.lit(None).cast("string"))
    return t.select(F.lit("ticker").alias("entity"), "id", *ntz, "ticker", "status", "change").unionByName(
        e.select(F.lit("filing_entity").alias("entity"), "id", *ntz, "ticker", "status", "change")
    )
