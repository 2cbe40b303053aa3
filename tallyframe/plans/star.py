"""Fact-shaped rows made from the order tables: concepts and brands that change their names from era to era.

They exercise value matching and chains, for which the warehouse tables hold no case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def star_facts(spark: SparkSession, root: str) -> DataFrame:
    """One fact per company, type (and brand group) and quarter, with the same quarter of the year before as comparative."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    li = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", cents.alias("cents"))
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    c = table(spark, root, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id"))
    p = table(spark, root, "part").select("p_partkey", F.col("p_type").alias("t"), (F.substring("p_brand", 7, 9).cast("int") % 3).alias("b"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    fine = j.groupBy("company_id", "t", "b", "y", "q").agg(F.sum("cents").alias("v"))
    key = ["company_id", "t", "b", "y", "q"]
    both = fine.unionByName(fine.groupBy("company_id", "t", "y", "q").agg(F.sum("v").alias("v")).withColumn("b", F.lit(-1))).select(*key, "v")
    before = both.select("company_id", "t", "b", (F.col("y") + 1).alias("y"), "q", F.col("v").alias("c"))
    r = both.join(before, key, "left")
    era = F.when(F.col("y") < 1996, "a").when(F.col("y") < 1998, "b").otherwise("c")
    end = lambda y: F.last_day(F.make_date(y, F.col("q") * 3, F.lit(1)))
    whole = F.col("b") < 0
    return r.select(
        (F.col("company_id") * 1000000 + F.col("y") * 10 + F.col("q")).cast("bigint").alias("id"), "company_id",
        (F.col("company_id") * 1000 + (F.col("y") - 1990) * 4 + F.col("q")).alias("filing_id"), F.when(F.col("q") == 4, "10-K").otherwise("10-Q").alias("form_type"),
        F.lit("Income Statement").alias("statement"), F.when(whole, F.concat_ws("_", "t", era)).otherwise(F.col("t")).alias("concept"), F.col("t").alias("label"),
        F.when(whole, "").otherwise("brand").alias("axis"), F.when(whole, "").otherwise(F.concat(F.lit("B"), F.col("b").cast("string"), era)).alias("member"),
        F.when(whole, "").otherwise(F.concat(F.lit("Brand "), F.col("b").cast("string"), era)).alias("member_label"), F.col("v").cast("decimal(28,6)").alias("value"),
        F.col("c").cast("decimal(28,6)").alias("comparative_value"), F.lit(1).cast("decimal(9,4)").alias("weight"), end(F.col("y")).alias("period_end"),
        F.when(F.col("c").isNotNull(), end(F.col("y") - 1)).alias("comparative_period_end"),
    )


_END = "last_day(make_date({}, q * 3, 1))"
_ERA = "CASE WHEN y < 1996 THEN 'a' WHEN y < 1998 THEN 'b' ELSE 'c' END"
SQL_STAR = f"""
    star0 AS (SELECT c_nationkey AS company_id, p_type AS t, substr(p_brand, 7)::INT % 3 AS b, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, sum(round(l_extendedprice * 100)::BIGINT) AS v
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY GROUPING SETS ((1, 2, 3, 4, 5), (1, 2, 4, 5))),
    star1 AS (SELECT n.company_id, n.t, coalesce(n.b, -1) AS b, n.y, n.q, n.v, o.v AS c FROM star0 n LEFT JOIN star0 o ON o.company_id = n.company_id AND o.t = n.t AND o.b IS NOT DISTINCT FROM n.b AND o.y = n.y - 1 AND o.q = n.q),
    base AS (SELECT (company_id * 1000000 + y * 10 + q)::BIGINT AS id, company_id, company_id * 1000 + (y - 1990) * 4 + q AS filing_id, CASE q WHEN 4 THEN '10-K' ELSE '10-Q' END AS form_type,
                    'Income Statement' AS statement, CASE WHEN b < 0 THEN t || '_' || {_ERA} ELSE t END AS concept, t AS label, CASE WHEN b < 0 THEN '' ELSE 'brand' END AS axis,
                    CASE WHEN b < 0 THEN '' ELSE 'B' || b || {_ERA} END AS member, CASE WHEN b < 0 THEN '' ELSE 'Brand ' || b || {_ERA} END AS member_label, v::DECIMAL(28,6) AS value,
                    c::DECIMAL(28,6) AS comparative_value, 1::DECIMAL(9,4) AS weight, {_END.format("y")} AS period_end, CASE WHEN c IS NOT NULL THEN {_END.format("y - 1")} END AS comparative_period_end FROM star1)"""
