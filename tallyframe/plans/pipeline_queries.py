"""Queries of the normalization pipeline, stage by stage, and the SQL they are checked against."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graphs import components
from ..operators.matching import ambiguous_ids
from ..operators.series import residual, undo_running_total
from . import normalization as N
from .curation import SQL_RECORDS
from ..session import cut
from .registry import Registry
from .star import SQL_STAR, star_facts
from .warehouse import Stages, facts, filings

R = Registry()


@lru_cache(maxsize=2)
def _stages(spark: SparkSession, application: str, root: str) -> Stages:
    return Stages.of(spark, root)


def stages(spark: SparkSession, root: str) -> Stages:
    """The pipeline over `root`; queries of one session share the stages they have in common."""
    return _stages(spark, spark.sparkContext.applicationId, root)


def _key(c: str) -> str:
    return f"regexp_replace(lower(regexp_replace({c}, '[\\s\\x{{00A0}}]+', '', 'g')), '^([^:_]*)[:_]', '\\1:')"


def _text(n: str) -> str:
    v = f"raws[list_position(names, '{n}')]"
    return f"CASE {v} WHEN '' THEN NULL WHEN '__EMPTY__' THEN '' ELSE {v} END"


_V = "trim(raws[list_position(names, '{}')])"
_FORM = "regexp_replace(upper(trim(form_type)), '^(10-[KQ])/?A$', '\\1/A')"
SQL_FACTS = f"""
    ff AS (SELECT * REPLACE ({_key("concept")} AS concept, {_FORM} AS form_type) FROM financial_facts),
    fil AS (SELECT * REPLACE ({_FORM} AS form_type) FROM filings),
    cr AS (SELECT * REPLACE ({_key("concept")} AS concept, {_key("parent_concept")} AS parent_concept, {_key("abstract_concept")} AS abstract_concept)
           FROM concept_normalization_overrides)"""
SQL_RULES = f"""
    {SQL_RECORDS},
    fr AS (SELECT j.line_id AS rid, try_cast({_V.format("company_id")} AS INT) AS rco, {_key(_text("concept"))} AS rconcept, {_text("statement")} AS rstatement,
                  {", ".join(f"{_text(c)} AS r_{c}" for c in ("axis", "member", "label", "form_type"))}, try_cast({_V.format("from_period")} AS DATE) AS d0,
                  try_cast({_V.format("to_period")} AS DATE) AS d1, {_key(_text("to_concept"))} AS to_concept, {", ".join(f"{_text(c)} AS {c}" for c in ("to_axis", "to_member", "to_member_label"))},
                  try_cast({_V.format("to_weight")} AS DOUBLE)::DECIMAL(9,4) AS to_weight,
                  lower({_V.format("is_global")}) IN ('true', '1', 'yes', 't') AND try_cast({_V.format("company_id")} AS INT) = 0 AS for_all
           FROM judged j JOIN raw_override_lines l USING (line_id) WHERE reason IS NULL AND l.file_name = 'financial-facts-overrides'),
    hit AS (SELECT ff.id, fr.* FROM ff JOIN fr ON rstatement = statement AND rconcept = concept
            WHERE (rco = company_id OR for_all) AND coalesce(r_axis = axis, r_axis IS NULL) AND coalesce(r_member = member, r_member IS NULL) AND (r_label IS NULL OR r_label = label)
              AND (r_form_type IS NULL OR r_form_type = form_type) AND period_end >= coalesce(d0, period_end) AND period_end <= coalesce(d1, period_end)
            QUALIFY row_number() OVER (PARTITION BY ff.id ORDER BY CASE WHEN rco = company_id THEN 0 ELSE 1 END,
                len(list_filter([r_axis IS NOT NULL, r_member IS NOT NULL, r_label IS NOT NULL, r_form_type IS NOT NULL, d0 IS NOT NULL, d1 IS NOT NULL], lambda x: x)) DESC,
                date_diff('day', d0, d1) NULLS LAST, rid DESC) = 1)"""
SQL_BASE = f"""
    {SQL_FACTS}, {SQL_RULES},
    eff AS (SELECT ff.* REPLACE (coalesce(to_concept, concept) AS concept, coalesce(to_axis, axis) AS axis, coalesce(to_member, member) AS member,
                 coalesce(to_member_label, member_label) AS member_label, coalesce(to_weight, weight) AS weight) FROM ff LEFT JOIN hit USING (id)),
    base AS (SELECT * EXCLUDE (bad) FROM (SELECT *, min(value) OVER c < max(value) OVER c AS bad FROM eff WINDOW c AS (PARTITION BY {", ".join(N.CONFLICT_KEYS)})) WHERE bad IS NOT TRUE)"""
SQL_GROUPS = """
    grp AS (SELECT company_id, statement, concept, list(label ORDER BY period_end DESC, id DESC)[1] AS nl, max(period_end) AS last_end,
                   md5(company_id || '|' || statement || '|' || concept || '|grouping') AS gid
            FROM base WHERE axis = '' GROUP BY ALL HAVING count(DISTINCT label) > 1 AND count(DISTINCT (filing_id, label)) = count(DISTINCT filing_id))"""
SQL_CANDIDATES = """
    lab AS (SELECT b.*, coalesce(g.nl, label) AS nlabel, value * weight AS amt, comparative_value * weight AS ear
            FROM base b LEFT JOIN grp g USING (company_id, statement, concept) WHERE axis = ''),
    cand AS (SELECT a.company_id, a.statement, a.concept AS concept1, b.concept AS concept2, a.period_end AS period_end1, b.period_end AS period_end2, a.nlabel AS label1, b.nlabel AS label2
             FROM lab a JOIN lab b ON a.company_id = b.company_id AND a.form_type = b.form_type AND a.statement = b.statement AND a.ear = b.amt AND a.comparative_period_end = b.period_end
             WHERE a.concept <> b.concept AND a.period_end > b.period_end
             QUALIFY row_number() OVER (PARTITION BY a.company_id, a.statement, a.concept, b.concept, a.period_end, b.period_end ORDER BY a.id, b.id) = 1)"""
SQL_APART = """
    apart AS (SELECT c.* FROM cand c
              ANTI JOIN base x ON (x.company_id, x.statement, x.concept, x.period_end) = (c.company_id, c.statement, c.concept2, c.period_end1)
              ANTI JOIN base y ON (y.company_id, y.statement, y.concept, y.period_end) = (c.company_id, c.statement, c.concept1, c.period_end2))"""


def _sql_sound(src: str) -> str:
    return f"""
    sound AS (SELECT a.* FROM {src} a ANTI JOIN (
        SELECT x.company_id, x.statement, x.concept1, x.concept2 FROM {src} x JOIN {src} y ON x.company_id = y.company_id AND x.statement = y.statement
        WHERE (x.concept1 = y.concept1 AND x.concept2 = y.concept2 AND (x.period_end1 = y.period_end2 OR x.period_end2 = y.period_end1))
           OR (x.concept1 = y.concept2 AND x.concept2 = y.concept1 AND x.period_end1 = y.period_end1 AND x.period_end2 = y.period_end2)) w
        ON (a.company_id, a.statement, a.concept1, a.concept2) = (w.company_id, w.statement, w.concept1, w.concept2))"""


def _sql_chain(src: str) -> str:
    return f"""
    walk(company_id, statement, concept, nl, here, root, gid) AS (
        SELECT company_id, statement, concept1, label1, period_end1, period_end1, md5(company_id || '|' || statement || '|' || concept1 || '|chaining') FROM {src}
        UNION SELECT w.company_id, w.statement, m.concept2, w.nl, m.period_end2, w.root, w.gid
        FROM walk w JOIN {src} m ON m.company_id = w.company_id AND m.statement = w.statement AND m.concept1 = w.concept AND m.period_end1 <= w.here),
    chained AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY company_id, statement, concept ORDER BY root DESC, nl, gid) = 1)"""


def _sql_concepts(base: str) -> str:
    return f"""
    {base}, {SQL_GROUPS}, {SQL_CANDIDATES}, {SQL_APART}, {_sql_sound("apart")}, {_sql_chain("sound")},
    cn0 AS (SELECT company_id, statement, concept, nl, gid, 'chaining' AS source FROM chained
            UNION ALL SELECT g.company_id, g.statement, g.concept, g.nl, g.gid, 'grouping' FROM grp g ANTI JOIN chained c USING (company_id, statement, concept)),
    said AS (SELECT gid, max(o.normalized_label) AS a_l, max(o.weight) AS a_w, max(o.unit) AS a_u FROM cn0 JOIN cr o USING (statement, concept) WHERE o.is_global GROUP BY gid),
    own AS (SELECT gid, max(o.normalized_label) AS o_l, max(o.weight) AS o_w, max(o.unit) AS o_u FROM cn0 JOIN cr o USING (company_id, statement, concept) GROUP BY gid),
    cn AS (SELECT company_id, statement, concept, coalesce(o_l, a_l, nl) AS normalized_label, coalesce(o_w, a_w) AS weight, coalesce(o_u, a_u) AS unit, gid AS group_id, source,
                  coalesce(o_l, a_l) IS NOT NULL AS overridden FROM cn0 LEFT JOIN own USING (gid) LEFT JOIN said USING (gid))"""


SQL_CONCEPTS = _sql_concepts(SQL_BASE)
SQL_STAR_BASE = f"{SQL_FACTS}, {SQL_STAR}"


@R.add(f"WITH {SQL_FACTS}, {SQL_RULES} SELECT id, coalesce(to_concept, concept) AS concept, coalesce(to_axis, axis) AS axis, coalesce(to_member, member) AS member, "
       "coalesce(to_member_label, member_label) AS member_label, coalesce(to_weight, weight) AS weight, rid AS fact_override_id FROM ff JOIN hit USING (id)")  # fmt: skip
def rule_best_match(spark: SparkSession, root: str) -> DataFrame:
    """S1: facts changed by the best-fitting override rule."""
    return stages(spark, root).stage("overridden").drop("company_id", "statement")


@R.add(f"WITH {SQL_BASE} SELECT id, concept, axis, member, member_label, weight FROM base")
def facts_base(spark: SparkSession, root: str) -> DataFrame:
    """S2: facts with rules applied and contradictions removed."""
    return stages(spark, root).stage("base").select("id", "concept", "axis", "member", "member_label", "weight")


@R.add(f"WITH {SQL_FACTS} SELECT id FROM (SELECT id, min(value) OVER c < max(value) OVER c AS bad FROM ff WINDOW c AS (PARTITION BY {', '.join(N.CONFLICT_KEYS)})) WHERE bad")
def conflict_ids(spark: SparkSession, root: str) -> DataFrame:
    """Facts that contradict another of the same line, period and form."""
    return ambiguous_ids(facts(spark, root), N.CONFLICT_KEYS, "value", "id")


@R.add(f"WITH RECURSIVE {SQL_BASE}, {SQL_GROUPS} SELECT company_id, statement, concept, nl AS normalized_label, last_end AS group_max_period_end, gid AS group_id FROM grp")
def label_grouping(spark: SparkSession, root: str) -> DataFrame:
    """S3: concepts with several labels over time."""
    return N.label_groups(stages(spark, root).stage("base")).drop("source")


@R.add(f"WITH {SQL_STAR_BASE}, {SQL_GROUPS}, {SQL_CANDIDATES} SELECT * FROM cand")
def candidate_matches(spark: SparkSession, root: str) -> DataFrame:
    """S3: pairs of concepts whose amounts match from period to period, coexisting ones included."""
    base = cut(star_facts(spark, root))
    return N.concept_matches(base, N.label_groups(base), together=True)


@R.add(f"WITH {SQL_STAR_BASE}, {SQL_GROUPS}, {SQL_CANDIDATES}, {SQL_APART} SELECT * FROM apart")
def candidate_matches_apart(spark: SparkSession, root: str) -> DataFrame:
    """S3: the same without concepts that are both reported in one of the two periods."""
    base = cut(star_facts(spark, root))
    return N.concept_matches(base, N.label_groups(base))


@R.add(f"WITH {SQL_STAR_BASE}, {SQL_GROUPS}, {SQL_CANDIDATES}, {_sql_sound('cand')} SELECT * FROM sound")
def false_match_drop(spark: SparkSession, root: str) -> DataFrame:
    """S3: candidate pairs without recurring and mirrored ones."""
    return N.sound_matches(candidate_matches(spark, root))


@R.add(f"WITH RECURSIVE {SQL_STAR_BASE}, {SQL_GROUPS}, {SQL_CANDIDATES}, {_sql_chain('cand')} SELECT company_id, statement, concept, nl AS normalized_label, root AS group_max_period_end, gid AS group_id FROM chained")
def concept_chain(spark: SparkSession, root: str) -> DataFrame:
    """S3: chains along all candidate pairs."""
    return N.concept_chains(candidate_matches(spark, root)).drop("source")


@R.add(f"WITH RECURSIVE {SQL_CONCEPTS} SELECT * FROM cn")
def concept_normalization(spark: SparkSession, root: str) -> DataFrame:
    """S3: normalized concepts with what the rules say about their groups."""
    return stages(spark, root).stage("concepts")


SQL_ONE_RULE = """
    rule1 AS (SELECT co.company_id AS for_co, r.* FROM (SELECT DISTINCT company_id FROM base) co JOIN cr r ON r.company_id = co.company_id OR r.is_global
              QUALIFY row_number() OVER (PARTITION BY co.company_id, r.statement, r.concept ORDER BY CASE WHEN r.company_id = co.company_id THEN 0 ELSE 1 END, r.company_id) = 1)"""
def _sql_hierarchy(concepts: str) -> str:
    return f"""
    {concepts}, {SQL_ONE_RULE},
    byparent AS (SELECT co.company_id AS for_co, r.* FROM (SELECT DISTINCT company_id FROM base) co JOIN cr r ON r.company_id = co.company_id OR r.is_global WHERE r.parent_concept IS NOT NULL
                 QUALIFY row_number() OVER (PARTITION BY co.company_id, r.statement, r.parent_concept ORDER BY CASE WHEN r.company_id = co.company_id THEN 0 ELSE 1 END, r.concept, r.company_id) = 1),
    kid AS (SELECT e.company_id, e.statement, e.concept, r.concept AS cs, r.parent_concept AS ps FROM cn c JOIN rule1 r ON (r.for_co, r.statement, r.concept) = (c.company_id, c.statement, c.concept)
            JOIN cn e ON e.group_id = c.group_id WHERE r.parent_concept IS NOT NULL),
    top AS (SELECT e.company_id, e.statement, e.concept AS pc, r.concept AS cs, r.parent_concept AS ps FROM cn c JOIN byparent r ON (r.for_co, r.statement, r.parent_concept) = (c.company_id, c.statement, c.concept)
            JOIN cn e ON e.group_id = c.group_id),
    hn AS (SELECT company_id, statement, concept, parent_concept, min(cs) AS concept_source, min(ps) AS parent_concept_source FROM (
               SELECT company_id, statement, concept, ps AS parent_concept, cs, ps FROM kid
               UNION ALL SELECT company_id, statement, cs, pc, cs, ps FROM top
               UNION ALL SELECT k.company_id, k.statement, k.concept, t.pc, k.cs, k.ps FROM kid k JOIN top t USING (company_id, statement, cs)) GROUP BY ALL)"""


SQL_HIERARCHY = _sql_hierarchy(SQL_CONCEPTS)


@R.add(f"WITH RECURSIVE {SQL_HIERARCHY} SELECT * FROM hn")
def hierarchy_expand(spark: SparkSession, root: str) -> DataFrame:
    """S4: parents of concepts, expanded over groups."""
    return stages(spark, root).stage("hierarchies")


_PLACE = "CASE {p}override_priority WHEN 'company' THEN 1 WHEN 'global' THEN 2 ELSE 3 END, CASE {p}override_level WHEN 'member' THEN 1 WHEN 'axis' THEN 2 ELSE 3 END"
_M = "company_id, statement, normalized_label, axis, member, member_label"
SQL_MEMBERS = f"""
    dimf AS (SELECT b.*, coalesce(o.normalized_label, g.normalized_label, c.normalized_label, b.label) AS normalized_label FROM base b
             LEFT JOIN cr o ON (o.company_id, o.statement, o.concept) = (b.company_id, b.statement, b.concept)
             LEFT JOIN (SELECT statement, concept, arg_min(normalized_label, company_id) AS normalized_label FROM cr WHERE is_global GROUP BY ALL) g ON (g.statement, g.concept) = (b.statement, b.concept)
             LEFT JOIN cn c ON (c.company_id, c.statement, c.concept) = (b.company_id, b.statement, b.concept) WHERE b.axis <> ''),
    dm AS (SELECT {_M}, max(period_end) AS period_end FROM dimf GROUP BY ALL),
    dr AS (SELECT dm.*, d.id AS did, d.is_global AS dg, d.normalized_axis_label AS dax, d.normalized_member_label AS dmem FROM dm LEFT JOIN dimension_normalization_overrides d
             ON d.axis = dm.axis AND (d.company_id = dm.company_id OR d.is_global) AND (d.member IS NULL OR d.member = dm.member) AND (d.member_label IS NULL OR d.member_label = dm.member_label)
           QUALIFY row_number() OVER (PARTITION BY dm.company_id, dm.statement, dm.normalized_label, dm.axis, dm.member, dm.member_label
               ORDER BY coalesce(d.company_id = dm.company_id, false) DESC, d.member IS NOT NULL DESC, d.member_label IS NOT NULL DESC, d.updated_at DESC NULLS LAST, d.id) = 1),
    drow AS (SELECT {_M}, period_end, dax, dmem, did IS NOT NULL AS overridden, CASE dg WHEN true THEN 'global' WHEN false THEN 'company' END AS override_priority,
                    CASE WHEN dmem IS NOT NULL THEN 'member' WHEN dax IS NOT NULL THEN 'axis' END AS override_level,
                    md5(concat_ws('|', company_id, statement, normalized_label, axis, member, member_label, coalesce(dax, ''), coalesce(dmem, ''), 'grouping')) AS rid_ FROM dr)"""
SQL_MEMBER_COMPONENTS = """
    dkey AS (SELECT rid_, company_id, statement, normalized_label, lower(unnest([member, member_label, dmem])) AS k FROM drow),
    dedge AS (SELECT DISTINCT a.rid_ AS a, b.rid_ AS b FROM dkey a JOIN dkey b USING (company_id, statement, normalized_label, k)),
    dreach(x, y) AS (SELECT rid_, rid_ FROM drow UNION SELECT r.x, e.b FROM dreach r JOIN dedge e ON e.a = r.y),
    dcomp AS (SELECT x AS rid_, min(y) AS group_id FROM dreach GROUP BY x)"""
def _sql_dimensions(before: str) -> str:
    return f"""
    {before}, {SQL_MEMBERS}, {SQL_MEMBER_COMPONENTS},
    dg1 AS (SELECT * FROM drow JOIN dcomp USING (rid_)),
    dbest AS (SELECT group_id, coalesce(dax, axis) AS na, coalesce(dmem, member_label) AS nm, overridden, override_priority, override_level FROM dg1
              QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {_PLACE.format(p="")}, period_end DESC, coalesce(dax, axis), coalesce(dmem, member_label), rid_) = 1),
    dgrp AS (SELECT {_M}, g.group_id, na, nm, b.overridden, b.override_priority, b.override_level, max(period_end) OVER (PARTITION BY g.group_id) AS last_end, 'grouping' AS source
             FROM dg1 g JOIN dbest b USING (group_id)),
    df AS (SELECT f.*, coalesce(na, axis) AS nax, coalesce(nm, member_label) AS nme, coalesce(g.overridden, false) AS ov, g.override_priority AS op, g.override_level AS ol, value * weight AS amt, comparative_value * weight AS ear
           FROM dimf f LEFT JOIN dgrp g USING ({_M})),
    dpresent AS (SELECT DISTINCT company_id, statement, normalized_label, nax, nme, period_end FROM df),
    dmatch AS (SELECT DISTINCT a.company_id, a.statement, a.normalized_label, a.concept AS c1, b.concept AS c2, a.period_end AS p1, b.period_end AS p2, a.axis AS ax1, b.axis AS ax2, a.member AS m1, b.member AS m2,
                      a.member_label AS ml1, b.member_label AS ml2, a.nax AS na1, b.nax AS na2, a.nme AS nm1, b.nme AS nm2, a.ov AS ov1, b.ov AS ov2, a.op AS op1, b.op AS op2, a.ol AS ol1, b.ol AS ol2
               FROM df a JOIN df b ON a.company_id = b.company_id AND a.form_type = b.form_type AND a.statement = b.statement AND a.normalized_label = b.normalized_label AND a.ear = b.amt AND a.comparative_period_end = b.period_end
               WHERE a.period_end > b.period_end AND ((NOT (a.ov AND b.ov) AND (a.nax, a.nme) <> (b.nax, b.nme))
                     OR (coalesce((a.ol, b.ol) IN (('axis', 'axis'), ('axis', 'member'), ('member', 'axis')), false) AND a.nax = b.nax AND a.nme <> b.nme))
                 AND NOT EXISTS (FROM dpresent x JOIN dpresent y USING (company_id, statement, normalized_label, period_end)
                                 WHERE x.company_id = a.company_id AND x.statement = a.statement AND x.normalized_label = a.normalized_label AND (x.nax, x.nme) = (a.nax, a.nme) AND (y.nax, y.nme) = (b.nax, b.nme))),
    dwalk(company_id, statement, normalized_label, c, ax, m, ml, na, nm, ov, op, ol, here, root, gid) AS (
        SELECT company_id, statement, normalized_label, c1, ax1, m1, ml1, na1, nm1, ov1, op1, ol1, p1, p1, md5(concat_ws('|', company_id, statement, c1, normalized_label, ax1, m1, ml1, na1, nm1, 'chaining')) FROM dmatch
        UNION SELECT w.company_id, w.statement, w.normalized_label, d.c2, d.ax2, d.m2, d.ml2, d.na2, d.nm2, d.ov2, d.op2, d.ol2, d.p2, w.root, w.gid FROM dwalk w JOIN dmatch d
          ON (d.company_id, d.statement, d.normalized_label, d.c1, d.ax1, d.m1, d.ml1, d.na1, d.nm1) = (w.company_id, w.statement, w.normalized_label, w.c, w.ax, w.m, w.ml, w.na, w.nm) AND d.p1 <= w.here),
    dgiven AS (SELECT gid, na, nm, ov, op, ol FROM dwalk QUALIFY row_number() OVER (PARTITION BY gid ORDER BY CASE op WHEN 'company' THEN 1 WHEN 'global' THEN 2 ELSE 3 END,
                   CASE ol WHEN 'member' THEN 1 WHEN 'axis' THEN 2 ELSE 3 END, here DESC, na, nm, ax, m, ml) = 1),
    dchain AS (SELECT w.company_id, w.statement, w.normalized_label, w.ax AS axis, w.m AS member, w.ml AS member_label, gid AS group_id, g.na, g.nm, g.ov AS overridden, g.op AS override_priority, g.ol AS override_level,
                      root AS last_end, 'chaining' AS source FROM dwalk w JOIN dgiven g USING (gid)
               QUALIFY row_number() OVER (PARTITION BY w.company_id, w.statement, w.normalized_label, w.ax, w.m, w.ml ORDER BY g.na, g.nm, root DESC, gid) = 1),
    dboth AS (SELECT {_M}, group_id, na, nm, overridden, override_priority, override_level, last_end, source FROM dgrp
              UNION ALL SELECT {_M}, group_id, na, nm, overridden, override_priority, override_level, last_end, source FROM dchain),
    dlink AS (SELECT DISTINCT a.group_id AS a, b.group_id AS b FROM dboth a JOIN dboth b USING ({_M})),
    dspan(x, y) AS (SELECT DISTINCT group_id, group_id FROM dboth UNION SELECT r.x, e.b FROM dspan r JOIN dlink e ON e.a = r.y),
    dname AS (SELECT x AS group_id, min(y) AS component FROM dspan GROUP BY x),
    dlast AS (SELECT * FROM dboth JOIN dname USING (group_id)),
    dtop AS (SELECT component, na, nm, source, overridden, override_priority, override_level FROM dlast
             QUALIFY row_number() OVER (PARTITION BY component ORDER BY {_PLACE.format(p="")}, last_end DESC, na, nm, source, group_id) = 1),
    dn AS (SELECT {_M}, na AS normalized_axis_label, nm AS normalized_member_label, component AS group_id, source, overridden, override_priority, override_level
           FROM (SELECT {_M}, min(component) AS component FROM dlast GROUP BY ALL) JOIN dtop USING (component))"""


SQL_DIMENSIONS = _sql_dimensions(SQL_HIERARCHY)


@R.add(f"WITH RECURSIVE {SQL_HIERARCHY}, {SQL_MEMBERS}, {SQL_MEMBER_COMPONENTS} SELECT rid_ AS row_id, group_id FROM dcomp")
def member_components(spark: SparkSession, root: str) -> DataFrame:
    """S5: members that share a name, as connected components."""
    s = stages(spark, root)
    # read three times: the links and both ends of them
    rows = cut(N.dimension_rows(N.labelled_dimension_facts(s.stage("base"), s.concept_rules, s.stage("concepts")), s.dimension_rules))
    keys = rows.select("row_id", "company_id", "statement", "normalized_label", F.explode(F.array_compact(F.array("member", "member_label", "normalized_member_label"))).alias("k"))
    edges = keys.select("row_id", F.concat(F.lit("~"), F.concat_ws("|", F.col("company_id").cast("string"), "statement", "normalized_label", F.lower("k"))).alias("k"))
    comp = components(edges, "row_id", "k").where("not startswith(node, '~')")
    least = comp.groupBy("component").agg(F.min("node").alias("group_id"))
    return comp.join(least, "component").select(F.col("node").alias("row_id"), "group_id")


@R.add(f"WITH RECURSIVE {SQL_DIMENSIONS} SELECT * FROM dn")
def dimension_normalization(spark: SparkSession, root: str) -> DataFrame:
    """S5: normalized dimension members."""
    return stages(spark, root).stage("dimensions")


@R.add(f"WITH RECURSIVE {_sql_dimensions(_sql_hierarchy(_sql_concepts(SQL_STAR_BASE)))} SELECT * FROM dn")
def dimension_chain(spark: SparkSession, root: str) -> DataFrame:
    """S3 and S5 over facts whose concepts and members change their names: chains and the groups they connect."""
    base = cut(star_facts(spark, root))
    s = stages(spark, root)
    return N.dimensions(base, s.concept_rules, s.dimension_rules, cut(N.concepts(base, s.concept_rules)))


_FIND = """LEFT JOIN hn h ON h.company_id = {x}.company_id AND h.statement = {x}.statement AND h.concept = {c}
        LEFT JOIN base fp ON fp.company_id = {x}.company_id AND fp.filing_id = {x}.filing_id AND fp.statement = {x}.statement AND fp.concept = coalesce(r.parent_concept, h.parent_concept)
        LEFT JOIN base fa ON fa.company_id = {x}.company_id AND fa.filing_id = {x}.filing_id AND fa.statement = {x}.statement AND fa.concept = r.abstract_concept"""
_LINKS = """CASE WHEN coalesce(r.parent_concept, h.parent_concept) IS NULL THEN {p} ELSE coalesce(fp.id::VARCHAR, concat_ws('|', {x}.statement, coalesce(r.parent_concept, h.parent_concept_source), {x}.filing_id, {x}.company_id)) END AS parent_id,
        CASE WHEN fp.id IS NULL THEN coalesce(r.parent_concept, h.parent_concept_source) END AS parent_concept,
        CASE WHEN r.abstract_concept IS NULL THEN {a} ELSE coalesce(fa.id::VARCHAR, concat_ws('|', {x}.statement, r.abstract_concept, {x}.filing_id, {x}.company_id)) END AS abstract_id,
        CASE WHEN fa.id IS NULL THEN r.abstract_concept END AS abstract_concept"""
SQL_ROWS = f"""
    {SQL_DIMENSIONS},
    rws AS (
        SELECT b.id::VARCHAR AS id, b.company_id, b.filing_id, b.form_type, b.concept, b.label, coalesce(r.normalized_label, c.normalized_label, b.label) AS normalized_label, b.is_abstract,
               (CASE WHEN sign(b.weight) * sign(coalesce(r.weight, c.weight, b.weight)) < 0 THEN -b.value ELSE b.value END)::DECIMAL(28,6) AS value,
               (CASE WHEN sign(b.weight) * sign(coalesce(r.weight, c.weight, b.weight)) < 0 THEN -b.comparative_value ELSE b.comparative_value END)::DECIMAL(28,6) AS comparative_value,
               coalesce(r.weight, c.weight, b.weight) AS weight, coalesce(r.unit, c.unit, b.unit) AS unit, coalesce(d.normalized_axis_label, b.axis) AS axis, coalesce(d.normalized_member_label, b.member_label) AS member,
               b.statement, b.period_end, b.comparative_period_end, b.period, b.position, {_LINKS.format(x="b", p="b.parent_id::VARCHAR", a="b.abstract_id::VARCHAR")}, false AS is_synthetic
        FROM base b LEFT JOIN rule1 r ON r.for_co = b.company_id AND r.statement = b.statement AND r.concept = b.concept
        {_FIND.format(x="b", c="b.concept")}
        LEFT JOIN cn c ON c.company_id = b.company_id AND c.statement = b.statement AND c.concept = b.concept
        LEFT JOIN dn d ON d.company_id = b.company_id AND d.statement = b.statement AND d.normalized_label = coalesce(r.normalized_label, c.normalized_label, b.label) AND d.axis = b.axis AND d.member = b.member AND d.member_label = b.member_label
        UNION
        SELECT w.id, x.company_id, x.filing_id, x.form_type, r.concept, r.normalized_label, r.normalized_label, r.is_abstract, 0, 0, r.weight, r.unit, '', '', x.statement, x.period_end, x.comparative_period_end, x.period, 99,
               {_LINKS.format(x="x", p="NULL", a="NULL")}, true
        FROM rws x, LATERAL (SELECT x.parent_concept AS c, x.parent_id AS id UNION ALL SELECT x.abstract_concept, x.abstract_id) w
        JOIN rule1 r ON r.for_co = x.company_id AND r.statement = x.statement AND r.concept = w.c
        {_FIND.format(x="x", c="w.c")})"""
_S = ", ".join(N.SERIES)
_ID = "is_synthetic, try_cast(id AS BIGINT), id"
_TIE = ", ".join(f"{c} NULLS LAST" for c in ("value", "comparative_value", "parent_id", "abstract_id", "concept", "label", "weight", "unit", "comparative_period_end", "period", "position"))
SQL_NORMALIZED = f"""
    {SQL_ROWS},
    syn AS (SELECT id AS node, parent_id AS up, coalesce(weight, 1)::DOUBLE AS w FROM rws WHERE is_synthetic AND NOT is_abstract),
    above(node, up) AS (SELECT node, up FROM syn WHERE up IS NOT NULL UNION SELECT a.node, s.up FROM above a JOIN syn s ON s.node = a.up WHERE s.up IS NOT NULL),
    endless AS (SELECT node FROM above WHERE up IN (SELECT node FROM above WHERE node = up) OR node = up),
    carry(node, up, v, c, step) AS (
        SELECT id, parent_id, value::DOUBLE * weight::DOUBLE, comparative_value::DOUBLE * weight::DOUBLE, 0 FROM rws WHERE NOT is_abstract AND NOT is_synthetic
        UNION ALL SELECT s.node, s.up, sum(y.v) * any_value(s.w), sum(y.c) * any_value(s.w), y.step + 1 FROM carry y JOIN (SELECT *, row_number() OVER () AS rn FROM syn ANTI JOIN endless USING (node)) s ON s.node = y.up GROUP BY s.node, s.up, s.rn, y.step),
    summed AS (SELECT node, sum(v) AS v, sum(c) AS c FROM carry WHERE step > 0 GROUP BY node),
    rolled AS (SELECT r.* REPLACE ((CASE WHEN is_synthetic THEN round(s.v, 6) ELSE r.value END)::DECIMAL(28,6) AS value, (CASE WHEN is_synthetic THEN round(s.c, 6) ELSE r.comparative_value END)::DECIMAL(28,6) AS comparative_value)
               FROM rws r LEFT JOIN summed s ON s.node = r.id),
    pts AS (SELECT *, row_number() OVER () AS n FROM (SELECT DISTINCT id, is_synthetic, {_S}, concept, value, period_end, comparative_value AS cv, comparative_period_end AS ce FROM rolled)),
    pick AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY {_S}, value, period_end ORDER BY {_ID}, concept NULLS LAST, cv NULLS LAST, ce NULLS LAST) = 1),
    evalue AS (SELECT a.n AS src, b.n AS dst FROM pts a JOIN pick b USING ({_S}) WHERE b.value = a.cv AND b.period_end = a.ce AND b.period_end < a.period_end),
    estep AS (SELECT * FROM evalue UNION ALL SELECT a.n, b.n FROM pts a JOIN pick b USING ({_S}, concept) WHERE b.period_end = a.ce AND b.period_end < a.period_end AND a.n NOT IN (SELECT src FROM evalue)),
    trek(root, n, depth) AS (SELECT n, n, 1 FROM pts WHERE cv IS NOT NULL AND ce IS NOT NULL UNION SELECT t.root, e.dst, t.depth + 1 FROM trek t JOIN estep e ON e.src = t.n),
    tall AS (SELECT root, max(depth) AS size FROM trek GROUP BY root),
    sized AS (SELECT id, max(size) AS size FROM trek JOIN tall USING (root) JOIN pts USING (n) GROUP BY id),
    dup AS (SELECT r.*, row_number() OVER (PARTITION BY {_S}, period_end ORDER BY CASE WHEN form_type LIKE '%/A' THEN 0 ELSE 1 END, coalesce(size, 1) DESC, {_ID}, {_TIE}) > 1 AS is_duplicate
            FROM rolled r LEFT JOIN sized USING (id)),
    nfacts AS (SELECT * EXCLUDE (parent_concept, abstract_concept) FROM dup QUALIFY row_number() OVER (PARTITION BY id ORDER BY is_duplicate, {_TIE}, period_end) = 1)"""
_Q = f"OVER (PARTITION BY {_S} ORDER BY period_end DESC, {_ID} ROWS UNBOUNDED PRECEDING)"
_ALIGN = f"""SELECT *, first_value(weight) {_Q} AS lw, first_value(abstract_id) {_Q} AS la, first_value(position) {_Q} AS lp FROM """
_SET = "REPLACE ((CASE WHEN sign(weight) * sign(lw) < 0 THEN -value ELSE value END)::DECIMAL(28,6) AS value, lw AS weight, la AS abstract_id, lp AS position)"
_OUT = ", ".join(c for c in N.OUT if c != "source_type")
SQL_QUARTERLY = f"""
    {SQL_NORMALIZED},
    kin AS (SELECT id AS filing_id, company_id, fiscal_year, fiscal_quarter, CASE form_type WHEN '10-K' THEN id ELSE first_value(CASE form_type WHEN '10-K' THEN id END IGNORE NULLS)
                OVER (PARTITION BY company_id ORDER BY fiscal_period_end, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS tag FROM fil WHERE form_type IN ('10-K', '10-K/A', '10-Q', '10-Q/A')),
    even AS (SELECT * EXCLUDE (lw, la, lp) {_SET} FROM ({_ALIGN} nfacts JOIN kin USING (company_id, filing_id) WHERE NOT is_duplicate)),
    qtr AS (SELECT * EXCLUDE (gap, was) REPLACE ((CASE WHEN period = 'YTD' AND gap BETWEEN 80 AND 100 AND was IS NOT NULL THEN value - was ELSE value END)::DECIMAL(28,6) AS value)
            FROM (SELECT *, date_diff('day', lag(period_end) OVER s, period_end) AS gap, lag(value) OVER s AS was FROM even WHERE form_type LIKE '10-Q%'
                  WINDOW s AS (PARTITION BY {_S} ORDER BY period_end, {_ID}))),
    ann AS (SELECT *, statement = 'Balance Sheet' OR normalized_label ILIKE 'shares outstanding%' AS still FROM even WHERE form_type LIKE '10-K%'),
    quarters AS (SELECT {_OUT}, form_type AS source_type FROM qtr UNION ALL SELECT {_OUT}, form_type FROM ann WHERE still
        UNION ALL SELECT {_OUT.replace("value", "(value - taken)::DECIMAL(28,6)")}, 'calculated' FROM ann JOIN (SELECT {_S}, tag, sum(value) AS taken FROM qtr GROUP BY ALL) USING ({_S}, tag) WHERE NOT still)"""
SQL_YEARLY = f"""
    {SQL_NORMALIZED},
    years AS (SELECT {_OUT.replace(" fiscal_quarter,", "")}, '10-K' AS source_type FROM (SELECT * {_SET} FROM ({_ALIGN} nfacts JOIN (SELECT id AS filing_id, company_id, fiscal_year FROM fil) USING (company_id, filing_id)
              WHERE NOT is_duplicate AND form_type LIKE '10-K%')))"""


@R.add(f"WITH RECURSIVE {SQL_ROWS} SELECT * FROM rws")
def normalized_rows(spark: SparkSession, root: str) -> DataFrame:
    """S6: facts with their links, and rows for missing ancestors, before the roll-up."""
    return stages(spark, root).stage("rows")


@R.add(f"WITH RECURSIVE {SQL_NORMALIZED} SELECT * FROM nfacts")
def normalized_facts(spark: SparkSession, root: str) -> DataFrame:
    """S6: normalized facts, rolled up and marked for duplicates."""
    return stages(spark, root).stage("normalized")


@R.add(
    f"""WITH {SQL_FACTS}, tagged AS (SELECT id AS filing_id, company_id, fiscal_year, fiscal_quarter, form_type, fiscal_period_end FROM fil WHERE form_type IN ('10-K', '10-K/A', '10-Q', '10-Q/A'))
    SELECT filing_id, company_id, fiscal_year, fiscal_quarter, CASE WHEN form_type = '10-K' THEN filing_id ELSE
        (SELECT list(k.filing_id ORDER BY k.fiscal_period_end, k.filing_id)[1] FROM tagged k WHERE k.company_id = t.company_id AND k.form_type = '10-K'
             AND (k.fiscal_period_end, k.filing_id) > (t.fiscal_period_end, t.filing_id)) END AS fiscal_tag FROM tagged t"""
)
def next_annual_tag(spark: SparkSession, root: str) -> DataFrame:
    """S7: the annual report each filing belongs to."""
    return N.fiscal_tags(filings(spark, root))


@R.add(f"WITH RECURSIVE {SQL_QUARTERLY} SELECT * FROM quarters")
def quarterly_series(spark: SparkSession, root: str) -> DataFrame:
    """S7: quarterly series."""
    return stages(spark, root).stage("quarterly")


@R.add(f"WITH RECURSIVE {SQL_YEARLY} SELECT * FROM years")
def yearly_series(spark: SparkSession, root: str) -> DataFrame:
    """S8: yearly series."""
    return stages(spark, root).stage("yearly")


@R.add(f"WITH RECURSIVE {SQL_HIERARCHY}, {SQL_MEMBERS} SELECT {_M}, period_end, dax AS normalized_axis_label, dmem AS normalized_member_label, overridden, override_priority, override_level, rid_ AS row_id FROM drow")
def rule_best_match_left(spark: SparkSession, root: str) -> DataFrame:
    """S5: dimension members with the rule that fits best, those without one included."""
    s = stages(spark, root)
    return N.dimension_rows(N.labelled_dimension_facts(s.stage("base"), s.concept_rules, s.stage("concepts")), s.dimension_rules)


@R.add(f"WITH RECURSIVE {SQL_ROWS} SELECT id, concept, normalized_label, weight, parent_id, abstract_id, period_end FROM rws WHERE is_synthetic")
def synthetic_ancestors(spark: SparkSession, root: str) -> DataFrame:
    """S6: rows made up for ancestors that a filing does not report."""
    return stages(spark, root).stage("ancestors").select("id", "concept", "normalized_label", "weight", "parent_id", "abstract_id", "period_end")


@R.add(f"WITH RECURSIVE {SQL_NORMALIZED} SELECT id, parent_id, period_end, value, comparative_value FROM rolled WHERE is_synthetic")
def weighted_rollup(spark: SparkSession, root: str) -> DataFrame:
    """S6: weighted sums of what lies below the synthetic rows."""
    return N.rolled_up(stages(spark, root).stage("rows")).where("is_synthetic").select("id", "parent_id", "period_end", "value", "comparative_value")


@R.add(f"WITH RECURSIVE {SQL_NORMALIZED} SELECT id, size AS chain_size FROM sized")
def comparative_chain(spark: SparkSession, root: str) -> DataFrame:
    """S6: the longest run of comparatives through each fact."""
    return N.chain_sizes(N.rolled_up(stages(spark, root).stage("rows")))


@R.add(f"WITH RECURSIVE {SQL_NORMALIZED} SELECT id, is_duplicate FROM nfacts")
def dedup_ranked(spark: SparkSession, root: str) -> DataFrame:
    """S6: which facts are duplicates of a better one."""
    return stages(spark, root).stage("normalized").select("id", "is_duplicate")


_QUARTERS = ["company_id", "concept", "period_end"]
_SQL_YTD = f"""{SQL_STAR}, ytd AS (SELECT company_id, label AS concept, period_end, value, sum(value) OVER (PARTITION BY company_id, label, year(period_end) ORDER BY period_end)::DECIMAL(28,6) AS total FROM base WHERE axis = '')"""


def running_totals(spark: SparkSession, root: str) -> DataFrame:
    """Quarter values of the order tables with their running totals of the year."""
    w = Window.partitionBy("company_id", "label", F.year("period_end")).orderBy("period_end")
    return star_facts(spark, root).where("axis = ''").select("company_id", F.col("label").alias("concept"), "period_end", "value", F.sum("value").over(w).cast("decimal(28,6)").alias("total"))


@R.add(f"""WITH {_SQL_YTD} SELECT company_id, concept, period_end, total, CASE WHEN quarter(period_end) > 1 AND date_diff('day', lag(period_end) OVER s, period_end) BETWEEN 80 AND 100 THEN total - lag(total) OVER s ELSE total END AS quarter_value
    FROM ytd WINDOW s AS (PARTITION BY company_id, concept ORDER BY period_end)""")
def ytd_decumulate(spark: SparkSession, root: str) -> DataFrame:
    """S7: quarters from running totals; the first quarter of a year has none before it."""
    t = running_totals(spark, root)
    own = undo_running_total(t, ["company_id", "concept"], "period_end", "total", F.quarter("period_end") > 1, [F.asc("period_end")])
    return t.select(*_QUARTERS, "total", own.alias("quarter_value"))


@R.add(f"""WITH {_SQL_YTD}, y AS (SELECT company_id, concept, year(period_end)::INT AS y, sum(value) AS whole, sum(value) FILTER (quarter(period_end) < 4) AS parts FROM ytd GROUP BY ALL)
    SELECT company_id, concept, y, (whole - parts)::DECIMAL(28,6) AS value FROM y WHERE parts IS NOT NULL""")
def residual_quarter(spark: SparkSession, root: str) -> DataFrame:
    """S7: what a year holds beyond its first three quarters."""
    t = running_totals(spark, root).withColumn("y", F.year("period_end"))
    key = ["company_id", "concept", "y"]
    whole = t.groupBy(*key).agg(F.sum("value").alias("value"))
    return residual(whole, t.where(F.quarter("period_end") < 4), key, "value").select(*key, F.col("value").cast("decimal(28,6)").alias("value"))
