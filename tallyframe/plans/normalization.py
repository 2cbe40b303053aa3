"""The normalization pipeline: facts through override rules, concepts, hierarchies, dimensions and roll-ups to series.

Every stage is a function from DataFrames to a DataFrame; every choice among equals has a total order.
Node ids are texts: a stored fact's id in digits, or `statement|concept|filing|company` for a row made up for an
ancestor that a filing does not report. Both engines can compare them, and two children ask for the same ancestor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import MOST_ROUNDS, components, follow
from ..operators.hierarchy import breaks
from ..operators.matching import best_match, drop_ambiguous, keep_first, value_matches
from ..operators.series import flip_sign, longest_runs, next_matching, residual, undo_running_total, with_latest
from ..session import cut, small

MONEY = "decimal(28,6)"
CONFLICT_KEYS = ["company_id", "statement", "concept", "label", "axis", "member", "member_label", "period_end", "form_type"]
SERIES = ["company_id", "statement", "normalized_label", "axis", "member"]
ANNUAL, QUARTERLY = ("10-K", "10-K/A"), ("10-Q", "10-Q/A")
PRIORITY = {"company": 1, "global": 2}
LEVEL = {"member": 1, "axis": 2}


def _place(c: Column, order: dict[str, int]) -> Column:
    out = F.lit(3)
    for name, n in order.items():
        out = F.when(c == name, n).otherwise(out)
    return out


# -- override rules -------------------------------------------------------------------------------------------------


def overridden(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts changed by the override rule that fits best: own before global, more criteria, narrower dates, newer, lower id.

    A null criterion of a rule fits anything. Facts without a rule are absent; a rule cannot blank a value.
    """
    criteria = ["axis", "member", "label", "form_type"]
    fits = F.lit(True)
    for c in criteria:
        fits = fits & (F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == F.col(f"l.{c}")))
    fits = fits & (F.col("r.from_period").isNull() | (F.col("l.period_end") >= F.col("r.from_period")))
    fits = fits & (F.col("r.to_period").isNull() | (F.col("l.period_end") <= F.col("r.to_period")))
    given = sum((F.col(f"r.{c}").isNotNull().cast("int") for c in [*criteria, "from_period", "to_period"]), F.lit(0))
    rank = [given, -F.datediff("r.to_period", "r.from_period"), F.col("r.updated_at"), -F.col("r.id")]
    needed = facts.select("id", "company_id", "statement", "concept", "axis", "member", "label", "form_type", "period_end")
    best = best_match(needed, "id", rules, ["statement", "concept"], "company_id", F.col("is_global"), fits, rank)
    took = lambda c: F.coalesce(F.col(f"rule.to_{c}"), F.col(c)).alias(c)
    return facts.join(best, "id").select(
        "id", "company_id", "statement", took("concept"), took("axis"), took("member"), took("member_label"),
        F.coalesce(F.col("rule.to_weight").cast("decimal(9,4)"), F.col("weight")).alias("weight"), F.col("rule.id").alias("fact_override_id"),
    )


def base_facts(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts with the rules' changes applied, without any that contradict each other."""
    fields = ["concept", "axis", "member", "member_label", "weight"]
    new = changed.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    both = facts.join(new, "id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).drop(*[f"__{c}" for c in fields])
    return drop_ambiguous(both, CONFLICT_KEYS, "value")


# -- concepts -------------------------------------------------------------------------------------------------------


def _group_id(kind: str, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts], F.lit(kind)))


def label_groups(base: DataFrame) -> DataFrame:
    """Concepts with several labels over time but one per filing, under their latest label."""
    g = base.where("axis = ''").groupBy("company_id", "statement", "concept").agg(
        F.max_by("label", F.struct("period_end", F.col("id"))).alias("normalized_label"),
        F.countDistinct("label").alias("__labels"),
        F.countDistinct(F.struct("filing_id", "label")).alias("__pairs"),
        F.countDistinct("filing_id").alias("__filings"),
        F.max("period_end").alias("group_max_period_end"),
    )
    g = g.where("__labels > 1 and __pairs = __filings").drop("__labels", "__pairs", "__filings")
    return g.withColumn("group_id", _group_id("grouping", "company_id", "statement", "concept")).withColumn("source", F.lit("grouping"))


def concept_matches(base: DataFrame, groups: DataFrame, together: bool = False) -> DataFrame:
    """Candidate (newer concept, older concept) pairs whose amounts match from period to period.

    Pairs of which one concept is also reported in the other's period are left out unless `together`.
    """
    on = ["company_id", "statement", "concept"]
    facts = base.where("axis = ''").join(groups.select(*on, F.col("normalized_label").alias("__g")), on, "left").select(
        "id", *on, "form_type", "period_end", "comparative_period_end", F.coalesce("__g", "label").alias("normalized_label"),
        (F.col("value") * F.col("weight")).alias("amount"), (F.col("comparative_value") * F.col("weight")).alias("earlier"),
    )
    found = value_matches(
        facts, facts, ["company_id", "form_type", "statement"], ("earlier", "amount"), ("comparative_period_end", "period_end"), F.col("n.concept") != F.col("o.concept")
    ).select(
        F.col("n.company_id").alias("company_id"), F.col("n.statement").alias("statement"), F.col("n.concept").alias("concept1"), F.col("o.concept").alias("concept2"),
        F.col("n.period_end").alias("period_end1"), F.col("o.period_end").alias("period_end2"), F.col("n.normalized_label").alias("label1"),
        F.col("o.normalized_label").alias("label2"), F.col("n.id").alias("__id1"), F.col("o.id").alias("__id2"),
    )
    key = ["company_id", "statement", "concept1", "concept2", "period_end1", "period_end2"]
    found = keep_first(found, key, [F.col("__id1"), F.col("__id2")]).drop("__id1", "__id2")
    if together:
        return found
    there = base.select(*on, "period_end").distinct()
    for concept, period in (("concept2", "period_end1"), ("concept1", "period_end2")):
        other = there.withColumnsRenamed({"concept": concept, "period_end": period})
        found = found.join(other, ["company_id", "statement", concept, period], "left_anti")
    return found


def sound_matches(found: DataFrame) -> DataFrame:
    """Without pairs that recur in adjoining periods or that also hold the other way round."""
    pair = ["company_id", "statement", "concept1", "concept2"]
    a, b = found.alias("a"), found.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in pair]
    adjoin = [a.join(b, [*same, F.col(f"a.{x}") == F.col(f"b.{y}")], "left_semi") for x, y in (("period_end1", "period_end2"), ("period_end2", "period_end1"))]
    turned = [F.col("a.company_id") == F.col("b.company_id"), F.col("a.statement") == F.col("b.statement"), F.col("a.concept1") == F.col("b.concept2"),
              F.col("a.concept2") == F.col("b.concept1"), F.col("a.period_end1") == F.col("b.period_end1"), F.col("a.period_end2") == F.col("b.period_end2")]
    wrong = adjoin[0].select(pair).union(adjoin[1].select(pair)).union(a.join(b, turned, "left_semi").select(pair)).distinct()
    return found.join(wrong, pair, "left_anti")


def concept_chains(matches: DataFrame) -> DataFrame:
    """Older concepts under the label of the newest concept that leads to them."""
    start = matches.select(
        "company_id", "statement", F.col("concept1").alias("concept"), F.col("label1").alias("normalized_label"), F.col("period_end1").alias("at"),
        F.col("period_end1").alias("group_max_period_end"), _group_id("chaining", "company_id", "statement", "concept1").alias("group_id"),
    )
    m = cut(matches.select("company_id", "statement", F.col("concept1").alias("concept"), "concept2", "period_end1", "period_end2"))

    def older(edge: DataFrame) -> DataFrame:
        j = edge.join(m, ["company_id", "statement", "concept"]).where("period_end1 <= at")
        return j.select("company_id", "statement", F.col("concept2").alias("concept"), "normalized_label", F.col("period_end2").alias("at"), "group_max_period_end", "group_id")

    walked = follow(start, older)
    best = keep_first(walked, ["company_id", "statement", "concept"], [F.desc("group_max_period_end"), F.asc("normalized_label"), F.asc("group_id")])
    return best.drop("at").withColumn("source", F.lit("chaining"))


def concepts(base: DataFrame, rules: DataFrame) -> DataFrame:
    """Normalized label, weight and unit of each concept that is grouped or chained; rules speak for whole groups."""
    groups = cut(label_groups(base))
    chains = concept_chains(cut(sound_matches(cut(concept_matches(base, groups)))))
    key = ["company_id", "statement", "concept"]
    only = groups.join(chains.select(key), key, "left_anti")
    cn = cut(chains.unionByName(only))
    said = ["normalized_label", "weight", "unit"]
    r = small(rules.select("company_id", "statement", "concept", "is_global", *[F.col(c).alias(f"r_{c}") for c in said]))
    own = cn.select(*key, "group_id").join(r.drop("is_global"), key).groupBy("group_id", "company_id").agg(*[F.max(f"r_{c}").alias(f"own_{c}") for c in said])
    every = cn.select("statement", "concept", "group_id").join(r.where("is_global").drop("company_id"), ["statement", "concept"]).groupBy("group_id").agg(
        *[F.max(f"r_{c}").alias(f"all_{c}") for c in said]
    )
    j = cn.join(own, ["company_id", "group_id"], "left").join(every, "group_id", "left")
    return j.select(
        *key,
        F.coalesce("own_normalized_label", "all_normalized_label", "normalized_label").alias("normalized_label"),
        F.coalesce("own_weight", "all_weight").alias("weight"),
        F.coalesce("own_unit", "all_unit").alias("unit"),
        "group_id",
        "source",
        F.coalesce("own_normalized_label", "all_normalized_label").isNotNull().alias("overridden"),
    )


# -- hierarchies ----------------------------------------------------------------------------------------------------


class RuleBook:
    """Concept rules by `on`, a company's own before the global ones; of several the lowest by `rank` holds. Prepared once, for many look-ups."""

    def __init__(self, rules: DataFrame, on: list[str], rank: str = "concept"):
        self.on, self.own_key = on, ["company_id", *on]
        own = keep_first(rules, self.own_key, [F.asc(rank)])
        every = keep_first(rules.where("is_global"), on, [F.asc(rank), F.asc("company_id")])
        self.own = small(cut(own.select(*self.own_key, F.struct(*rules.columns).alias("own"))))
        self.every = small(cut(every.select(*on, F.struct(*rules.columns).alias("every"))))

    def of(self, left: DataFrame, record: str) -> DataFrame:
        """(record, rule) of the records that have one."""
        j = left.select(record, *self.own_key).join(self.own, self.own_key, "left").join(self.every, self.on, "left")
        return j.select(record, F.coalesce("own", "every").alias("rule")).where("rule is not null")


def hierarchies(cn: DataFrame, rules: DataFrame) -> DataFrame:
    """Child and parent concepts of the rules, expanded over the groups of concepts that mean the same."""
    c = cn.select("company_id", "statement", "concept", "group_id").withColumn("__i", F.struct("company_id", "statement", "concept"))
    r = rules.select("company_id", "is_global", "statement", "concept", "parent_concept")
    as_child = RuleBook(r, ["statement", "concept"]).of(c, "__i")
    by_parent = r.where("parent_concept is not null").withColumnRenamed("concept", "child").withColumnRenamed("parent_concept", "concept")
    as_parent = RuleBook(by_parent, ["statement", "concept"], "child").of(c, "__i")
    group = c.select("group_id", F.col("company_id"), F.col("statement"), F.col("concept").alias("member"))
    of = c.select("__i", F.col("group_id"))
    kids = as_child.where("rule.parent_concept is not null").join(of, "__i").select(
        "group_id", F.col("rule.concept").alias("concept_source"), F.col("rule.parent_concept").alias("parent_concept_source")
    ).join(group, "group_id").select("company_id", "statement", F.col("member").alias("concept"), "concept_source", "parent_concept_source")
    tops = as_parent.join(of, "__i").select(
        "group_id", F.col("rule.child").alias("concept_source"), F.col("rule.concept").alias("parent_concept_source")
    ).join(group, "group_id").select("company_id", "statement", F.col("member").alias("parent_concept"), "concept_source", "parent_concept_source")
    across = kids.join(tops.select("company_id", "statement", "concept_source", "parent_concept"), ["company_id", "statement", "concept_source"])
    cols = ["company_id", "statement", "concept", "parent_concept", "concept_source", "parent_concept_source"]
    rows = kids.withColumn("parent_concept", F.col("parent_concept_source")).select(cols).union(
        tops.withColumn("concept", F.col("concept_source")).select(cols)
    ).union(across.select(cols))
    return rows.groupBy(*cols[:4]).agg(F.min("concept_source").alias("concept_source"), F.min("parent_concept_source").alias("parent_concept_source"))


# -- dimensions -----------------------------------------------------------------------------------------------------

MEMBER = ["company_id", "statement", "normalized_label", "axis", "member", "member_label"]
SAID = ["normalized_axis_label", "normalized_member_label", "overridden", "override_priority", "override_level"]


def _best_said() -> list[Column]:
    return [_place(F.col("override_priority"), PRIORITY), _place(F.col("override_level"), LEVEL)]


def labelled_dimension_facts(base: DataFrame, rules: DataFrame, cn: DataFrame) -> DataFrame:
    """Dimensional facts under their normalized label: company rule, global rule, concept normalization, own label."""
    key = ["company_id", "statement", "concept"]
    own = small(rules.select(*key, F.col("normalized_label").alias("__own")))
    every = small(keep_first(rules.where("is_global"), ["statement", "concept"], [F.asc("company_id")]).select("statement", "concept", F.col("normalized_label").alias("__all")))
    norm = cn.select(*key, F.col("normalized_label").alias("__cn"))
    j = base.where("axis <> ''").join(own, key, "left").join(every, ["statement", "concept"], "left").join(norm, key, "left")
    return j.withColumn("normalized_label", F.coalesce("__own", "__all", "__cn", "label")).drop("__own", "__all", "__cn")


def dimension_rows(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct dimension members of each label with the dimension rule that fits best."""
    rows = facts.groupBy(*MEMBER).agg(F.max("period_end").alias("period_end"))
    rows = rows.withColumn("__i", F.struct(*MEMBER))
    fits = (F.col("r.member").isNull() | (F.col("r.member") == F.col("l.member"))) & (F.col("r.member_label").isNull() | (F.col("r.member_label") == F.col("l.member_label")))
    rank = [F.col("r.member").isNotNull(), F.col("r.member_label").isNotNull(), F.col("r.updated_at"), -F.col("r.id")]
    best = best_match(rows, "__i", rules.drop("tags"), ["axis"], "company_id", F.col("is_global"), fits, rank)
    j = rows.join(best, "__i", "left")
    out = j.select(
        *MEMBER, "period_end", F.col("rule.normalized_axis_label").alias("normalized_axis_label"), F.col("rule.normalized_member_label").alias("normalized_member_label"),
        F.col("rule").isNotNull().alias("overridden"),
        F.when(~F.col("rule.is_global"), "company").when(F.col("rule.is_global"), "global").alias("override_priority"),
        F.when(F.col("rule.normalized_member_label").isNotNull(), "member").when(F.col("rule.normalized_axis_label").isNotNull(), "axis").alias("override_level"),
    )
    parts = [F.col(c).cast("string") for c in MEMBER] + [F.coalesce("normalized_axis_label", F.lit("")), F.coalesce("normalized_member_label", F.lit("")), F.lit("grouping")]
    return out.withColumn("row_id", F.md5(F.concat_ws("|", *parts)))


def dimension_groups(rows: DataFrame) -> DataFrame:
    """Members of one label that share a member, a member label or a rule's label (letter case aside), under one name."""
    rows = cut(rows)
    keys = rows.select(
        "row_id", "company_id", "statement", "normalized_label", F.explode(F.array_compact(F.array("member", "member_label", "normalized_member_label"))).alias("key")
    )
    edges = keys.select("row_id", F.concat(F.lit("~"), F.md5(F.concat_ws("|", F.col("company_id").cast("string"), "statement", "normalized_label", F.lower("key")))).alias("key"))
    comp = components(edges, "row_id", "key").where("not startswith(node, '~')")
    least = comp.groupBy("component").agg(F.min("node").alias("group_id"))
    of = comp.join(least, "component").select(F.col("node").alias("row_id"), "group_id")
    g = cut(rows.join(of, "row_id"))
    best = keep_first(g, ["group_id"], [*_best_said(), F.desc("period_end"), F.coalesce("normalized_axis_label", "axis"), F.coalesce("normalized_member_label", "member_label"), F.asc("row_id")])
    named = best.select(
        "group_id", F.coalesce("normalized_axis_label", "axis").alias("normalized_axis_label"),
        F.coalesce("normalized_member_label", "member_label").alias("normalized_member_label"), *SAID[2:],
    )
    last = g.groupBy("group_id").agg(F.max("period_end").alias("group_max_period_end"))
    return g.select(*MEMBER, "group_id").join(named, "group_id").join(last, "group_id").withColumn("source", F.lit("grouping"))


def dimension_matches(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Differently named members whose amounts match from period to period and that never stand in one period together."""
    said = groups.select(*MEMBER, *SAID, "group_max_period_end")
    f = facts.join(said, MEMBER, "left").select(
        "company_id", "statement", "concept", "form_type", "normalized_label", "axis", "member", "member_label", "period_end", "comparative_period_end",
        F.coalesce("normalized_axis_label", "axis").alias("normalized_axis_label"), F.coalesce("normalized_member_label", "member_label").alias("normalized_member_label"),
        F.coalesce("overridden", F.lit(False)).alias("overridden"), "override_priority", "override_level",
        (F.col("value") * F.col("weight")).alias("amount"), (F.col("comparative_value") * F.col("weight")).alias("earlier"),
    )
    f = cut(f)
    n, o = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    axis, member = n("normalized_axis_label") == o("normalized_axis_label"), n("normalized_member_label") == o("normalized_member_label")
    levels = F.concat_ws("/", n("override_level"), o("override_level")).isin("axis/axis", "axis/member", "member/axis")
    may = ((~n("overridden") | ~o("overridden")) & (~axis | ~member)) | (levels & n("override_level").isNotNull() & o("override_level").isNotNull() & axis & ~member)
    m = value_matches(f, f, ["company_id", "form_type", "statement", "normalized_label"], ("earlier", "amount"), ("comparative_period_end", "period_end"), may)
    own = ["concept", "axis", "member", "member_label", *SAID, "period_end"]
    m = cut(m.select(n("company_id").alias("company_id"), n("statement").alias("statement"), n("normalized_label").alias("normalized_label"),
                     *[n(c).alias(f"{c}1") for c in own], *[o(c).alias(f"{c}2") for c in own]).distinct())
    # only pairs that are candidates are looked up in the periods, not all pairs of a period
    scope = ["company_id", "statement", "normalized_label"]
    name = ["normalized_axis_label", "normalized_member_label"]
    pairs = m.select(*scope, *[f"{c}{i}" for i in (1, 2) for c in name]).distinct()
    there = f.select(*scope, *name, "period_end").distinct()
    one = pairs.join(there.withColumnsRenamed({c: f"{c}1" for c in name}), [*scope, *[f"{c}1" for c in name]])
    met = one.join(there.withColumnsRenamed({c: f"{c}2" for c in name}), [*scope, *[f"{c}2" for c in name], "period_end"]).select(pairs.columns).distinct()
    return m.join(met, pairs.columns, "left_anti")


def dimension_chains(matches: DataFrame) -> DataFrame:
    """Older members under the name that the best row of their chain gives."""
    node = ["concept", "axis", "member", "member_label", "normalized_axis_label", "normalized_member_label"]
    scope = ["company_id", "statement", "normalized_label"]
    gid = F.md5(F.concat_ws("|", F.col("company_id").cast("string"), "statement", "concept1", "normalized_label", *[f"{c}1" for c in node[1:]], F.lit("chaining")))
    start = matches.select(*scope, *[F.col(f"{c}1").alias(c) for c in [*node, *SAID[2:]]], F.col("period_end1").alias("at"), F.col("period_end1").alias("group_max_period_end"), gid.alias("group_id"))
    m = cut(matches)

    def older(edge: DataFrame) -> DataFrame:
        on = m.select(*scope, *[F.col(f"{c}1").alias(c) for c in node], "period_end1", "period_end2", *[F.col(f"{c}2") for c in [*node, *SAID[2:]]])
        j = edge.select(*scope, *node, "at", "group_max_period_end", "group_id").join(on, [*scope, *node]).where("period_end1 <= at")
        return j.select(*scope, *[F.col(f"{c}2").alias(c) for c in [*node, *SAID[2:]]], F.col("period_end2").alias("at"), "group_max_period_end", "group_id")

    walked = follow(start, older)
    best = keep_first(walked, ["group_id"], [*_best_said(), F.desc("at"), *[F.asc(c) for c in ("normalized_axis_label", "normalized_member_label", "axis", "member", "member_label")]])
    given = best.select("group_id", *[F.col(c).alias(f"g_{c}") for c in SAID])
    j = walked.select(*MEMBER, "group_max_period_end", "group_id").join(given, "group_id")
    first = keep_first(j, MEMBER, [F.asc("g_normalized_axis_label"), F.asc("g_normalized_member_label"), F.desc("group_max_period_end"), F.asc("group_id")])
    return first.select(*MEMBER, "group_id", *[F.col(f"g_{c}").alias(c) for c in SAID], "group_max_period_end", F.lit("chaining").alias("source"))


def dimensions(base: DataFrame, concept_rules: DataFrame, dimension_rules: DataFrame, cn: DataFrame) -> DataFrame:
    """Normalized axis and member label of every dimension member, consistent over groups that share a member."""
    facts = labelled_dimension_facts(base, concept_rules, cn)
    groups = cut(dimension_groups(dimension_rows(facts, dimension_rules)))
    chains = dimension_chains(dimension_matches(facts, groups))
    cols = [*MEMBER, "group_id", *SAID, "group_max_period_end", "source"]
    both = cut(groups.select(cols).unionByName(chains.select(cols)))
    # groups are connected where they hold the same member; a component is named by its least group
    edges = both.select("group_id", F.concat(F.lit("~"), F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in MEMBER]))).alias("key"))
    comp = components(edges, "group_id", "key").where("not startswith(node, '~')")
    least = comp.groupBy("component").agg(F.min("node").alias("component_id"))
    of = comp.join(least, "component").select(F.col("node").alias("group_id"), "component_id")
    j = cut(both.join(of, "group_id"))
    best = keep_first(j, ["component_id"], [*_best_said(), F.desc("group_max_period_end"), *[F.asc(c) for c in ("normalized_axis_label", "normalized_member_label", "source", "group_id")]])
    given = best.select("component_id", *SAID, "source")
    first = j.groupBy(*MEMBER).agg(F.min("component_id").alias("component_id"))
    return first.join(given, "component_id").withColumnRenamed("component_id", "group_id").select(*MEMBER, *SAID[:2], "group_id", "source", *SAID[2:])


# -- facts ----------------------------------------------------------------------------------------------------------

FACT = [
    "id", "company_id", "filing_id", "form_type", "concept", "label", "normalized_label", "is_abstract", "value", "comparative_value", "weight", "unit", "axis", "member",
    "statement", "period_end", "comparative_period_end", "period", "position", "parent_id", "parent_concept", "abstract_id", "abstract_concept", "is_synthetic",
]


def _ancestor_key(concept: Column | str) -> Column:
    return F.concat_ws("|", "statement", concept, F.col("filing_id").cast("string"), F.col("company_id").cast("string"))


PLACE = ["company_id", "filing_id", "statement"]


def _reported(base: DataFrame, rules: DataFrame, hn: DataFrame) -> DataFrame:
    """Per company, filing and statement the ids of the facts of each concept that some rule names as an ancestor: a map `there`."""
    named = lambda on, t, c: t.where(f"{c} is not null").select(*on, F.col(c).alias("concept"))
    key, every = ["company_id", "statement"], rules.where("is_global")
    own = named(key, rules, "parent_concept").union(named(key, rules, "abstract_concept")).union(named(key, hn, "parent_concept")).distinct().withColumn("__own", F.lit(1))
    shared = named(key[1:], every, "parent_concept").union(named(key[1:], every, "abstract_concept")).distinct().withColumn("__all", F.lit(1))
    found = base.select(*PLACE, "concept", "id").join(small(own), [*key, "concept"], "left").join(small(shared), ["statement", "concept"], "left").where("__own is not null or __all is not null")
    ids = found.groupBy(*PLACE, "concept").agg(F.collect_list("id").alias("ids"))
    return ids.groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(F.struct("concept", "ids"))).alias("there"))


def _with_ancestors(rows: DataFrame, own_parent: Column, own_abstract: Column) -> DataFrame:
    """Set parent and abstract links of `rows`, which carry `rule`, `parents` of the hierarchies and `there`: to each reported fact, else to a key for a missing one.

    A row stands once for each pair of a parent and an abstract link.
    """
    link = lambda i, c: F.struct(i.cast("string").alias("id"), c.cast("string").alias("concept"))
    none = F.lit(None).cast("string")

    def to(concept: Column, source: Column) -> Column:
        return F.coalesce(F.transform(F.try_element_at("there", concept), lambda i: link(i, none)), F.array(link(_ancestor_key(source), source)))

    parents = F.when(F.col("rule.parent_concept").isNotNull(), to(F.col("rule.parent_concept"), F.col("rule.parent_concept"))).otherwise(
        F.flatten(F.transform("parents", lambda p: to(p["parent_concept"], p["parent_concept_source"])))
    )
    abstracts = F.when(F.col("rule.abstract_concept").isNotNull(), to(F.col("rule.abstract_concept"), F.col("rule.abstract_concept")))
    rows = rows.withColumns({"__p": F.array_distinct(F.coalesce(parents, F.array(link(own_parent, none)))), "__a": F.array_distinct(F.coalesce(abstracts, F.array(link(own_abstract, none))))})
    rows = rows.withColumn("__p", F.explode("__p")).withColumn("__a", F.explode("__a"))
    return rows.withColumns({"parent_id": F.col("__p.id"), "parent_concept": F.col("__p.concept"), "abstract_id": F.col("__a.id"), "abstract_concept": F.col("__a.concept")})


PERIODS = ["form_type", "period_end", "comparative_period_end", "period"]


class Ancestry:
    """What rules and hierarchies name as the ancestors of a concept, and which of them each filing reports. Prepared once, for all rows."""

    def __init__(self, base: DataFrame, rules: DataFrame, hn: DataFrame):
        self.key = ["company_id", "statement", "concept"]
        r = rules.select("company_id", "is_global", "statement", "concept", "normalized_label", "is_abstract", "weight", "unit", "parent_concept", "abstract_concept")
        self.book = RuleBook(r, ["statement", "concept"])
        self.parents = small(cut(hn.groupBy(*self.key).agg(F.collect_set(F.struct("parent_concept", "parent_concept_source")).alias("parents"))))
        self.there = cut(_reported(base.withColumn("id", F.col("id").cast("string")), r, hn))
        self.known = small(cut(self.there.select(*PLACE, F.map_keys("there").alias("known"))))

    def ruled(self, rows: DataFrame) -> DataFrame:
        """`rows` with the `rule` of their concept and its `parents` in the hierarchies."""
        # joins on the same key follow one another, so that the rows are shuffled once for them
        j = rows.join(self.book.own, self.key, "left").join(self.parents, self.key, "left").join(self.book.every, self.key[1:], "left")
        return j.withColumn("rule", F.coalesce("own", "every")).drop("own", "every")

    def _unreported(self, ruled: DataFrame) -> DataFrame:
        """The ancestors that `ruled` rows name and their filing does not report."""
        ask = lambda c, source: F.struct(c.alias("concept"), source.alias("source"))
        parent, abstract, none = F.col("rule.parent_concept"), F.col("rule.abstract_concept"), F.expr("array()")
        parents = F.when(parent.isNotNull(), F.array(ask(parent, parent))).otherwise(F.transform("parents", lambda p: ask(p["parent_concept"], p["parent_concept_source"])))
        abstracts = F.when(abstract.isNotNull(), F.array(ask(abstract, abstract)))
        asked = ruled.select(*PLACE, *PERIODS, F.explode(F.concat(F.coalesce(parents, none), F.coalesce(abstracts, none))).alias("x")).distinct()
        j = asked.join(self.known, PLACE, "left")
        j = j.where(~F.coalesce(F.array_contains("known", F.col("x.concept")), F.lit(False)) & F.col("x.source").isNotNull())
        return j.select(*PLACE, *PERIODS, F.col("x.source").alias("concept"))

    def made_up(self, base: DataFrame) -> DataFrame:
        """Rows for the ancestors that nobody reported.

        They are found by concept alone; the links to the reported facts, of which one ancestor may have thousands, are set once at the end.
        """
        # facts that differ in their members only name the same ancestors; they are shuffled once, by what all that follows looks up
        lines = base.select(*PLACE, *PERIODS, "concept").repartition(*PLACE).distinct()
        want = follow(self._unreported(self.ruled(lines)), lambda edge: self._unreported(self.ruled(edge).where("rule is not null")))
        ruled = self.ruled(want).where("rule is not null").withColumn("id", _ancestor_key("concept"))
        rows = _with_ancestors(ruled.join(self.there, PLACE, "left"), F.lit(None), F.lit(None))
        zero = F.lit(0).cast(MONEY)
        return rows.select(
            "id", "company_id", "filing_id", "form_type", "concept", F.col("rule.normalized_label").alias("label"), F.col("rule.normalized_label").alias("normalized_label"),
            F.col("rule.is_abstract").alias("is_abstract"), zero.alias("value"), zero.alias("comparative_value"), F.col("rule.weight").alias("weight"), F.col("rule.unit").alias("unit"),
            F.lit("").alias("axis"), F.lit("").alias("member"), "statement", "period_end", "comparative_period_end", "period", F.lit(99).alias("position"),
            "parent_id", "parent_concept", "abstract_id", "abstract_concept", F.lit(True).alias("is_synthetic"),
        )


def normalized_rows(base: DataFrame, cn: DataFrame, dn: DataFrame, ancestry: Ancestry, made: DataFrame) -> DataFrame:
    """Facts under their normalized labels, weights, units and dimensions, and the rows `made` up for ancestors nobody reported. The facts are written to the checkpoint folder."""
    key, book, parents, there = ancestry.key, ancestry.book, ancestry.parents, ancestry.there
    base = base.withColumn("id", F.col("id").cast("string"))
    # joins on the same key follow one another, so that the facts are shuffled once for them
    j = base.join(book.own, key, "left").join(cn.select(*key, F.col("normalized_label").alias("c_label"), F.col("weight").alias("c_weight"), F.col("unit").alias("c_unit")), key, "left")
    j = j.join(parents, key, "left").join(book.every, key[1:], "left").withColumn("rule", F.coalesce("own", "every")).drop("own", "every")
    j = j.withColumns({
        "normalized_label": F.coalesce("rule.normalized_label", "c_label", "label"),
        "__w": F.coalesce("rule.weight", "c_weight", "weight"),
        "unit": F.coalesce("rule.unit", "c_unit", "unit"),
    })
    d = dn.select(*MEMBER, F.col("normalized_axis_label").alias("d_axis"), F.col("normalized_member_label").alias("d_member"))
    j = j.join(d, MEMBER, "left").withColumns({
        "value": flip_sign(F.col("value"), F.col("weight"), F.col("__w")).cast(MONEY),
        "comparative_value": flip_sign(F.col("comparative_value"), F.col("weight"), F.col("__w")).cast(MONEY),
        "weight": F.col("__w"),
        "axis": F.coalesce("d_axis", "axis"),
        "member": F.coalesce("d_member", "member_label"),
        "is_synthetic": F.lit(False),
    })
    # the maps of reported facts come last, so that no row carries one through a shuffle
    facts = _with_ancestors(j.join(there, PLACE, "left"), F.col("parent_id"), F.col("abstract_id")).select(FACT)
    # a fact's rows are distinct as they are made; only a repeated id can give a row twice
    if not base.groupBy("id").count().where("count > 1").isEmpty():
        facts = facts.distinct()
    return cut(facts).unionByName(made.select(FACT))


def rolled_up(rows: DataFrame) -> DataFrame:
    """Synthetic rows with the weighted sum of what lies below them; other rows as they are.

    Contributions are summed per node in every round, so a round handles one row per node whatever the number of leaves.
    """
    wide = "decimal(38,10)"
    made = rows.where("is_synthetic and not is_abstract").groupBy(F.col("id").alias("node"), "parent_id", F.coalesce("weight", F.lit(1)).alias("w")).agg(F.count("*").alias("times"))
    made = cut(made)
    # what stands on or below a cycle of synthetic ancestors has no sum
    endless = breaks(made, ["node"], ["parent_id"]).where("verdict <> 'orphan'").select("node")
    links = cut(made.join(endless, "node", "left_anti"))
    # only a missing parent's key can name a synthetic row
    leaf = rows.where("not is_abstract and not is_synthetic and parent_concept is not null").select(
        F.col("parent_id").alias("node"), (F.col("value") * F.col("weight")).cast(wide).alias("v"), (F.col("comparative_value") * F.col("weight")).cast(wide).alias("c")
    )
    edge = cut(leaf.where("node is not null").groupBy("node").agg(F.sum("v").cast(wide).alias("v"), F.sum("c").cast(wide).alias("c")))
    total = None
    w = (F.col("w") * F.col("times")).cast("decimal(12,4)")
    for _ in range(MOST_ROUNDS):
        here = cut(edge.join(links, "node").select("node", "parent_id", (F.col("v") * w).cast(wide).alias("v"), (F.col("c") * w).cast(wide).alias("c")))
        if here.isEmpty():
            break
        total = here.drop("parent_id") if total is None else total.unionByName(here.drop("parent_id"))
        edge = here.where("parent_id is not null").groupBy(F.col("parent_id").alias("node")).agg(F.sum("v").cast(wide).alias("v"), F.sum("c").cast(wide).alias("c"))
    else:
        raise RuntimeError("the roll-up does not end")
    if total is None:
        return rows.withColumns({c: F.when(F.col("is_synthetic"), F.lit(None).cast(MONEY)).otherwise(F.col(c)) for c in ("value", "comparative_value")})
    # a node may stand in several rows (of other parents or periods); it passes on as much for each of them
    sums = total.groupBy("node").agg(F.sum("v").cast(MONEY).alias("__v"), F.sum("c").cast(MONEY).alias("__c"))
    j = rows.where("is_synthetic").join(sums, F.col("id") == F.col("node"), "left")
    summed = j.withColumns({"value": F.col("__v"), "comparative_value": F.col("__c")}).select(rows.columns)
    return rows.where("not is_synthetic").unionByName(summed)


def _id_order() -> list[Column]:
    return [F.col("is_synthetic"), F.expr("try_cast(id as bigint)"), F.col("id")]


def chain_sizes(rows: DataFrame) -> DataFrame:
    """(id, chain_size): the longest run of comparatives that passes through each fact.

    A fact leads to the fact of its series whose amount and period are its comparative ones, else to those of the same
    concept in that period; only to earlier periods, so that the walk ends. A series is sorted once and walked by `longest_runs`.
    """
    whole = " and ".join(f"{c} is not null" for c in SERIES)
    order = [F.col("period_end"), *_id_order(), *[F.asc_nulls_last(c) for c in ("concept", "comparative_value", "comparative_period_end")]]
    days = lambda c: F.unix_date(c).alias(c)
    # a fact stands in a row for each of its links; distinct first, else the series with most links would be one task's
    rows = rows.select("id", "is_synthetic", *SERIES, "concept", "value", "period_end", "comparative_value", "comparative_period_end").distinct()
    r = rows.select(
        "id", (F.row_number().over(Window.partitionBy(*SERIES).orderBy(*order)) == 1).alias("first"), F.expr(whole).alias("whole"), "concept",
        F.col("value").cast("string").alias("value"), days("period_end"), F.col("comparative_value").cast("string").alias("comparative_value"), days("comparative_period_end"),
    )
    return r.mapInArrow(longest_runs, "id string, chain_size int").groupBy("id").agg(F.max("chain_size").alias("chain_size"))


def normalized(rows: DataFrame) -> DataFrame:
    """One row per id, marked `is_duplicate` unless it is the best of its series and period.

    Amendments come first, then longer chains of comparatives, then lower ids.
    """
    rows = rolled_up(rows)
    rank = [F.when(F.col("form_type").isin("10-K/A", "10-Q/A"), 0).otherwise(1), F.coalesce("chain_size", F.lit(1)).desc(), *_id_order()]
    tie = [F.asc_nulls_last(c) for c in ("value", "comparative_value", "parent_id", "abstract_id", "concept", "label", "weight", "unit", "comparative_period_end", "period", "position")]
    # of a fact's rows (one for each of its links) only the first can come first in its period
    one = keep_first(rows, ["id", *SERIES, "period_end", "form_type"], tie)
    sized = one.join(chain_sizes(rows), "id", "left")
    w = Window.partitionBy(*SERIES, "period_end").orderBy(*rank, *tie)
    marked = sized.withColumn("is_duplicate", F.row_number().over(w) > 1).drop("chain_size", "parent_concept", "abstract_concept")
    return keep_first(marked, ["id"], [F.asc("is_duplicate"), *tie, F.asc("period_end")])


# -- series ---------------------------------------------------------------------------------------------------------


def _newest_first() -> list[Column]:
    return [F.desc("period_end"), *_id_order()]


def fiscal_tags(filings: DataFrame) -> DataFrame:
    """Filings with `fiscal_tag`: the id of the annual report a filing belongs to (its own, or the next one of the company)."""
    f = filings.where(F.col("form_type").isin(*ANNUAL, *QUARTERLY))
    f = next_matching(f, ["company_id"], [F.col("fiscal_period_end"), F.col("id")], F.col("form_type") == "10-K", F.col("id"), "__next")
    return f.select(F.col("id").alias("filing_id"), "company_id", "fiscal_year", "fiscal_quarter", F.when(F.col("form_type") == "10-K", F.col("id")).otherwise(F.col("__next")).alias("fiscal_tag"))


OUT = [
    "id", "parent_id", "company_id", "filing_id", "concept", "label", "normalized_label", "value", "weight", "unit", "axis", "member", "statement", "abstract_id",
    "period_end", "fiscal_year", "fiscal_quarter", "position", "is_abstract", "is_synthetic", "source_type",
]


def _aligned(facts: DataFrame) -> DataFrame:
    rows = with_latest(facts, SERIES, _newest_first(), ["abstract_id", "position", "weight"])
    return rows.withColumns({
        "value": flip_sign(F.col("value"), F.col("weight"), F.col("latest_weight")).cast(MONEY),
        "abstract_id": F.col("latest_abstract_id"), "position": F.col("latest_position"), "weight": F.col("latest_weight"),
    }).withColumn("source_type", F.col("form_type"))


def quarterly(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Quarterly series: reported quarters, running totals undone, and the last quarter as the year less the others."""
    rows = cut(_aligned(facts.where("not is_duplicate").join(fiscal_tags(filings), ["company_id", "filing_id"])))
    q = rows.where(F.col("source_type").isin(*QUARTERLY))
    order = [F.asc("period_end"), *_id_order()]
    q = q.withColumn("value", undo_running_total(q, SERIES, "period_end", "value", F.col("period") == "YTD", order).cast(MONEY))
    a = rows.where(F.col("source_type").isin(*ANNUAL))
    still = (F.col("statement") == "Balance Sheet") | F.col("normalized_label").ilike("Shares Outstanding%")
    last = residual(a.where(~still), q, [*SERIES, "fiscal_tag"], "value").withColumn("source_type", F.lit("calculated")).withColumn("value", F.col("value").cast(MONEY))
    return q.select(OUT).unionByName(a.where(still).select(OUT)).unionByName(last.select(OUT))


def yearly(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Yearly series from annual reports."""
    f = filings.select(F.col("id").alias("filing_id"), "company_id", "fiscal_year")
    rows = _aligned(facts.where(F.col("form_type").isin(*ANNUAL)).where("not is_duplicate").join(f, ["company_id", "filing_id"]))
    return rows.withColumn("source_type", F.lit("10-K")).select([c for c in OUT if c != "fiscal_quarter"])
