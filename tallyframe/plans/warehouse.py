"""The warehouse tables as the pipeline reads them, and its stages over a table folder."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import concept_key
from ..session import cut
from ..sources.tables import table
from . import normalization as N
from .curation import override_records


def form_type(c: str = "form_type") -> Column:
    """A form type in its usual spelling: upper case, an amendment with a slash."""
    return F.regexp_replace(F.upper(F.trim(c)), r"^(10-[KQ])/?A$", "$1/A")


def facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts with concepts and form types in one spelling."""
    return table(spark, root, "financial_facts").withColumns({"concept": concept_key("concept"), "form_type": form_type()})


def filings(spark: SparkSession, root: str) -> DataFrame:
    """Filings with form types in one spelling."""
    return table(spark, root, "filings").withColumn("form_type", form_type())


def concept_rules(spark: SparkSession, root: str) -> DataFrame:
    """Concept rules with concepts in one spelling."""
    t = table(spark, root, "concept_normalization_overrides")
    return t.withColumns({c: concept_key(c) for c in ("concept", "parent_concept", "abstract_concept")})


def dimension_rules(spark: SparkSession, root: str) -> DataFrame:
    """Dimension rules."""
    return table(spark, root, "dimension_normalization_overrides")


def fact_rules(spark: SparkSession, root: str) -> DataFrame:
    """Fact rules: the sound records of the uploaded fact-override files; the line id stands for id and recency."""
    cols = "company_id concept statement axis member label form_type from_period to_period to_concept to_axis to_member to_member_label to_weight is_global".split()
    lines = table(spark, root, "raw_override_lines").select("line_id", "file_name")
    r = override_records(spark, root, cols).where("reason is null").join(lines, "line_id").where("file_name = 'financial-facts-overrides'")
    return r.select(
        F.col("line_id").alias("id"), F.col("company_id").cast("int").alias("company_id"), concept_key("concept").alias("concept"), "statement", "axis", "member", "label", "form_type",
        "from_period", "to_period", concept_key("to_concept").alias("to_concept"), "to_axis", "to_member", "to_member_label", "to_weight",
        (F.coalesce("is_global", F.lit(False)) & (F.col("company_id") == 0)).alias("is_global"), F.col("line_id").alias("updated_at"),
    )


class Stages:
    """The pipeline over base tables and rules, each stage computed once."""

    def __init__(self, facts: DataFrame, filings: DataFrame, concept_rules: DataFrame, dimension_rules: DataFrame, fact_rules: DataFrame):
        self.facts, self.filings = facts, filings
        self.concept_rules, self.dimension_rules, self.fact_rules = cut(concept_rules), dimension_rules, cut(fact_rules)

    @classmethod
    def of(cls, spark: SparkSession, root: str) -> Stages:
        """The pipeline over a folder of warehouse tables."""
        return cls(facts(spark, root), filings(spark, root), concept_rules(spark, root), dimension_rules(spark, root), fact_rules(spark, root))

    @cached_property
    def ancestry(self) -> N.Ancestry:
        return N.Ancestry(self.stage("base"), self.concept_rules, self.stage("hierarchies"))

    @lru_cache(maxsize=None)
    def stage(self, name: str) -> DataFrame:
        s = self.stage
        made = {
            "overridden": lambda: N.overridden(self.facts, self.fact_rules),
            "base": lambda: N.base_facts(self.facts, s("overridden")),
            "concepts": lambda: N.concepts(s("base"), self.concept_rules),
            "hierarchies": lambda: N.hierarchies(s("concepts"), self.concept_rules),
            "dimensions": lambda: N.dimensions(s("base"), self.concept_rules, self.dimension_rules, s("concepts")),
            "ancestors": lambda: self.ancestry.made_up(s("base")),
            "rows": lambda: N.normalized_rows(s("base"), s("concepts"), s("dimensions"), self.ancestry, s("ancestors")),
            "normalized": lambda: N.normalized(s("rows")),
            "quarterly": lambda: N.quarterly(s("normalized"), self.filings),
            "yearly": lambda: N.yearly(s("normalized"), self.filings),
        }[name]()
        return made if name == "rows" else cut(made)  # the rows are written as they are made
