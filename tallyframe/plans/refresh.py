"""Recomputing the derived tables of some companies in a table store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import TableStore
from .warehouse import Stages

#: Derived tables, in the order they build on each other, and the stage that makes each.
DERIVED = {
    "financial_facts_overridden": "overridden",
    "concept_normalization": "concepts",
    "hierarchy_normalization": "hierarchies",
    "dimension_normalization": "dimensions",
    "financial_facts_normalized": "normalized",
    "quarterly_financials": "quarterly",
    "yearly_financials": "yearly",
}
#: Tables the pipeline reads; the rule tables may hold rules of company 0 for all.
BASE = ("financial_facts", "filings")
RULES = ("concept_normalization_overrides", "dimension_normalization_overrides", "financial_facts_overrides")


def compute(store: TableStore, companies: Sequence[int] | None) -> dict[str, DataFrame]:
    """The derived tables of some companies, or of all. Every stage works within a company, so the others need not be read."""
    base = [store.read(t, companies) for t in BASE]
    stages = Stages(*base, *[store.read(t) for t in RULES])
    return {name: stages.stage(stage) for name, stage in DERIVED.items()}


def refresh(spark: SparkSession, store: TableStore, companies: Sequence[int] | None = None) -> list[str]:
    """Recompute the derived tables of `companies`, of all that have facts or derived rows if None; nothing happens for an empty list. Names of the tables written.

    All results are computed before the first is stored; a company whose facts are gone ends without derived rows, and other
    companies keep theirs. Running it twice changes nothing.
    """
    if companies is None:
        made = compute(store, None)
        for name, df in made.items():
            store.write(name, df)
        return list(made)
    if not companies:
        return []
    made = compute(store, companies)
    for name, df in made.items():
        store.replace_companies(name, df, companies)
    return list(made)


def refresh_report(spark: SparkSession, store: TableStore, companies: Sequence[int] | None = None) -> dict[str, object]:
    """What a refresh did, with a failure told in the report instead of raised: `success`, `tables` written and `error`."""
    try:
        return {"success": True, "tables": refresh(spark, store, companies), "error": None}
    except Exception as e:  # the report is the answer to a failure
        return {"success": False, "tables": [], "error": f"{type(e).__name__}: {e}"}
