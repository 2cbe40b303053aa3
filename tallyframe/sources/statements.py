"""Statement files of filings: five wide statements per filing, three of which must be there, and raw facts by concept and axis."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statement -> whether a filing without it cannot be loaded.
STATEMENTS = {"Income Statement": True, "Balance Sheet": True, "Cash Flow Statement": True, "Comprehensive Income": False, "Statement of Equity": False}


def file_name(statement: str) -> str:
    """The name a statement's file begins with."""
    return statement.lower().replace(" ", "_")


def read_statements(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The wide statements of the filings in `folder` (`income_statement.parquet` or `.json`, ...).

    A mandatory statement that is missing or unreadable raises FileNotFoundError; of the others, those that cannot be read are left out.
    """
    out = {}
    for name, needed in STATEMENTS.items():
        for kind in ("parquet", "json"):
            try:
                out[name] = spark.read.format(kind).load(f"{folder}/{file_name(name)}.{kind}")
                break
            except AnalysisException:
                continue
        else:
            if needed:
                raise FileNotFoundError(f"{folder} has no readable {name}")
    return out


def containing(concept: str | None = None, axis: str | None = None) -> Column:
    """Facts whose concept and axis contain texts, letter case aside; None asks for nothing, an axis of '' for facts without one."""
    found = F.lit(True)
    if concept is not None:
        found = found & F.contains(F.lower("concept"), F.lit(concept.lower()))
    if axis is not None:
        found = found & (F.contains(F.lower("axis"), F.lit(axis.lower())) if axis else F.col("axis") == "")
    return found
