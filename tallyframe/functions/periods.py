"""Column functions on reporting periods and fact keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """The date at the start of an ISO text, null if there is none."""
    return F.try_to_date(F.split(c, "T")[0], "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(c)


def fiscal_quarter(d: Column) -> Column:
    """Fiscal quarter of a period end: March to May 1, June to August 2, September to November 3, else 4."""
    m = F.month(d)
    return F.when(m.between(3, 5), 1).when(m.between(6, 8), 2).when(m.between(9, 11), 3).when(m.isNotNull(), 4)


def period_type_of_column(name: Column, statement: Column) -> Column:
    """Q, YTD or null of a period column's name: balance sheets and names without an ISO date have none."""
    dated = name.rlike(r"\b\d{4}-\d{2}-\d{2}\b")
    quarter = F.lower(name).rlike("q[1-4]|quarter")
    return F.when((statement == "Balance Sheet") | ~dated, None).when(quarter, "Q").otherwise("YTD")


def period_type_of_dates(start: Column, end: Column, form: Column) -> Column:
    """YTD for annual forms, Q for up to 100 days or unknown dates, else YTD."""
    days = F.datediff(end, start)
    return F.when(form.isin("10-K", "10-K/A"), "YTD").when(days.isNull() | (days <= 100), "Q").otherwise("YTD")


def column_parts(name: str) -> tuple[str, str] | None:
    """(date, mark) of a period column such as `2024-03-31 (Q1)`; the mark may be empty. Other names have no parts."""
    m = re.fullmatch(r"(\S+)(?: (\S+))?", name)
    return (m[1], m[2] or "") if m else None


def comparative_column(columns: list[str], latest: str) -> str | None:
    """The first column of another date that bears the same mark as `latest` (or, as it, none)."""
    own = column_parts(latest)
    parted = ((c, column_parts(c)) for c in columns)
    return next((c for c, p in parted if own and p and p[0] != own[0] and p[1] == own[1]), None)


#: Fixed value: the namespace of object identifiers, for name-based UUIDs.
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5) of a text in the namespace of object identifiers."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 8).cast("long")))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
