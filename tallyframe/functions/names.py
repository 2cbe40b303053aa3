"""Column functions on names and typed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concept_key(c: Column | str) -> Column:
    """One spelling per concept: letter case, blanks and the mark (`:` or `_`) after the prefix make no difference.

    Null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"[\s ]+", "")), r"^([^:_]*)[:_]", "$1:")


def folded(c: Column | str) -> Column:
    """Lower case without outer blanks; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
