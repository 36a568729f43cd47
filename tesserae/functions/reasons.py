"""Reason lists: every failed rule is named, an empty list means that all hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose predicate is true, in the order given; an unknown predicate names nothing."""
    return F.array_compact(F.array(*(F.when(predicate, F.lit(name)) for name, predicate in rules)))


def first_reason(*rules: tuple[str, Column], otherwise: str | None = None) -> Column:
    """Name of the first rule whose predicate is true."""
    out = F.lit(otherwise).cast("string")
    for name, predicate in reversed(rules):
        out = F.when(predicate, F.lit(name)).otherwise(out)
    return out


def status(found: Column, filters: list[str]) -> Column:
    """excluded if any filter reason is among the found ones, else withheld if there is any reason, else ranked."""
    return F.when(F.arrays_overlap(found, F.array(*map(F.lit, filters))), "excluded").when(F.size(found) > 0, "withheld").otherwise("ranked")
