"""Filters: or within a dimension, and across; a closed set of dimensions compiled to one predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import CONFLICTED, UNPROVIDED

#: Dimensions with choices, and those with a range.
CHOICES = ("phase", "scale", "applicant", "enroll")
RANGES = ("period", "updated")
SPECIAL = (UNPROVIDED, CONFLICTED)
_RANGE = re.compile(r"(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})", re.ASCII)


@dataclass
class FilterState:
    """Chosen values by dimension; a range is a day range or one of the two special values."""

    choices: dict[str, list[str]] = field(default_factory=lambda: {k: [] for k in CHOICES})
    ranges: dict[str, str | None] = field(default_factory=lambda: dict.fromkeys(RANGES))

    def active(self, dimension: str) -> bool:
        return bool(self.choices.get(dimension)) if dimension in CHOICES else self.ranges[dimension] is not None


def parse_range(text: str) -> tuple[str, str] | None:
    """yyyy-mm-dd..yyyy-mm-dd with low <= high; the calendar is not consulted, nothing is swapped."""
    m = _RANGE.fullmatch(text)
    return (m[1], m[2]) if m and m[1] <= m[2] else None


def period_category(conflict: Column, start: Column, end: Column) -> Column:
    """conflicted if either end is, unprovided if either is null, else null (then the overlap decides)."""
    return F.when(F.coalesce(conflict, F.lit(False)), F.lit(CONFLICTED)).when(start.isNull() | end.isNull(), F.lit(UNPROVIDED))


def overlaps(start: Column, end: Column, low: str, high: str) -> Column:
    return (start <= F.lit(high)) & (end >= F.lit(low))


def dimension(name: str, state: FilterState, columns: dict[str, Column]) -> Column:
    """Predicate of one dimension; an inactive one passes all, an unreadable range passes none.

    columns: the category of phase, scale and applicant; enroll as an array of
    labels; period_category, period_start and period_end; updated (or null).
    Dates are compared as ISO text.
    """
    if not state.active(name):
        return F.lit(True)
    if name == "enroll":
        return F.arrays_overlap(columns["enroll"], F.array(*map(F.lit, state.choices[name])))
    if name in CHOICES:
        return columns[name].isin(*state.choices[name])
    wanted = state.ranges[name]
    if name == "period":
        special = columns["period_category"]
    else:
        special = F.when(columns["updated"].isNull(), F.lit(UNPROVIDED))
    if wanted in SPECIAL:
        return F.coalesce(special == wanted, F.lit(False))
    found = parse_range(wanted)
    if found is None:
        return F.lit(False)
    if name == "period":
        hit = overlaps(columns["period_start"], columns["period_end"], *found)
    else:
        hit = columns["updated"].between(*map(F.lit, found))
    return special.isNull() & F.coalesce(hit, F.lit(False))


def apply_filters(entities: DataFrame, state: FilterState, columns: dict[str, Column]) -> DataFrame:
    active = [dimension(d, state, columns) for d in (*CHOICES, *RANGES) if state.active(d)]
    return entities.where(reduce(lambda a, b: a & b, active)) if active else entities


def unknown_choices(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """Chosen (dimension, value) that no entity has; the condition stays active all the same."""
    return chosen.where(~F.col("value").isin(*SPECIAL)).join(known, ["dimension", "value"], "left_anti")


def type_ahead(options: DataFrame, typed: str, checked: list[str]) -> DataFrame:
    """Options whose label holds the typed text, and those already checked."""
    return options.where(F.lower("label").contains(typed.lower()) | F.col("value").isin(*checked) if checked else F.lower("label").contains(typed.lower()))
