"""The address as a query language: text <-> state; parsing a built address gives it back."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl, quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import CHOICES, RANGES, FilterState, parse_range
from ..operators.identity import lookup

#: Known parameters in canonical order, and the values of the scope.
PARAMETERS = ("q", "trial", "protocol", "phase", "scale", "applicant", "enroll", "period", "updated", "fields", "history")
SCOPE_VALUES = {"fields": ("short", "all"), "history": ("latest", "all")}


@dataclass
class QueryState:
    q: str = ""
    trial: str | None = None
    protocol: str | None = None
    filters: FilterState = field(default_factory=FilterState)
    fields: str = "short"
    history: str = "latest"
    unknown: list[tuple[str, str]] = field(default_factory=list)

    @property
    def scope(self) -> tuple[str, str]:
        return self.fields, self.history

    def browsing(self) -> bool:
        return not self.q.strip() and self.trial is None and self.protocol is None and not any(map(self.filters.active, (*CHOICES, *RANGES)))


def parse_url(search: str) -> tuple[QueryState, list[tuple[str, str]]]:
    """(state, errors as (parameter, value)).

    A value that is no range stays as the condition it is and is an error, the
    special values too, which no address is built with; a bad scope falls back.
    """
    state, errors = QueryState(), []
    for key, value in parse_qsl(search.removeprefix("?"), keep_blank_values=True):
        if key in ("q", "trial", "protocol"):
            setattr(state, key, value)
        elif key in CHOICES:
            state.filters.choices[key].append(value)
        elif key in RANGES:
            state.filters.ranges[key] = value
            if parse_range(value) is None:
                errors.append((key, value))
        elif key in SCOPE_VALUES:
            if value in SCOPE_VALUES[key]:
                setattr(state, key, value)
            else:
                errors.append((key, value))
        else:
            state.unknown.append((key, value))
    for values in state.filters.choices.values():
        values.sort()
    return state, errors


def parameters(address: Column) -> Column:
    """array<struct<name, value>> of the parameters of addresses in a column, decoded, in order; parse_url() for a table of them.

    Empty parts go, a part without = has an empty value, and what cannot be decoded stays as it is.
    """
    parts = F.filter(F.split(F.regexp_extract(address, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.transform(parts, lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("name"), plain(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("value")))


def resolve_protocol(state: QueryState, trials: DataFrame) -> tuple[QueryState, list[tuple[str, str]]]:
    """An address that names an identifier -> the state that names its entity instead, or what is wrong (rejected, notFound) with it.

    Either way the identifier goes from the state, so nothing is searched by it.
    """
    if state.protocol is None:
        return state, []
    asked = trials.sparkSession.createDataFrame([(state.protocol,)], "raw string")
    found = lookup(asked, trials).select("outcome", "tid").limit(1).collect()[0]
    errors = [] if found.outcome == "match" else [("protocol", found.outcome)]
    return replace(state, protocol=None, trial=found.tid if found.outcome == "match" else state.trial), errors


def build_url(state: QueryState) -> str:
    pairs: list[tuple[str, str]] = []
    default = QueryState()
    for key in PARAMETERS:
        if key in CHOICES:
            pairs += [(key, v) for v in sorted(state.filters.choices[key])]
        elif key in RANGES:
            pairs += [(key, state.filters.ranges[key])] if state.filters.ranges[key] is not None else []
        elif getattr(state, key) != getattr(default, key):
            pairs.append((key, getattr(state, key)))
    text = "&".join(f"{quote(k, safe="!'()*-._~")}={quote(v, safe="!'()*-._~")}" for k, v in [*pairs, *state.unknown])
    return f"?{text}" if text else ""
