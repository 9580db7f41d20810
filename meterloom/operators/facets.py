"""Facets: what a query is restricted to."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import DAY_MS, midnight_ms

RANGES = {"day": 1, "week": 7, "month": 30}


@dataclass(frozen=True)
class Facets:
    """``start`` and ``end`` bound the epoch milliseconds, half open. ``project`` is a working folder."""

    start: int | None = None
    end: int | None = None
    model: str | None = None
    source: str | None = None
    project: str | None = None
    unknown_project: bool = False
    sessionless: bool = True

    @classmethod
    def preset(cls, name: str, midnight: int, **more) -> Facets:
        """A range of whole days that ends with the day that starts at ``midnight``, or ``all``."""
        if name == "all":
            return cls(**more)
        return cls(start=midnight - (RANGES[name] - 1) * DAY_MS, end=midnight + DAY_MS, **more)


def date_bounds(first: str | None, last: str | None, zone: str) -> tuple[Column, Column] | None:
    """Bounds of inclusive local dates; None (everything) if either is missing."""
    if not first or not last:
        return None
    return midnight_ms(F.lit(first).cast("date"), zone), midnight_ms(F.date_add(F.lit(last).cast("date"), 1), zone)


def from_main(source: Column) -> Column:
    """Everything that is not exactly ``subagent``, null included."""
    return ~source.eqNullSafe(F.lit("subagent"))


def conditions(facets: Facets) -> Column:
    """The facets on the request's own columns."""
    parts: list[Column] = [F.lit(True)]
    if facets.start is not None:
        parts.append(F.col("timestamp_ms") >= facets.start)
    if facets.end is not None:
        parts.append(F.col("timestamp_ms") < facets.end)
    if facets.model is not None:
        parts.append(F.col("model") == facets.model)
    if facets.source is not None:
        parts.append(F.col("query_source") == "subagent" if facets.source == "subagent" else from_main(F.col("query_source")))
    if not facets.sessionless:
        parts.append(F.col("session_id").isNotNull())
    return reduce(lambda a, b: a & b, parts)


def apply_facets(requests: DataFrame, sessions: DataFrame, facets: Facets) -> DataFrame:
    """The requests that fit all facets.

    A project is a semi join; the unknown project an anti join with the sessions that have one, which
    keeps requests without a session and never becomes a nested loop.
    """
    found = requests.where(conditions(facets))
    if facets.project is not None:
        found = found.join(sessions.where(F.col("cwd") == facets.project).select("session_id"), "session_id", "left_semi")
    if facets.unknown_project:
        found = found.join(sessions.where("cwd is not null").select("session_id"), "session_id", "left_anti")
    return found
