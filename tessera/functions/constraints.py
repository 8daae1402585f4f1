"""Constraints on paths. A path is an array of steps ``struct<s, r, o, s_type, o_type, ts, ...>``; each check says whether
the path violates it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strings


def head(steps: Column) -> Column:
    return F.get(steps, F.lit(0))["s"]


def tail(steps: Column) -> Column:
    return F.try_element_at(steps, F.lit(-1))["o"]


def node_sequence(steps: Column) -> Column:
    return F.when(F.size(steps) > 0, F.concat(F.array(head(steps)), F.transform(steps, lambda x: x["o"]))).otherwise(F.array().cast("array<string>"))


def relations(steps: Column) -> Column:
    return F.transform(steps, lambda x: x["r"])


def domain_range_edge(steps: Column, schema: Sequence[tuple[str, str, str]]) -> Column:
    """Position of the first step whose (s_type, r, o_type) the schema doesn't admit; null if all do or it is empty."""
    if not schema:
        return F.lit(None).cast("int")
    allowed = strings([f"{a}\x1f{r}\x1f{b}" for a, r, b in schema])
    bad = F.transform(steps, lambda x, i: F.when(~F.array_contains(allowed, F.concat_ws("\x1f", x["s_type"], x["r"], x["o_type"])), i))
    return F.array_min(bad)


def violates_domain_range(steps: Column, schema: Sequence[tuple[str, str, str]]) -> Column:
    return domain_range_edge(steps, schema).isNotNull()


def violates_answer_type(steps: Column, expected: Column) -> Column:
    """The last object's type is not among the expected ones; no expectation admits all."""
    return F.coalesce((F.size(expected) > 0) & ~F.array_contains(expected, F.try_element_at(steps, F.lit(-1))["o_type"]), F.lit(False))


def violates_monotone_time(steps: Column) -> Column:
    """A time stamp is smaller than the one before it; steps without one are skipped."""
    times = F.filter(F.transform(steps, lambda x: x["ts"]), lambda t: t.isNotNull())
    return F.exists(F.zip_with(F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: b < a), lambda x: x)


def violates_actor_event(steps: Column, allowed: Sequence[tuple[str, str]]) -> Column:
    """A step's (s_type, r) is not allowed; an empty list allows all."""
    if not allowed:
        return F.lit(False)
    pairs = strings([f"{a}\x1f{r}" for a, r in allowed])
    return F.exists(steps, lambda x: ~F.array_contains(pairs, F.concat_ws("\x1f", x["s_type"], x["r"])))


ACCESS_RELATIONS = ("has_role", "grants", "governed_by", "valid_in")


def access_reason(steps: Column, active_context: Column, strict: bool = True) -> Column:
    """Why a path grants nothing, or null: it is empty, it has a denial, it lacks a relation of the rule (``strict``),
    it has a revocation no later than its latest time, or the context active then is none of its valid ones.

    ``active_context`` is the context at the path's latest time stamp, null if the schedule doesn't know it.
    """
    rels = relations(steps)
    latest = F.array_max(F.filter(F.transform(steps, lambda x: x["ts"]), lambda t: t.isNotNull()))
    valid_in = F.transform(F.filter(steps, lambda x: x["r"] == "valid_in"), lambda x: x["o"])
    reason = F.when(F.size(steps) == 0, F.lit("empty path")).when(F.array_contains(rels, F.lit("denied_for")), F.lit("explicit deny"))
    if strict:
        reason = reason.when(F.size(F.array_except(strings(ACCESS_RELATIONS), rels)) > 0, F.lit("incomplete chain"))
    reason = reason.when(F.exists(steps, lambda x: (x["r"] == "revoked_at") & (x["ts"] <= latest)), F.lit("revoked"))
    return reason.when(active_context.isNotNull() & (F.size(valid_in) > 0) & ~F.array_contains(valid_in, active_context), F.lit("inactive context"))
