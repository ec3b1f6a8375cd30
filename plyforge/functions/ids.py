"""Identifiers that carry meaning: audits, matchups, runs; and tolerant numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyforge.functions.boards import strip

_PART = r"[A-Za-z0-9_-]+"


def audit_id(number: Column) -> Column:
    """``AUDIT_V`` and at least four digits; null below 1."""
    return F.when(number >= 1, F.format_string("AUDIT_V%04d", number.cast("bigint")))


def matchup_key(a: Column, b: Column) -> Column:
    """Two identifiers joined by two underscores; null if either isn't one."""
    return F.when(a.rlike(rf"\A{_PART}\z") & b.rlike(rf"\A{_PART}\z"), F.concat(a, F.lit("__"), b))


def run_id(key: Column, attempt: Column) -> Column:
    """A matchup or audit with ``__run`` and at least three digits; null below 1."""
    return F.when(key.rlike(rf"\A{_PART}\z") & (attempt >= 1), F.concat(key, F.format_string("__run%03d", attempt.cast("bigint"))))


def run_parts(run: Column) -> Column:
    """struct(key, attempt) of a run id, null if it isn't one or isn't spelled as :func:`run_id` spells it (with any padding of six digits or fewer)."""
    grammar = rf"\A({_PART})__run([0-9]{{3,}})\z"
    attempt = F.regexp_extract(run, grammar, 2).try_cast("bigint")
    return F.when(run.rlike(grammar) & (attempt >= 1), F.struct(F.regexp_extract(run, grammar, 1).alias("key"), attempt.alias("attempt")))


def int_or_null(text: Column) -> Column:
    """Blank or null is missing; so is what is no whole number (underscores between digits aren't taken)."""
    return F.nullif(strip(text), F.lit("")).try_cast("bigint")
