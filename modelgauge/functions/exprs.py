"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
STATUS_RANK = {"UNKNOWN": 0, "PASS": 1, "SKIPPED": 2, "ERROR": 3, "FAIL": 4}
TRIVIAL = ("not_null", "unique")
STRUCTURAL = ("accepted_values", "relationships", "unique_combination_of_columns", "dbt_utils.at_least_one", "dbt_utils.not_constant", "dbt_utils.not_empty_string")
WEIGHTS = {"TRIVIAL": 0.0, "STRUCTURAL": 0.25, "LOGICAL": 1.0, "UNKNOWN": 0.0}


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regular expression; a star also matches slashes, and brackets may be negated by '!'."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner.replace("^", "\\^", 1) if inner.startswith("^") else inner) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_any(column: Column, globs: list[str]) -> Column:
    if not globs:
        return F.lit(False)
    return F.coalesce(column.rlike("|".join(glob_regex(g) for g in globs)), F.lit(False))


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def map_status(raw: Column, warn_passes: bool = True) -> Column:
    """The status of a run result's text."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return (
        F.when(s.isin("pass", "success"), "PASS")
        .when(s == "warn", "PASS" if warn_passes else "FAIL")
        .when(s == "fail", "FAIL")
        .when(s.isin("error", "runtime error"), "ERROR")
        .when(s.isin("skipped", "skip"), "SKIPPED")
        .otherwise("UNKNOWN")
    )


def test_class(kind: Column, logical: list[str] | None = None, structural: list[str] | None = None, trivial: list[str] | None = None) -> Column:
    """The class of a test's kind: the user's globs come first, logical before structural before trivial."""
    k = F.trim(F.coalesce(kind, F.lit("")))
    return (
        F.when(matches_any(k, logical or []), "LOGICAL")
        .when(matches_any(k, structural or []), "STRUCTURAL")
        .when(matches_any(k, trivial or []), "TRIVIAL")
        .when(k.isin(*TRIVIAL), "TRIVIAL")
        .when(k.isin(*STRUCTURAL), "STRUCTURAL")
        .when(k == "", "UNKNOWN")
        .otherwise("LOGICAL")
    )


def class_weight(cls: Column, weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        out = F.when(cls == name, float(w)).otherwise(out)
    return out


def fingerprint(rule: Column, path: Column, context: Column) -> Column:
    return F.substring(F.sha2(F.concat(rule, F.lit("\0"), path, F.lit("\0"), context), 256), 1, 16)


def normalize_snippet(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def code_context(text: Column, line: Column, around: int = 2) -> Column:
    """The lines around one line (from 1), normalised."""
    lines = F.split(text, "\n")
    first = F.greatest(line - around, F.lit(1))
    return normalize_snippet(F.array_join(F.slice(lines, first, F.least(line + around, F.size(lines)) - first + 1), "\n"))


def jinja_branches(source: Column) -> tuple[Column, Column]:
    """How many conditions and loops a template opens."""
    return F.regexp_count(source, F.lit(r"\{%-?\s*(if|elif)\b")), F.regexp_count(source, F.lit(r"\{%-?\s*for\b"))


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def unit_test_defect(given: Column, expect: Column, rows: Column) -> Column:
    """Why a unit test is malformed, or null; given and rows are arrays."""
    return (
        F.when(given.isNull(), "given_missing")
        .when(F.size(given) == 0, "given_empty")
        .when(expect.isNull(), "expect_missing")
        .when(rows.isNull(), "expect_rows_missing")
        .when(F.size(rows) == 0, "expect_rows_empty")
    )
