"""Column functions: normalisers, missing values, periods, intervals and lexicon patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_words(c: Column) -> Column:
    """Lower case, runs of non-word characters to one space, trimmed (norm_w)."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))


def norm_space(c: Column) -> Column:
    """Runs of white space to one space, trimmed, lower case; null to '' (norm_ws)."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def missing(c: Column, mode: str = "any") -> Column:
    """F1. any: null, blank (white space of any kind) or 'empty' in any case; dashes: the same with 'empty' as written, and '--'; null: null or ''."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bad = {"any": (t == "") | (F.lower(t) == "empty"), "dashes": t.isin("", "empty", "--"), "null": c == ""}[mode]
    return c.isNull() | bad


def quarter(c: Column) -> Column:
    """2025-Q4"""
    return F.concat(F.year(c), F.lit("-Q"), F.quarter(c))


def iso_week(c: Column) -> Column:
    """2025-W01, by the ISO year."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def wilson(k: Column, n: Column, z: float = 1.96, empty: float | None = None, clamped: bool = True) -> tuple[Column, Column]:
    """Bounds of a share, within 0 and 1 unless clamped is off; where n is 0 both are `empty`."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    low, high = (F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)) if clamped else (mid - half, mid + half)
    return F.when(n > 0, low).otherwise(F.lit(empty)), F.when(n > 0, high).otherwise(F.lit(empty))


def term_pattern(term: str, lang: str = "en") -> str:
    """A term as a pattern: starts and ends at a word's edges, a run with a hyphen may be one hyphen, blank or nothing, a run of blanks any blanks and
    hyphens, with an optional plural; a Swedish word takes any ending."""
    pieces = re.split(r"([-\s]+)", term.strip().lower())
    body = "".join((r"[-\s]?" if "-" in x else r"[-\s]+") if i % 2 else re.escape(x) for i, x in enumerate(pieces))
    end = r"\w*" if lang == "sv" else r"(?:e?s)?"
    return rf"(?U)(?<!\w){body}{end}(?!\w)"


def lexicon_pattern(term: str, variants: list[str], lang: str = "en") -> str:
    """The pattern of a term and its variants. Variants that begin with re: are patterns themselves, with § for |, and stand for all plain forms."""
    raw = [v[3:].replace("§", "|") for v in variants if v.startswith("re:")]
    return "(?iu)" + "|".join(raw or [term_pattern(x, lang) for x in [term, *variants]])


def flag(text: Column, terms: list[tuple[str, str]]) -> Column:
    """The terms found in a text; the longest plain piece of a term is looked for before its pattern."""
    low = F.lower(text)
    found = [F.when(low.contains(max(re.split(r"\W+", t.lower()), key=len)) & low.rlike(term_pattern(t, lang)), F.lit(t)) for t, lang in terms]
    return F.array_compact(F.array(*found))
