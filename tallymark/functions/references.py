"""References in narrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.config import LEAST_REFERENCE, MOST_REFERENCE, PREFIXES


def normalise(text: Column, learned: tuple[str, ...] = ()) -> Column:
    """Upper case, letters and digits only, without leading prefixes as long as enough is left."""
    known = "|".join(f"{p}(?=.{{{LEAST_REFERENCE}}})" for p in (*PREFIXES, *learned))
    return F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""), f"^(?>{known})*+", "")


def candidates(narration: Column, learned: tuple[str, ...] = ()) -> Column:
    """Distinct fields of a narration that look like a reference: of fit length, with a digit."""
    shape = f"^(?=.*[0-9])[A-Z0-9]{{{LEAST_REFERENCE},{MOST_REFERENCE}}}$"
    return F.array_distinct(F.filter(F.transform(F.split(narration, "[/|]"), lambda f: normalise(f, learned)), lambda f: f.rlike(shape)))


def distance(narration: Column, utr: Column) -> Column:
    """Least edit distance of a settlement's reference to those of the narration; null if either has none."""
    return F.array_min(F.transform(candidates(narration), lambda c: F.levenshtein(F.nullif(normalise(utr), F.lit("")), c)))


def fields(narration: Column) -> Column:
    return F.filter(F.transform(F.split(narration, "/"), lambda f: F.upper(F.trim(f))), lambda f: f != "")


def joined(*parts: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)
