"""Scalar expressions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which a language is written, after trimming and lower-casing. Fixed values.
LANGUAGES = {"python": "Python", "java": "Java", "c++": "C++", "cpp": "C++"}


def canonical_language(col: Column) -> Column:
    """Python, Java or C++ for any spelling of them; null for null and for every other text."""
    key = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for name, shown in LANGUAGES.items():
        out = F.when(key == name, F.lit(shown)).otherwise(out)
    return out
