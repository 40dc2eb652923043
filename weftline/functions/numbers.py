"""Scalar expressions on numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b as double, 0 where b is 0."""
    out = F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))
    return out if digits is None else F.round(out, digits)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in percent; null where whole is 0."""
    return F.round(100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def magnitude(value: Column, steps: int = 256) -> Column:
    """A bucket number that rises with the value: `steps` buckets per doubling of 1 + |value|."""
    return (F.signum(value) * F.floor(F.log2(1 + F.abs(value)) * steps)).cast("bigint")


def p_text(p: Column) -> Column:
    """A p-value for display: four digits, in scientific notation below 0.0001; null stays null."""
    return F.when(p < 1e-4, F.format_string("%.4e", p)).when(p.isNotNull(), F.format_string("%.4f", p))


def two_sided(z: Column) -> Column:
    """The two-sided p-value of a standard normal z: erfc(|z| / sqrt 2). For aggregated rows."""

    @F.pandas_udf("double")
    def p(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or math.isnan(v) else min(1.0, math.erfc(abs(v) / math.sqrt(2))))

    return p(z)


def chi_tail(x: Column, freedom: Column) -> Column:
    """The probability that a chi-square variable of `freedom` degrees (a whole number) exceeds x. For aggregated rows."""

    @F.pandas_udf("double")
    def p(values: pd.Series, degrees: pd.Series) -> pd.Series:
        def one(v, k):
            if v is None or k is None or math.isnan(v) or math.isnan(k) or k < 1:
                return None
            h, k = max(v, 0.0) / 2, int(k)
            # the first term of the sum, then each from the one before
            term, at, total = (math.exp(-h), 1.0, 0.0) if k % 2 == 0 else (2 * math.sqrt(h / math.pi) * math.exp(-h), 1.5, math.erfc(math.sqrt(h)))
            for _ in range(k // 2):
                total += term
                term *= h / at
                at += 1
            return min(1.0, total)

        return pd.Series([one(v, k) for v, k in zip(values, degrees)], dtype="float64")

    return p(x, freedom.cast("double"))


def exact_u(u: Column, n1: Column, n2: Column) -> Column:
    """The two-sided p-value of the statistic u of two samples without ties, from its exact distribution. For aggregated rows.

    Null where n1 * n2 is more than a million.
    """

    @F.pandas_udf("double")
    def p(us: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        def one(v, a, b):
            if math.isnan(v) or math.isnan(a) or math.isnan(b) or not 0 < a * b <= 1_000_000:
                return None
            a, b = sorted((int(a), int(b)))
            low = int(min(v, a * b - v))
            ways = np.zeros(low + 1)
            ways[0] = 1
            for i in range(1, a + 1):  # orders of i among b + i, by their u
                if b + i <= low:
                    ways[b + i :] -= ways[: low + 1 - b - i].copy()
                for start in range(min(i, low + 1)):
                    ways[start::i] = np.cumsum(ways[start::i])
            return min(1.0, 2 * float(ways.sum() / math.comb(a + b, a)))

        return pd.Series([one(float(v), float(a), float(b)) for v, a, b in zip(us.astype(float), first.astype(float), second.astype(float))], dtype="float64")

    return p(u, n1, n2)
