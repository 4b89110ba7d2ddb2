"""Upper tails of test statistics, for the few rows that a test leaves."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi_square(x: float, dof: int) -> float:
    """Chance that a chi-square of `dof` degrees exceeds x: a finite sum, after exp for even and erfc for odd degrees."""
    if x <= 0:
        return 1.0
    half = x / 2
    tail, i = (math.erfc(math.sqrt(half)), 0.5) if dof % 2 else (0.0, 0.0)
    while i < dof / 2:
        tail += math.exp(i * math.log(half) - half - math.lgamma(i + 1))
        i += 1
    return min(tail, 1.0)


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Null where either is null."""
    return pd.Series([None if pd.isna(a) or pd.isna(d) else chi_square(a, int(d)) for a, d in zip(x, dof)], dtype="float64")
