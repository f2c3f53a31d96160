"""The support threshold."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame


def min_support_count(total: int, min_supp: float) -> int:
    """ceil(total x min_supp) in double arithmetic, so 100 x 0.07 gives 8."""
    if not 0 < min_supp <= 1:
        raise ValueError(f"min-supp must be over 0 and at most 1, not {min_supp}")
    return math.ceil(float(total) * float(min_supp))


@dataclass(frozen=True)
class Counts:
    total: int
    min_count: int


def counts(transactions: DataFrame, min_supp: float) -> Counts:
    """Empty transactions count too."""
    total = transactions.count()
    return Counts(total, min_support_count(total, min_supp))
