"""F-08 and F-09: totals from the arithmetic between a receipt's amounts, by look-ups instead of nested passes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tax rate, how far it may be off, and how far sums may be.
RATE, SHARE, TOLERANCE = 0.07, 0.005, 0.05


def taxed_total(amounts: list[float]) -> float | None:
    """F-08: the largest amount that is the sum of another one and about its tax; ``amounts`` are distinct and sorted."""
    best = None
    if len(amounts) < 3:
        return best
    for net in amounts:
        wide = max(TOLERANCE, net * SHARE) + 1e-6
        for tax in amounts[bisect_left(amounts, net * RATE - wide) : bisect_right(amounts, net * RATE + wide)]:
            if tax >= net or abs(tax - net * RATE) > max(TOLERANCE, net * SHARE):
                continue
            total = net + tax
            for at in range(bisect_right(amounts, total + TOLERANCE + 1e-6) - 1, -1, -1):
                if amounts[at] < total - TOLERANCE - 1e-6:
                    break
                if abs(amounts[at] - total) <= TOLERANCE:
                    best = amounts[at] if best is None else max(best, amounts[at])
                    break
    return best


def spent_amount(printed: list[float]) -> float | None:
    """F-09: the first amount, in the order of print, that taken from an earlier larger one leaves a later one.

    An amount's last place is found by its cents, so each pair costs a few look-ups.
    """
    n = len(printed)
    if n < 3:
        return None
    values = np.array(printed)
    cents = np.round(values * 100).astype(np.int64)
    order = np.argsort(cents, kind="stable")
    kinds, first = np.unique(cents[order], return_index=True)
    last = order[np.append(first[1:], n) - 1]  # the last place of each amount
    for i in range(n - 2):
        spent = values[i + 1 : n - 1]
        rest = values[i] - spent
        goal = np.round(rest * 100).astype(np.int64)
        good = np.zeros(len(spent), bool)
        for step in range(-6, 7):
            at = np.minimum(np.searchsorted(kinds, goal + step), len(kinds) - 1)
            good |= (kinds[at] == goal + step) & (last[at] > np.arange(i + 1, n - 1)) & (np.abs(values[last[at]] - rest) <= TOLERANCE)
        hit = np.flatnonzero(good & (spent < values[i]))
        if len(hit):
            return float(spent[hit[0]])
    return None


@F.pandas_udf(T.StructType([T.StructField("taxed", T.DoubleType()), T.StructField("spent", T.DoubleType())]))
def arithmetic(decimals: pd.Series, printed: pd.Series) -> pd.DataFrame:
    """``decimals``: distinct sorted amounts with decimals; ``printed``: those of a card slip in order, else empty."""
    return pd.DataFrame({"taxed": [None if x is None else taxed_total(list(x)) for x in decimals], "spent": [None if x is None else spent_amount(list(x)) for x in printed]}, dtype="float64")
