"""Monoids given as Python functions over whole batches, for combinations that no built-in aggregate expresses.

Prefer `operators.sequence.fold_custom`, which stays an expression; these run as Arrow Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(f: Callable[[pd.Series], pd.Series], kind: str) -> Callable[..., Column]:
    """A vectorised map as a column function."""
    return F.pandas_udf(f, kind)


def combined(df: DataFrame, value: str, kind: str, lift: Callable[[pd.Series], object], merge: Callable[[object, object], object], unit: object) -> DataFrame:
    """One row v: batches are lifted where they lie, and only their values meet. lift and merge must agree: lift(a + b) = merge(lift(a), lift(b))."""

    def partial(batches):
        total = unit
        for b in batches:
            total = merge(total, lift(b[value]))
        yield pd.DataFrame({"v": [total]})

    def final(batches):
        total = unit
        for b in batches:
            for v in b["v"]:
                total = merge(total, v)
        yield pd.DataFrame({"v": [total]})

    return df.select(value).mapInPandas(partial, f"v {kind}").coalesce(1).mapInPandas(final, f"v {kind}")
