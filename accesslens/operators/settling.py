"""Keep a costly column from being computed more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    """Select ``keep`` and the costly column ``name`` so that later filters do not repeat it.

    Catalyst pushes a filter on a projected column below the projection and writes
    the whole expression into the condition, once per use.  Stacked projections
    multiply that: a filter on a score would hold the network hundreds of
    thousands of times.  A filter on the output of a generator stays above it.
    """
    return df.select(*keep, F.explode(F.array(name)).alias(name))
