"""The detector's forward pass and verdict columns as column expressions.

The network is small and fixed, so its four layers are written out as arithmetic
over columns: scoring stays in generated code and no row visits Python.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from accesslens.models.bundle import Bundle


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def layer(inputs: list[str], weights: list[list[float]], bias: list[float], rectify: bool) -> list[str]:
    """SQL of one dense layer over the named columns, one expression per unit."""
    units = []
    for row, b in zip(weights, bias):
        total = " + ".join([_number(b)] + [f"{_number(w)} * {x}" for w, x in zip(row, inputs)])
        units.append(f"greatest({total}, 0D)" if rectify else total)
    return units


def standardized(sql: str, mean: float, std: float) -> str:
    return f"({sql} - {_number(mean)}) / {_number(std)}"


def mean_of(parts: list[str]) -> str:
    return f"({' + '.join(parts)}) / {_number(len(parts))}"


def ranked_errors(errors: list[str], names: list[str], k: int) -> str:
    """SQL of the ``k`` largest squared errors; of equal ones the later feature comes first."""
    entries = ", ".join(f"named_struct('error', {e}, 'position', {i}, 'feature', '{n}')"
                        for i, (e, n) in enumerate(zip(errors, names)))
    return f"slice(sort_array(array({entries}), false), 1, {k})"


def contributions(ranked: str, k: int) -> str:
    """``ranked`` with each contribution rounded for the report, as SQL."""
    return "array(" + ", ".join(
        f"named_struct('feature', get({ranked}, {i}).feature, 'contribution', round(get({ranked}, {i}).error, 4))"
        for i in range(k)) + ")"


def reconstruct_udf(spark: SparkSession, bundle: Bundle):
    """The same forward pass as a vectorized UDF, kept as an independent second scorer."""
    layers = [(np.asarray(w), np.asarray(b)) for w, b in zip(bundle.weights, bundle.biases)]
    shared = spark.sparkContext.broadcast((np.asarray(bundle.mean), np.asarray(bundle.std), layers))

    @F.pandas_udf("array<double>")
    def reconstruct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mean, std, layers = shared.value
        for batch in batches:
            h = (np.stack(batch.to_numpy()) - mean) / std if len(batch) else np.empty((0, len(mean)))
            for i, (w, b) in enumerate(layers):
                h = h @ w.T + b
                if i < len(layers) - 1:
                    h = np.maximum(h, 0.0)
            yield pd.Series(list(h))
    return reconstruct
