"""Model terms, the numeric frame handed to the fits, and the small algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.scalars import number_of

INTERCEPT = "(Intercept)"
COEFFICIENT_SCHEMA = (
    "model string, term string, estimate double, std_error double, statistic double, p_value double, converged boolean"
)
# A pivot that shrinks below this share of its size marks a term the earlier terms already explain.
ALIAS_TOLERANCE = 1e-9


@dataclass(frozen=True)
class Factor:
    """A categorical term with its ordered levels; the first level seen in the data is the base.

    A value outside the levels counts as missing.
    """

    name: str
    value: Column
    levels: Sequence[str]


@dataclass(frozen=True)
class Number:
    name: str
    value: Column


Term = Factor | Number


class Layout:
    """Positions of all columns of a model matrix: the intercept, every level, every number.

    Executors always build every level. Which of them is the base or unused is only settled on the
    driver, after the first pass has counted them, so no extra pass looks for levels.
    """

    def __init__(self, terms: Sequence[Term], intercept: bool = True):
        self.terms = list(terms)
        self.intercept = intercept
        self.names: list[str] = [INTERCEPT] if intercept else []
        self.starts: list[int] = []
        for term in self.terms:
            self.starts.append(len(self.names))
            if isinstance(term, Factor):
                self.names += [f"{term.name}{level}" for level in term.levels]
            else:
                self.names.append(term.name)

    @property
    def width(self) -> int:
        return len(self.names)

    def columns(self) -> list[Column]:
        """One numeric column per term: the level's position for a factor, the value for a number."""
        out = []
        for i, term in enumerate(self.terms):
            if isinstance(term, Factor):
                positions = {level: k for k, level in enumerate(term.levels)}
                out.append(number_of(term.value, positions).alias(f"t{i}"))
            else:
                out.append(term.value.cast("double").alias(f"t{i}"))
        return out

    def column_names(self) -> list[str]:
        return [f"t{i}" for i in range(len(self.terms))]

    def matrix_builder(self):
        """A small picklable function from a pandas batch to its matrix block."""
        plan = [(f"t{i}", s, isinstance(t, Factor)) for i, (t, s) in enumerate(zip(self.terms, self.starts, strict=True))]
        width, intercept = self.width, self.intercept

        def build(batch: pd.DataFrame) -> np.ndarray:
            block = np.zeros((len(batch), width))
            if intercept:
                block[:, 0] = 1.0
            rows = np.arange(len(batch))
            for name, start, is_factor in plan:
                values = batch[name].to_numpy(dtype=float)
                if is_factor:
                    block[rows, start + values.astype(int)] = 1.0
                else:
                    block[:, start] = values
            return block

        return build

    def kept(self, counts: np.ndarray) -> list[int]:
        """Columns that enter the model: no base level and no level without rows."""
        keep = [0] if self.intercept else []
        for term, start in zip(self.terms, self.starts, strict=True):
            if isinstance(term, Factor):
                used = [start + k for k in range(len(term.levels)) if counts[start + k] > 0]
                keep += used[1:]
            else:
                keep.append(start)
        return keep

    def predictor(self, coefficients: dict[str, float]) -> Column:
        """The linear predictor as a column: coefficients are matched by name, absent ones add nothing.

        NULL wherever a term is missing, as a row with a missing term has no prediction.
        """
        out = F.lit(float(coefficients.get(INTERCEPT) or 0.0))
        for term in self.terms:
            if isinstance(term, Factor):
                weights = {level: coefficients.get(f"{term.name}{level}") or 0.0 for level in term.levels}
                out = out + number_of(term.value, weights)
            else:
                out = out + term.value.cast("double") * F.lit(float(coefficients.get(term.name) or 0.0))
        return out


def model_frame(data: DataFrame, layout: Layout, columns: Sequence[Column], domain: Column | None = None) -> DataFrame:
    """The numeric columns of the domain's rows, ready for the fits."""
    rows = data if domain is None else data.where(domain)
    return rows.select(*columns, *layout.columns())


def complete_rows(frame: DataFrame) -> DataFrame:
    """Rows without a missing value.

    Applied to the staged frame: as a filter above computed terms it would compute each of them twice.
    """
    return frame.where(reduce(and_, [F.col(c).isNotNull() for c in frame.columns]))


def summed_vectors(frame: DataFrame, partials, keys: str = "") -> DataFrame:
    """Add up the vectors that `partials` yields on the executors.

    Each task folds its batches into one vector, and the vectors are added by position in a shuffle,
    so the driver only receives the final numbers. `keys` declares leading key columns.
    """
    key_names = [k.split()[0] for k in keys.split(",")] if keys else []
    schema = f"{keys + ', ' if keys else ''}pos int, value double"
    return frame.mapInPandas(partials, schema).groupBy(*key_names, "pos").agg(F.sum("value").alias("value"))


def collected_vector(frame: DataFrame, partials, size: int) -> np.ndarray:
    out = np.zeros(size)
    found = summed_vectors(frame, partials).toArrow()
    out[found["pos"].to_numpy()] = found["value"].to_numpy()
    return out


def vector_rows(vector: np.ndarray) -> pd.DataFrame:
    (positions,) = np.nonzero(vector)
    return cell_rows(positions, vector[positions])


def cell_rows(positions: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"pos": positions.astype("int32"), "value": values})


def symmetric(upper: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = upper
    return out + np.triu(out, 1).T


def independent_columns(gram: np.ndarray, columns: Sequence[int]) -> list[int]:
    """Columns not explained by earlier ones, found by sweeping the cross-product matrix in order.

    Where nothing is explained, the triangular factor shows it at once: the squares of its diagonal are the sweep's pivots.
    """
    columns = list(columns)
    scale = np.sqrt(np.maximum(np.diag(gram)[columns], 0.0))
    scale[scale == 0] = 1.0
    work = gram[np.ix_(columns, columns)] / np.outer(scale, scale)
    try:
        if np.all(np.diag(np.linalg.cholesky(work)) ** 2 > ALIAS_TOLERANCE):
            return columns
    except np.linalg.LinAlgError:
        pass
    keep = []
    for i in range(len(columns)):
        if work[i, i] > ALIAS_TOLERANCE:
            keep.append(columns[i])
            work[i + 1 :, i + 1 :] -= np.outer(work[i + 1 :, i], work[i, i + 1 :] / work[i, i])
    return keep


def solve_scaled(matrix: np.ndarray, vector: np.ndarray | None = None) -> np.ndarray:
    """Solve a symmetric system after scaling it to a unit diagonal; without a vector, invert it."""
    scale = 1.0 / np.sqrt(np.diag(matrix))
    scaled = matrix * np.outer(scale, scale)
    if vector is None:
        return np.linalg.inv(scaled) * np.outer(scale, scale)
    return scale * np.linalg.solve(scaled, scale * vector)


@dataclass(frozen=True)
class Fit:
    """A fitted model: named coefficients (None for aliased terms) and their covariance."""

    layout: Layout
    terms: tuple[str, ...]
    coefficients: dict[str, float | None]
    covariance: np.ndarray  # in the order of the terms that have a coefficient
    df: float | None  # degrees of freedom of the t distribution; None for the normal
    converged: bool
    n: int

    def predictor(self) -> Column:
        return self.layout.predictor({k: v for k, v in self.coefficients.items() if v is not None})

    def table(self, spark: SparkSession, model: str) -> DataFrame:
        """The coefficient table, one row per term."""
        estimated = [t for t in self.terms if self.coefficients[t] is not None]
        errors = dict(zip(estimated, np.sqrt(np.maximum(np.diag(self.covariance), 0.0)), strict=True))
        rows = []
        for term in self.terms:
            b = self.coefficients[term]
            if b is None:
                rows.append((model, term, None, None, None, None, self.converged))
                continue
            se = float(errors[term])
            statistic = b / se if se > 0 else None
            p = None if statistic is None else two_sided_p(statistic, self.df)
            rows.append((model, term, float(b), se, statistic, p, self.converged))
        return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def two_sided_p(statistic: float, df: float | None) -> float | None:
    if df is None:
        return math.erfc(abs(statistic) / math.sqrt(2.0))
    if df <= 0:
        return None
    return incomplete_beta(df / 2.0, 0.5, df / (df + statistic * statistic))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    top, bottom = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    value = bottom
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            bottom = 1.0 / (1.0 + term * bottom)
            top = 1.0 + term / top
            value *= top * bottom
        if abs(top * bottom - 1.0) < 1e-15:
            break
    return front * value
