"""Kaplan-Meier curves and Cox regression, both unweighted."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.model import (
    Fit,
    Layout,
    Term,
    collected_vector,
    complete_rows,
    independent_columns,
    model_frame,
    solve_scaled,
    summed_vectors,
    symmetric,
    vector_rows,
)
from panelweave.operators.running import RANGE, in_ranges, running_sums
from panelweave.session import checkpointed, staged

OVERALL = "all"
Z_95 = 1.959963984540054
MAX_ITERATIONS = 20
MAX_HALVINGS = 10
LIKELIHOOD_TOLERANCE = 1e-9
# Of the events tied at a time the last ones, where the summands bend most, are summed one by one.
DIRECT_TIES = 64
# Sums over later times are added up within so many ranges of time, and over the ranges before. Their cuts are
# quantiles of the distinct times, found to within one part in RANGE_ACCURACY.
TIME_RANGES = 256
RANGE_ACCURACY = 1 << 14
# Values a task adds up before it hands them on.
HELD_VALUES = 4_000_000


def km_curve(
    table: DataFrame,
    time: str = "time",
    status: str = "status",
    stratum: Column | None = None,
    populations: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Survival curve per population and stratum, with Greenwood errors and the log-scale 95% interval.

    All populations come from one aggregate by (stratum, time); the running sums only see that table, in ranges of
    time that hold about as many rows each, so times may be as many as there are people.
    A person without a stratum value is left out.
    """
    populations = populations or {OVERALL: F.lit(True)}
    stratum = F.lit(OVERALL) if stratum is None else stratum.cast("string")
    counts = []
    for i, condition in enumerate(populations.values()):
        inside = F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(inside & (F.col(status) == 1)).alias(f"event_{i}"))
        counts.append(F.count_if(inside & (F.col(status) == 0)).alias(f"censor_{i}"))
    per_time = table.groupBy(stratum.alias("stratum"), F.col(time).alias("time")).agg(*counts)
    per_time = in_ranges(per_time.where(F.col("stratum").isNotNull()), ["stratum"], "time")
    everyone = {f"risk_{i}": F.col(f"event_{i}") + F.col(f"censor_{i}") for i in range(len(populations))}
    at_risk = running_sums(per_time, ["stratum"], "time", everyone, descending=True)
    per_population = F.array(
        *[
            F.struct(
                F.lit(name).alias("population"),
                F.col(f"risk_{i}").alias("n_risk"),
                F.col(f"event_{i}").alias("n_event"),
                F.col(f"censor_{i}").alias("n_censor"),
            )
            for i, name in enumerate(populations)
        ]
    )
    rows = at_risk.select("stratum", "time", RANGE, F.inline(per_population)).where(F.col("n_event") + F.col("n_censor") > 0)
    died, risk = F.col("n_event"), F.col("n_risk")
    survivors = died < risk
    # A product of (1 - d/n) by logarithms, with the step to zero handled apart: it has no logarithm.
    steps = {
        "__log": F.when(survivors, F.log1p(-died / risk)),
        "__hazard": F.when(survivors, died / (risk * (risk - died))),
        "__ended": F.when(survivors, 0).otherwise(1),
    }
    ended = F.col("__ended") > 0
    curve = running_sums(rows, ["population", "stratum"], "time", steps).select(
        "population",
        "stratum",
        "time",
        "n_risk",
        "n_event",
        "n_censor",
        F.when(ended, 0.0).otherwise(F.exp("__log")).alias("surv"),
        F.when(~ended, F.sqrt("__hazard")).alias("__log_error"),
    )
    margin = F.exp(F.col("__log_error") * Z_95)
    return curve.withColumns(
        {
            "std_error": F.col("surv") * F.col("__log_error"),
            "lower": F.col("surv") / margin,
            "upper": F.least(F.col("surv") * margin, F.when(F.col("__log_error").isNotNull(), 1.0)),
        }
    ).drop("__log_error")


def fit_cox(
    table: DataFrame,
    terms: Sequence[Term],
    time: str = "time",
    status: str = "status",
    domain: Column | None = None,
    plain_scan: bool = False,
) -> Fit:
    """Proportional hazards with Efron's handling of ties, by Newton's method.

    Each pass adds up risk sums by time, then over later times, and reduces them to the score and the
    information on the executors: times and ties may be as many as there are people.
    """
    layout = Layout(terms, intercept=False)
    columns = [F.col(time).cast("double").alias("time"), F.col(status).cast("double").alias("status")]
    with staged(model_frame(table, layout, columns, domain), plain_scan) as rows:
        frame = complete_rows(rows)
        width = layout.width
        center, beta, step = np.zeros(width), np.zeros(width), np.zeros(width)
        n, counts, center = _column_sums(frame, layout)
        cuts = time_cuts(frame)
        likelihood, score, information = _efron_sums(frame, layout, beta, center, cuts)
        kept = layout.kept(counts)
        columns = independent_columns(information, kept)
        converged = False
        for _ in range(MAX_ITERATIONS):
            try:
                step[columns] = solve_scaled(information[np.ix_(columns, columns)], score[columns])
            except np.linalg.LinAlgError:
                break
            previous = likelihood
            for _ in range(MAX_HALVINGS):
                tried = _efron_sums(frame, layout, beta + step, center, cuts)
                if math.isfinite(tried[0]) and tried[0] >= previous - 1e-9 * abs(previous):
                    break
                step = step / 2.0
            else:
                # No step of this direction helps: the accepted coefficients stay.
                break
            likelihood, score, information = tried
            beta = beta + step
            if abs(likelihood - previous) <= LIKELIHOOD_TOLERANCE * abs(likelihood):
                converged = True
                break
        names = tuple(layout.names[k] for k in kept)
        coefficients = dict.fromkeys(names)
        coefficients.update({layout.names[k]: float(beta[k]) for k in columns})
        covariance = solve_scaled(information[np.ix_(columns, columns)])
        return Fit(layout, names, coefficients, covariance, None, converged, n)


def _column_sums(frame: DataFrame, layout: Layout) -> tuple[int, np.ndarray, np.ndarray]:
    """People, rows where each column is not zero, and the mean of each column."""
    build, width = layout.matrix_builder(), layout.width

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * width + 1)
        for batch in batches:
            x = build(batch)
            total += np.concatenate([x.sum(axis=0), (x != 0).sum(axis=0), [len(x)]])
        yield vector_rows(total)

    total = collected_vector(frame.select(*layout.column_names()), partials, 2 * width + 1)
    n = int(total[-1])
    return n, total[width : 2 * width], total[:width] / max(n, 1)


def time_cuts(frame: DataFrame, ranges: int = TIME_RANGES) -> np.ndarray:
    """At most `ranges` - 1 times that cut the distinct times into ranges of about equally many."""
    quantiles = [i / ranges for i in range(1, ranges)]
    found = frame.select("time").distinct().agg(F.percentile_approx("time", quantiles, RANGE_ACCURACY)).first()[0]
    return np.unique(np.asarray(found or [], float))


def _risk_sums(frame: DataFrame, layout: Layout, beta: np.ndarray, center: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """(part, time, pos, value): the sums of one time, by position, and the range the time is in.

    The positions are those of exp(x b), times x and times x x' over everyone, the same over the events only,
    x over the events, and the number of events.
    """
    build, width = layout.matrix_builder(), layout.width
    upper = np.triu_indices(width)
    size = _positions(width)

    def moments(x: np.ndarray, risk: np.ndarray) -> list[np.ndarray]:
        weighted = x * risk[:, None]
        return [np.array([risk.sum()]), weighted.sum(axis=0), (x.T @ weighted)[upper]]

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[float, np.ndarray] = {}
        for batch in batches:
            x, event = build(batch), batch["status"].to_numpy(float) == 1.0
            risk = np.exp((x - center) @ beta)
            times = batch["time"].to_numpy(float)
            order = np.argsort(times, kind="stable")
            starts = np.flatnonzero(np.diff(times[order], prepend=np.nan) != 0)
            for here in np.split(order, starts[1:]):
                died = here[event[here]]
                values = [*moments(x[here], risk[here]), *moments(x[died], risk[died]), x[died].sum(axis=0), [len(died)]]
                t = float(times[here[0]])
                totals[t] = totals.get(t, 0.0) + np.concatenate(values)
            if len(totals) * size > HELD_VALUES:
                yield _long(totals, size, cuts)
                totals = {}
        if totals:
            yield _long(totals, size, cuts)

    names = ["time", "status", *layout.column_names()]
    return summed_vectors(frame.select(*names), partials, "part int, time double")


def _positions(width: int) -> int:
    return 2 * (1 + width + width * (width + 1) // 2) + width + 1


def _long(totals: Mapping[float, np.ndarray], size: int, cuts: np.ndarray) -> pd.DataFrame:
    times = np.fromiter(totals, float)
    return pd.DataFrame(
        {
            "part": np.repeat(np.searchsorted(cuts, times, "left").astype("int32"), size),
            "time": np.repeat(times, size),
            "pos": np.tile(np.arange(size, dtype="int32"), len(totals)),
            "value": np.concatenate(list(totals.values())),
        }
    )


def _efron_sums(
    frame: DataFrame, layout: Layout, beta: np.ndarray, center: np.ndarray, cuts: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score and information: one small vector from each time with events, added up.

    Sums over later times are prefix sums in two levels, over ranges of time and within each range.
    """
    width = layout.width
    cells = width * (width + 1) // 2
    risk = 1 + width + cells
    ranged = checkpointed(_risk_sums(frame, layout, beta, center, cuts))
    later = Window.partitionBy("pos").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.where(F.col("pos") < risk).groupBy("part", "pos").agg(F.sum("value").alias("value"))
    parts = parts.select("part", "pos", F.coalesce(F.sum("value").over(later), F.lit(0.0)).alias("after"))
    within = Window.partitionBy("part", "pos").orderBy(F.col("time").desc())
    standing = ranged.where(F.col("pos") < risk).withColumn("value", F.sum("value").over(within)).join(parts, ["part", "pos"])
    standing = standing.select("time", "pos", (F.col("value") + F.col("after")).alias("value"))
    events = ranged.where(F.col("pos") >= risk).select("time", "pos", "value")
    # One time has as many values as there are positions, which the number of terms fixes.
    per_time = standing.unionByName(events).groupBy("time").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("sums"))
    per_time = per_time.select(F.col("sums.value").alias("sums")).where(F.element_at("sums", -1) > 0)
    size = 1 + width + cells
    upper = np.triu_indices(width)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for values in batch["sums"]:
                likelihood, score, information = _efron(np.asarray(values, float), beta, center)
                total += np.concatenate([[likelihood], score, information[upper]])
        yield vector_rows(total)

    total = collected_vector(per_time, partials, size)
    return float(total[0]), total[1 : 1 + width], symmetric(total[1 + width :], width)


def _efron(values: np.ndarray, beta: np.ndarray, center: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The part of one time.

    With d tied events the k-th of them (k = 0 .. d-1) faces the risk S0 - (k / d) D0. Writing that as
    (D0 / d) (a - k) with a = d S0 / D0 turns the sums over k into sums of 1 / (a - k).
    """
    width = len(beta)
    cells = width * (width + 1) // 2
    s0, s1, s2, d0, d1, d2, dx, d = np.split(values, np.cumsum([1, width, cells, 1, width, cells, width]))
    s0, d0, d = float(s0[0]), float(d0[0]), float(d[0])
    s2, d2 = symmetric(s2, width), symmetric(d2, width)
    log_sum, first, second = _tied_sums(d * max(s0 / d0, 1.0), int(round(d)))
    first, second = first * d / d0, second * (d / d0) ** 2
    apart = s1 - (s0 / d0) * d1
    apart2 = s2 - (s0 / d0) * d2
    mean = d1 / d0
    likelihood = float((dx - d * center) @ beta) - (d * math.log(d0 / d) + log_sum)
    score = dx - (apart * first + d * mean)
    squares = second * np.outer(apart, apart) + first * (np.outer(apart, mean) + np.outer(mean, apart)) + d * np.outer(mean, mean)
    return likelihood, score, apart2 * first + d * (d2 / d0) - squares


def _tied_sums(a: float, d: int) -> tuple[float, float, float]:
    """Sums over k < d of log(a - k), 1 / (a - k) and 1 / (a - k)^2.

    The last DIRECT_TIES terms one by one, those before by the Euler-Maclaurin formula.
    """
    tail = a - np.arange(max(d - DIRECT_TIES, 0), d)
    logs, ones, squares = float(np.log(tail).sum()), float((1.0 / tail).sum()), float((1.0 / tail**2).sum())
    if d > DIRECT_TIES:
        low, high = float(tail[0]) + 1.0, a
        logs += (high * math.log(high) - high) - (low * math.log(low) - low) + 0.5 * (math.log(low) + math.log(high))
        logs += (1.0 / high - 1.0 / low) / 12.0 - (high**-3 - low**-3) / 360.0
        ones += math.log1p((high - low) / low) + 0.5 * (1.0 / low + 1.0 / high)
        ones += (low**-2 - high**-2) / 12.0 - (low**-4 - high**-4) / 120.0
        squares += (high - low) / (high * low) + 0.5 * (low**-2 + high**-2)
        squares += (low**-3 - high**-3) / 6.0 - (low**-5 - high**-5) / 30.0
    return logs, ones, squares
