"""Residual-draw imputation and the two-step selection model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.scalars import inverse_mills, text_key
from panelweave.operators.design import SurveyDesign
from panelweave.operators.glm import fit_linear, fit_probit
from panelweave.operators.model import Fit, Number, Term
from panelweave.session import checkpointed

# Donors are numbered bucket by bucket, a bucket being this many leading hex digits of the donor's hash.
BUCKET_DIGITS = 4
# A donor row that occurs very often is numbered in pieces of this many, spread over tasks.
PIECE = 6_400_000
# Numbers that targets and donors meet by; a piece takes part in every block it reaches into.
BLOCK = 64
# Leading hex digits of a hash that make a uniform number: 52 bits, which a double holds exactly.
UNIFORM_DIGITS = 13
MILLS = "mills"


def draw_residuals(
    targets: DataFrame,
    target_keys: Sequence[str],
    donors: DataFrame,
    donor_keys: Sequence[str],
    value: str,
    seed: int,
    drawn: str = "drawn_residual",
) -> DataFrame:
    """Give every target row one donor value, drawn with replacement.

    The draw is a hash of the target's keys and the seed; donors are numbered in the order of a hash of
    theirs. So the result depends only on the data: not on partitions, task order or a lost executor.
    Keys must tell rows apart: targets with equal keys draw the same donor.
    """
    blocks, size = _numbered(donors, donor_keys, value)
    hashed = F.md5(text_key(*target_keys, F.lit(seed), sep="|"))
    uniform = F.conv(F.substring(hashed, 1, UNIFORM_DIGITS), 16, 10).cast("long") / F.lit(float(16**UNIFORM_DIGITS))
    position = F.least(F.floor(uniform * size), size - 1).cast("long")
    placed = targets.withColumn("__position", position)
    same_block = F.floor(F.col("__position") / BLOCK) == F.col("__block")
    inside = F.col("__position").between(F.col("__first"), F.col("__last"))
    picked = placed.join(blocks.withColumnRenamed(value, drawn), same_block & inside, "left")
    return picked.drop("__position", "__block", "__first", "__last")


def _numbered(donors: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, Column]:
    """Donor values with the first and last of their numbers 0 .. n-1, in the order of their hash, and n as a scalar.

    Copies of a donor share one row per block of numbers, so a row repeated without bound neither fills a
    bucket nor a task, and a block holds at most BLOCK rows for a target to look through.
    """
    known = donors.where(F.col(value).isNotNull()).select(F.md5(text_key(*keys, sep="|")).alias("__hash"), value)
    distinct = known.groupBy("__hash", value).agg(F.count(F.lit(1)).alias("__copies"))
    # Written once: the bucket totals, the numbering and the size all read the narrow table, not the donors' rows.
    distinct = checkpointed(distinct.withColumn("__bucket", F.substring("__hash", 1, BUCKET_DIGITS)))
    totals = distinct.groupBy("__bucket").agg(F.sum("__copies").alias("__total"))
    # At most 16^BUCKET_DIGITS rows: small enough for one running sum and for a broadcast.
    before = F.sum("__total").over(Window.orderBy("__bucket")) - F.col("__total")
    offsets = F.broadcast(totals.select("__bucket", before.alias("__offset")))
    in_bucket = Window.partitionBy("__bucket").orderBy("__hash", value).rowsBetween(Window.unboundedPreceding, -1)
    starts = distinct.join(offsets, "__bucket").withColumn(
        "__start", F.col("__offset") + F.coalesce(F.sum("__copies").over(in_bucket), F.lit(0))
    )
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / PIECE)))
    pieces = (
        starts.withColumn("__piece", piece)
        .withColumn("__first", F.col("__start") + F.col("__piece") * PIECE)
        .withColumn("__last", F.least(F.col("__start") + F.col("__copies"), F.col("__first") + PIECE) - 1)
        .select(value, "__first", "__last")
        .repartition("__first")
    )
    block = F.explode(F.sequence(F.floor(F.col("__first") / BLOCK), F.floor(F.col("__last") / BLOCK)))
    # Dealt out after the rows have multiplied, so that adaptive execution measures what it may broadcast.
    blocks = pieces.select(value, "__first", "__last", block.alias("__block")).repartition("__block")
    return blocks, totals.agg(F.sum("__total")).scalar()


def impute_outcome(
    targets: DataFrame,
    target_keys: Sequence[str],
    fit: Fit,
    donors: DataFrame,
    donor_keys: Sequence[str],
    residual: str,
    seed: int,
    outcome: str,
) -> DataFrame:
    """Predicted outcome plus a drawn residual; coefficients meet their terms by name."""
    drawn = draw_residuals(targets, target_keys, donors, donor_keys, residual, seed)
    return drawn.withColumn(outcome, fit.predictor() + F.col("drawn_residual"))


@dataclass(frozen=True)
class TwoStep:
    selection: Fit
    outcome: Fit


def with_mills(rows: DataFrame, selection: Fit, name: str = MILLS) -> DataFrame:
    """Add the inverse Mills ratio of a fitted probit; NULL where a covariate is missing.

    The predictor gets a column of its own: the ratio uses it in many places.
    """
    predicted = rows.withColumn("__predictor", selection.predictor())
    return predicted.withColumn(name, inverse_mills("__predictor")).drop("__predictor")


def heckman_two_step(
    design: SurveyDesign,
    selected: Column,
    selection_terms: Sequence[Term],
    outcome: Column,
    outcome_terms: Sequence[Term],
    domain: Column | None = None,
    plain_scan: bool = False,
) -> TwoStep:
    """Probit of selection, then the outcome on the selected rows with the Mills ratio as a term.

    The second stage's standard errors are not corrected for the first, as in the published analysis.
    """
    probit = fit_probit(design, selected, selection_terms, domain, plain_scan)
    with_ratio = design.with_data(with_mills(design.data, probit))
    chosen = selected.cast("double") == 1.0
    inside = chosen if domain is None else domain & chosen
    linear = fit_linear(with_ratio, outcome, [*outcome_terms, Number(MILLS, F.col(MILLS))], inside)
    return TwoStep(probit, linear)
