"""Sample designs: weights, strata, clusters, post-strata, replicate weights, and their variances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.skew import lookup_join
from panelweave.session import checkpointed

LONELY_POLICIES = ("fail", "remove")


@dataclass(frozen=True)
class SurveyDesign:
    """Rows with the names of their design columns.

    A domain is a boolean column used inside the sums. Never filter the rows of a design before a
    variance: clusters without domain rows still count.
    `by` names columns that separate independent surveys, such as the year.
    `lonely_psu` says what a stratum with one cluster does: "fail" raises, "remove" adds no variance.
    `bootstrap` is the number of bootstrap replicates, drawn by `seed`.
    """

    data: DataFrame
    weight: str
    strata: str
    psu: str
    poststratum: str | None = None
    replicates: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    lonely_psu: str = "fail"
    bootstrap: int = 0
    seed: int = 0

    def __post_init__(self):
        if self.lonely_psu not in LONELY_POLICIES:
            raise ValueError(f"lonely_psu must be one of {LONELY_POLICIES}")

    def with_data(self, data: DataFrame) -> SurveyDesign:
        return replace(self, data=data)

    def with_columns(self, columns: Mapping[str, Column]) -> SurveyDesign:
        return self.with_data(self.data.withColumns(dict(columns)))

    @property
    def cluster_keys(self) -> list[str]:
        return [*self.by, self.strata, self.psu]

    @property
    def cluster_columns(self) -> list[str]:
        return [self.strata, self.psu] + ([self.poststratum] if self.poststratum else [])

    def stratum_factors(self, clusters: DataFrame) -> DataFrame:
        """(by, strata, n_psu, factor) from the clusters of the whole design, where factor is n / (n - 1)."""
        places = clusters.select(*self.cluster_keys).distinct()
        counts = places.groupBy(*self.by, self.strata).agg(F.count(F.lit(1)).alias("n_psu"))
        if self.lonely_psu == "fail":
            text = F.concat(F.lit("stratum with one cluster: "), F.col(self.strata).cast("string"))
            lonely = F.raise_error(text).cast("double")
        else:
            lonely = F.lit(0.0)
        ratio = F.col("n_psu") / F.greatest(F.col("n_psu") - 1, F.lit(1))
        return counts.withColumn("factor", F.when(F.col("n_psu") == 1, lonely).otherwise(ratio))


def poststratify(design: SurveyDesign, group: str, totals: Mapping | str, adjusted: str = "weight_adj") -> SurveyDesign:
    """Scale the weights so that each post-stratum sums to its known total.

    `totals` maps each group to its total, or names a column that carries the total on every row. A group
    without one known total is refused in either form, as is one whose weights don't add up to anything.
    """
    keys = [*design.by, group]
    text = F.coalesce(F.col(group).cast("string"), F.lit("NULL"))
    if isinstance(totals, str):
        sums = design.data.groupBy(*keys).agg(
            F.sum(design.weight).alias("__weight"),
            F.min(totals).cast("double").alias("__total"),
            F.max(totals).cast("double").alias("__most"),
            F.count_if(F.col(totals).isNull()).alias("__unknown"),
        )
        known = (F.col("__unknown") == 0) & (F.col("__total") == F.col("__most")) & F.col(group).isNotNull()
        refused = F.raise_error(F.concat(F.lit("post-stratum without one known total: "), text)).cast("double")
        sums = sums.withColumn("__total", F.when(known, F.col("__total")).otherwise(refused))
    else:
        known = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))])
        sums = design.data.groupBy(*keys).agg(F.sum(design.weight).alias("__weight"))
        unknown = F.raise_error(F.concat(F.lit("post-stratum without a known total: "), text))
        sums = sums.withColumn("__total", F.coalesce(known[F.col(group)], unknown.cast("double")))
    weightless = F.raise_error(F.concat(F.lit("post-stratum without weight: "), text)).cast("double")
    factors = sums.select(
        *keys, F.when(F.col("__weight") > 0, F.col("__total") / F.col("__weight")).otherwise(weightless).alias("__factor")
    )
    # One row per post-stratum, written once, so that the rows are not summed twice.
    joined = lookup_join(design.data, checkpointed(factors), keys)
    data = joined.withColumn(adjusted, F.col(design.weight) * F.col("__factor")).drop("__factor")
    return replace(design, data=data, weight=adjusted, poststratum=group)


@dataclass(frozen=True)
class PoststratumProducts:
    """What all post-stratified estimates of a design share, from the weights of its (cluster, post-stratum) pairs.

    With w the weights by cluster and post-stratum, n the clusters of a stratum and f its factor n / (n - 1), the
    covariance of two cluster totals a and b is the sum over strata of f (sum of a b - (sum of a) (sum of b) / n).
    `pairs` (by, group, other, product) has it for the weights of every two post-strata: one small matrix per period,
    whatever the number of clusters. `scaled` and `strata` are what `covariances` needs to pair other totals with them.
    """

    keys: tuple[str, ...]
    strata_keys: tuple[str, ...]
    group: str
    sizes: DataFrame
    pairs: DataFrame
    scaled: DataFrame
    strata: DataFrame

    def covariances(self, totals: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
        """(keys, group, covariance) of the cluster totals `column` with the weights of each post-stratum.

        A cluster's total meets only the post-strata of that cluster; the mean terms come by stratum.
        """
        met = totals.join(self.scaled, list(self.keys)).select(*keys, self.group, (F.col(column) * F.col("__fw")).alias("covariance"))
        sums = totals.groupBy(*dict.fromkeys([*keys, *self.strata_keys])).agg(F.sum(column).alias("__sum"))
        means = sums.join(self.strata, list(self.strata_keys)).select(*keys, self.group, (-F.col("__sum") * F.col("__fw")).alias("covariance"))
        added = [frame.groupBy(*keys, self.group).agg(F.sum("covariance").alias("covariance")) for frame in (met, means)]
        return added[0].unionByName(added[1])


def poststratum_products(design: SurveyDesign, clusters: DataFrame, factors: DataFrame) -> PoststratumProducts:
    """The shared products of a post-stratified design; `clusters` has the weight `w` of every (cluster, post-stratum)."""
    by, group, other = list(design.by), design.poststratum, "__other"
    places = [*by, design.strata]
    strata = clusters.groupBy(*places, group).agg(F.sum("w").alias("w")).join(factors, places)
    strata = strata.withColumn("__fw", F.col("w") * F.col("factor") / F.col("n_psu"))
    scaled = clusters.join(factors.select(*places, "factor"), places)
    scaled = scaled.select(*design.cluster_keys, group, "w", (F.col("w") * F.col("factor")).alias("__fw"))

    def paired(rows: DataFrame, keys: list[str], sign: float) -> DataFrame:
        mirror = rows.select(*keys, F.col(group).alias(other), F.col("__fw").alias("__other_fw"))
        met = rows.select(*keys, group, "w").join(mirror, keys)
        return met.groupBy(*by, group, other).agg((F.sum(F.col("w") * F.col("__other_fw")) * sign).alias("product"))

    both = paired(scaled, design.cluster_keys, 1.0).unionByName(paired(strata, places, -1.0))
    return PoststratumProducts(
        keys=tuple(design.cluster_keys),
        strata_keys=tuple(places),
        group=group,
        sizes=clusters.groupBy(*by, group).agg(F.sum("w").alias("__n")),
        pairs=both.groupBy(*by, group, other).agg(F.sum("product").alias("product")),
        scaled=scaled.select(*design.cluster_keys, group, "__fw"),
        strata=strata.select(*places, group, "__fw"),
    )
