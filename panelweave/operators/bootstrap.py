"""Rescaled bootstrap of a cluster design: which clusters each replicate draws.

A stratum of n clusters is drawn from n - 1 times with replacement, and a cluster drawn k times weighs k n / (n - 1)
times its weight. Draws are hashes of the seed, the stratum, the replicate and the draw's number, so they depend on
neither partitions nor row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.design import SurveyDesign
from panelweave.operators.running import in_ranges, running_sums
from panelweave.operators.skew import lookup_join

# Hex digits of a digest that make a draw: 52 bits, far above any number of clusters.
DIGITS = 13


def drawn_clusters(design: SurveyDesign, clusters: DataFrame) -> DataFrame:
    """(by, strata, psu, scale, drawn) for every cluster: `drawn` lists the replicates, from 1, once per draw.

    `scale` is n / (n - 1). Clusters are numbered in their stratum over ranges of the whole order, and each but the
    first stands for one draw of every replicate, so a stratum with most clusters is spread like any other. The list
    of a cluster has about as many entries as there are replicates. The only cluster of a stratum is in every replicate
    once, with "remove".
    """
    strata = [*design.by, design.strata]
    replicates = F.sequence(F.lit(1), F.lit(design.bootstrap))
    factors = design.stratum_factors(clusters)
    places = in_ranges(clusters.select(*design.cluster_keys).distinct(), strata, design.psu)
    numbered = running_sums(places, strata, design.psu, {"__number": F.lit(1)}).drop("__range")
    numbered = lookup_join(numbered, factors, strata)
    draws = numbered.where(F.col("__number") > 1).withColumn("__replicate", F.explode(replicates))
    name = F.concat_ws("|", F.lit(str(design.seed)), *[F.col(k).cast("string") for k in strata], "__replicate", F.col("__number") - 1)
    picked = F.conv(F.substring(F.md5(name.cast("binary")), 1, DIGITS), 16, 10).cast("bigint") % F.col("n_psu") + 1
    hits = draws.select(*strata, picked.alias("__number"), "__replicate").groupBy(*strata, "__number").agg(F.collect_list("__replicate").alias("drawn"))
    found = numbered.join(hits, [*strata, "__number"], "left")
    alone = F.when(F.col("n_psu") == 1, replicates)
    return found.select(
        *design.cluster_keys,
        F.when(F.col("n_psu") == 1, 1.0).otherwise(F.col("factor")).alias("scale"),
        F.coalesce(alone, "drawn", F.array().cast("array<int>")).alias("drawn"),
    )
