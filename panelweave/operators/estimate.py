"""Weighted totals, shares and means of many variables and sub-populations in one pass.

Every row is turned into one narrow item per requested statistic, and one grouped sum over items
gives all of them. Items combine on the map side, so the shuffle carries category totals (times
clusters, when a standard error is wanted), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.bootstrap import drawn_clusters
from panelweave.operators.design import SurveyDesign, poststratum_products
from panelweave.session import checkpointed

TOTAL, TOTAL_BY, SHARE, MEAN = "total", "total_by", "share", "mean"
EVERYONE = "all"
LEVEL_SEPARATOR = "."
DESIGN_ITEM = "design"
NO_LEVEL = ""
# Sums a task adds up before it hands them on.
HELD_SUMS = 4_000_000
# A variance below this share of the squares it is the difference of is rounding, and so zero.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Statistics:
    """What to estimate. Names label the result; a NULL value leaves only its own variable.

    `interactions` maps a name to columns whose combined category is shared out; `levels` lists the
    categories of those columns, so that combinations nobody has appear with 0.
    """

    population: bool = False
    totals_by: Mapping[str, Column] = field(default_factory=dict)
    shares: Mapping[str, Column] = field(default_factory=dict)
    means: Mapping[str, Column] = field(default_factory=dict)
    interactions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)


def estimates(
    design: SurveyDesign, wanted: Statistics, domains: Mapping[str, Column] | None = None, se: str | None = None
) -> DataFrame:
    """(by, subpop, stat, var, level, value[, std_error]), one row per estimate.

    `domains` maps a sub-population's name to its condition. `se` is None, "taylor", "replicate" or "bootstrap";
    with "taylor" and "bootstrap" the cluster totals are written once and all algebra reads those.
    """
    if se not in (None, "taylor", "replicate", "bootstrap"):
        raise ValueError(f"unknown standard error: {se}")
    if se == "bootstrap" and (design.bootstrap < 1 or design.poststratum):
        raise ValueError("a bootstrap needs a number of replicates and a design without post-strata")
    domains = domains or {EVERYONE: F.lit(True)}
    if se == "replicate":
        result = _replicated(design, _replicate_cells(design, wanted, domains))
    elif se in ("taylor", "bootstrap"):
        clusters = design.cluster_columns
        sums = checkpointed(_item_sums(_with_known_places(design), wanted, domains, clusters))
        spread = _taylor if se == "taylor" else _bootstrapped
        result = spread(design, _cells(design, sums, domains, clusters), _places(design, sums))
    else:
        sums = _item_sums(design, wanted, domains, [])
        result = _points(design, _cells(design, sums, domains, [])).drop("__bottom")
    return _finished(design, wanted, result)


def additive_sums(design: SurveyDesign, wanted: Statistics, domains: Mapping[str, Column] | None = None) -> DataFrame:
    """(by, clusters, item, level, w, and y_ and x_ of each sub-population): all that `estimates_from_sums` needs.

    These add up: sums of disjoint rows, of other periods or of the same, can be kept and merged later, so that finished
    periods are never read again. With post-strata, adjust the weights before, from complete periods.
    """
    domains = domains or {EVERYONE: F.lit(True)}
    sums = _item_sums(_with_known_places(design), wanted, domains, design.cluster_columns)
    return sums.withColumnsRenamed({f"{kind}_{i}": f"{kind}_{name}" for i, name in enumerate(domains) for kind in "yx"})


def merge_sums(design: SurveyDesign, *parts: DataFrame) -> DataFrame:
    """The sums of all rows behind `parts`, tables of `additive_sums` over the same statistics."""
    keys = [*design.by, *design.cluster_columns, "item", "level"]
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy(*keys).agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in together.columns if c not in keys])


def estimates_from_sums(
    design: SurveyDesign, sums: DataFrame, wanted: Statistics, domains: Sequence[str] = (EVERYONE,), se: str | None = None
) -> DataFrame:
    """The estimates of `additive_sums`, as `estimates` gives them from the rows; no row is read again.

    `design` gives the names of the columns; `se` is None or "taylor".
    """
    if se not in (None, "taylor"):
        raise ValueError("sums by cluster give no standard error but that by linearisation")
    clusters = design.cluster_columns
    keys = [*design.by, *clusters, "item", "level", "w"]
    numbered = [F.col(f"`{kind}_{name}`").alias(f"{kind}_{i}") for i, name in enumerate(domains) for kind in "yx"]
    sums = sums.select(*keys, *numbered)
    names = dict.fromkeys(domains)
    if se == "taylor":
        result = _taylor(design, _cells(design, sums, names, clusters), _places(design, sums))
    else:
        added = [F.sum(c).alias(c) for c in sums.columns if c not in keys]
        whole = sums.groupBy(*design.by, "item", "level").agg(*added)
        result = _points(design, _cells(design, whole, names, [])).drop("__bottom")
    return _finished(design, wanted, result)


def _places(design: SurveyDesign, sums: DataFrame) -> DataFrame:
    return sums.where(F.col("item") == DESIGN_ITEM).select(*design.by, *design.cluster_columns, "w")


def _finished(design: SurveyDesign, wanted: Statistics, result: DataFrame) -> DataFrame:
    if wanted.interactions:
        result = _with_empty_combinations(design, wanted, result)
    return result.withColumn("level", F.when(F.col("level") != NO_LEVEL, F.col("level")))


def svy_total(design: SurveyDesign, domains: Mapping[str, Column] | None = None, se: str | None = None) -> DataFrame:
    return estimates(design, Statistics(population=True), domains, se)


def svy_total_by(design, variables: Mapping[str, Column], domains=None, se: str | None = None) -> DataFrame:
    return estimates(design, Statistics(totals_by=variables), domains, se)


def svy_share(design, variables: Mapping[str, Column], domains=None, se: str | None = None) -> DataFrame:
    return estimates(design, Statistics(shares=variables), domains, se)


def svy_mean(design, variables: Mapping[str, Column], domains=None, se: str | None = None) -> DataFrame:
    return estimates(design, Statistics(means=variables), domains, se)


def svy_interaction(
    design, name: str, columns: Sequence[str], levels: Mapping[str, Sequence[str]], domains=None, se: str | None = None
) -> DataFrame:
    return estimates(design, Statistics(interactions={name: columns}, levels=levels), domains, se)


def _with_known_places(design: SurveyDesign) -> SurveyDesign:
    """Refuse rows without a period, stratum or cluster: a variance cannot place them, and must not lose them."""
    checked = {}
    for name in design.cluster_keys:
        field_ = design.data.schema[name]
        if field_.nullable:
            missing = F.raise_error(F.lit(f"a row of the design has no {name}")).cast(field_.dataType)
            checked[name] = F.coalesce(F.col(name), missing)
    return design.with_columns(checked)


def _items(wanted: Statistics) -> dict[str, Column]:
    """Each statistic as a struct (level, y), NULL where the row does not take part."""

    def item(level: Column | None, y: Column, present: Column) -> Column:
        level = F.lit(NO_LEVEL) if level is None else level.cast("string")
        return F.when(present, F.struct(level.alias("level"), y.cast("double").alias("y")))

    one = F.lit(1.0)
    items: dict[str, Column] = {}
    if wanted.population:
        items[f"{TOTAL}|count"] = item(None, one, F.lit(True))
    for name, value in wanted.totals_by.items():
        items[f"{TOTAL_BY}|{name}"] = item(value, one, value.isNotNull())
    for name, value in wanted.shares.items():
        items[f"{SHARE}|{name}"] = item(value, one, value.isNotNull())
    for name, value in wanted.means.items():
        items[f"{MEAN}|{name}"] = item(None, value, value.isNotNull())
    for name, columns in wanted.interactions.items():
        # concat is NULL as soon as one part is.
        parts = [p for c in columns for p in (F.lit(LEVEL_SEPARATOR), F.col(c).cast("string"))][1:]
        combined = F.concat(*parts)
        items[f"{SHARE}|{name}"] = item(combined, one, combined.isNotNull())
    return items


def _inside(domains: Mapping[str, Column]) -> dict[str, Column]:
    return {f"in_{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(domains.values())}


def _item_sums(design: SurveyDesign, wanted: Statistics, domains: Mapping[str, Column], clusters) -> DataFrame:
    """One row per (by, clusters, item, level) with the weighted sums of every sub-population.

    For sub-population i, `y_i` sums weight times value and `x_i` the weight. With clusters there is
    also the design item, which covers all rows and carries the weight `w` of the cluster.
    """
    items, inside = _items(wanted), _inside(domains)
    anywhere = reduce(or_, inside.values())
    ids = [*design.by, *clusters, design.weight, *inside]
    rows = design.data.withColumns(inside).select(
        *ids,
        F.struct(F.lit(NO_LEVEL).alias("level"), F.lit(0.0).alias("y")).alias(DESIGN_ITEM),
        *[F.when(anywhere, item).alias(name) for name, item in items.items()],
    )
    values = [f"`{name}`" for name in ([DESIGN_ITEM] if clusters else []) + list(items)]
    long = (
        rows.unpivot(ids, values, "item", "cell")
        .where(F.col("cell").isNotNull())
        .select(*ids, "item", F.col("cell.level").alias("level"), F.col("cell.y").alias("y"))
    )
    weight = F.col(design.weight)
    sums = [F.sum(weight).alias("w")]
    for i, flag in enumerate(inside):
        sums.append(F.sum(F.when(F.col(flag), weight * F.col("y"))).alias(f"y_{i}"))
        sums.append(F.sum(F.when(F.col(flag), weight)).alias(f"x_{i}"))
    return long.groupBy(*design.by, *clusters, "item", "level").agg(*sums)


def _named(item: Column) -> list[Column]:
    split = F.split(item, r"\|")
    return [split[0].alias("stat"), split[1].alias("var")]


def _cells(design: SurveyDesign, sums: DataFrame, domains: Mapping[str, Column], clusters) -> DataFrame:
    """The wide sums as one row per sub-population with y and x."""
    per_domain = F.array(
        *[
            F.struct(F.lit(name).alias("subpop"), F.col(f"y_{i}").alias("y"), F.col(f"x_{i}").alias("x"))
            for i, name in enumerate(domains)
        ]
    )
    return (
        sums.where(F.col("item") != DESIGN_ITEM)
        .select(*design.by, *clusters, *_named(F.col("item")), "level", F.inline(per_domain))
        .where(F.col("y").isNotNull())
    )


def _replicate_cells(design: SurveyDesign, wanted: Statistics, domains: Mapping[str, Column]) -> DataFrame:
    """Sums y and x for the full weight (pos 0) and every replicate weight.

    Each task sorts its batches by category and adds up the weights of each, all weights at once. It hands
    on one pair of arrays per category, early when it holds many.
    """
    items, inside, by = _items(wanted), _inside(domains), list(design.by)
    weights = [design.weight, *design.replicates]
    columns = [F.col(w).cast("double").alias(f"w{j}") for j, w in enumerate(weights)]
    for i, item in enumerate(items.values()):
        columns += [item["level"].alias(f"l{i}"), item["y"].alias(f"v{i}")]
    rows = design.data.where(reduce(or_, inside.values())).select(
        *by, *[c.alias(name) for name, c in inside.items()], *columns
    )
    is_mean = [name.startswith(f"{MEAN}|") for name in items]
    flags, weight_names = list(inside), [f"w{j}" for j in range(len(weights))]
    by_types = "".join(f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}, " for k in by)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}

        def add(place: tuple, levels, kind: str, sums: np.ndarray) -> None:
            for level, row in zip(levels, sums, strict=True):
                key = (*place[:-1], level, place[-1], kind)
                totals[key] = totals.get(key, 0.0) + row

        def handed_on() -> pd.DataFrame:
            out = [(*key[:-1], totals.get((*key[:-1], "y"), x).tolist(), x.tolist()) for key, x in totals.items() if key[-1] == "x"]
            return pd.DataFrame(out, columns=[*by, "item", "level", "domain", "ys", "xs"])

        for batch in batches:
            for period, part in batch.groupby(by, sort=False, dropna=False) if by else [((), batch)]:
                for k, flag in enumerate(flags):
                    chosen = part[part[flag].to_numpy(bool)]
                    if len(chosen) == 0:
                        continue
                    weight = chosen[weight_names].to_numpy(float)
                    for i, mean in enumerate(is_mean):
                        codes, found = pd.factorize(chosen[f"l{i}"], sort=True)
                        order = np.argsort(codes, kind="stable")[(codes < 0).sum() :]
                        if len(order) == 0:
                            continue
                        starts = np.searchsorted(codes[order], np.arange(len(found)))
                        add((*period, i, k), found, "x", np.add.reduceat(weight[order], starts))
                        # For shares and totals y is the weight itself, so one column serves both sums.
                        if mean:
                            value = chosen[f"v{i}"].to_numpy(float)[order, None]
                            add((*period, i, k), found, "y", np.add.reduceat(weight[order] * value, starts))
            if len(totals) * len(weights) > HELD_SUMS:
                yield handed_on()
                totals.clear()
        yield handed_on()

    schema = f"{by_types}item int, level string, domain int, ys array<double>, xs array<double>"
    keys = [*by, "item", "level", "domain"]
    added = (
        rows.mapInPandas(partials, schema)
        .select(*keys, F.posexplode(F.arrays_zip("ys", "xs")).alias("pos", "sums"))
        .groupBy(*keys, "pos")
        .agg(F.sum("sums.ys").alias("y"), F.sum("sums.xs").alias("x"))
    )
    item_names, domain_names = (F.array(*[F.lit(n) for n in names]) for names in (items, domains))
    return added.select(
        *by, domain_names[F.col("domain")].alias("subpop"), *_named(item_names[F.col("item")]), "level", "pos", "y", "x"
    )


def _variable_keys(design: SurveyDesign) -> list[str]:
    return [*design.by, "subpop", "stat", "var"]


def _is_total() -> Column:
    return F.col("stat").isin(TOTAL, TOTAL_BY)


def _points(design: SurveyDesign, cells: DataFrame) -> DataFrame:
    keys = [*_variable_keys(design), "level"]
    by_cluster = design.strata in cells.columns
    sums = cells.groupBy(*keys).agg(F.sum("y").alias("y"), F.sum("x").alias("x")) if by_cluster else cells
    # A window over the categories of one variable: a handful of rows, all after aggregation.
    bottom = F.sum("x").over(Window.partitionBy(*_variable_keys(design)))
    return sums.withColumn("__bottom", F.when(_is_total(), F.lit(1.0)).otherwise(bottom)).select(
        *keys, F.try_divide("y", "__bottom").alias("value"), "__bottom"
    )


def _taylor(design: SurveyDesign, cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Linearised standard errors from cluster totals.

    A ratio R = Y / X has the cluster scores (y - R x) / X, a total has the scores y. Clusters where a
    category is absent have y = 0 but still an x, so their squares come from the variable as a whole.
    """
    variable, places = _variable_keys(design), [design.strata, design.psu]
    keys = [*variable, "level"]
    points = _points(design, cells)
    tops = cells.select(*keys, *design.cluster_columns, "y")
    bottoms = (
        cells.where(~_is_total()).groupBy(*variable, *design.cluster_columns).agg(F.sum("x").alias("x"))
    )
    factors = design.stratum_factors(clusters)
    adjustment = None
    if design.poststratum:
        # Small tables that the adjustment and the plain variance both read.
        points, factors = checkpointed(points), checkpointed(factors)
        adjustment = _poststratified(design, clusters, factors, tops, bottoms, points)
        tops = tops.groupBy(*keys, *places).agg(F.sum("y").alias("y"))
        bottoms = bottoms.groupBy(*variable, *places).agg(F.sum("x").alias("x"))

    def zero_if_absent(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)).alias(name)

    x = F.coalesce("x", F.lit(0.0))
    top_strata = (
        tops.join(bottoms, [*variable, *places], "left")
        .groupBy(*keys, design.strata)
        .agg(F.sum("y").alias("s_y"), F.sum(F.col("y") * F.col("y")).alias("s_yy"), F.sum(F.col("y") * x).alias("s_xy"))
    )
    bottom_strata = bottoms.groupBy(*variable, design.strata).agg(
        F.sum("x").alias("s_x"), F.sum(F.col("x") * F.col("x")).alias("s_xx")
    )
    whole = points.where(~_is_total()).select(*keys).join(bottom_strata, variable)
    per_stratum = (
        top_strata.join(whole, [*keys, design.strata], "full")
        .select(*keys, design.strata, *[zero_if_absent(c) for c in ("s_y", "s_yy", "s_xy", "s_x", "s_xx")])
        .join(factors, [*design.by, design.strata])
        .join(points, keys)
    )
    ratio = F.when(_is_total(), F.lit(0.0)).otherwise(F.col("value"))
    total = F.col("s_y") - ratio * F.col("s_x")
    squares = F.col("s_yy") - 2 * ratio * F.col("s_xy") + ratio * ratio * F.col("s_xx")
    spread = F.col("factor") * (squares - total * total / F.col("n_psu"))
    scale = F.sum(F.col("factor") * (F.col("s_yy") + ratio * ratio * F.col("s_xx")))
    summed = per_stratum.groupBy(*keys).agg(
        F.first("value").alias("value"), F.first("__bottom").alias("__bottom"), F.sum(spread).alias("__variance"), scale.alias("__scale")
    )
    variance = F.greatest("__variance", F.lit(0.0))
    if adjustment is not None:
        summed = summed.join(adjustment, keys, "left")
        netted = F.col("__variance") + F.coalesce("__adjustment", F.lit(0.0))
        variance = F.when(netted > F.col("__scale") * ROUNDING, netted).otherwise(0.0)
    return summed.select(*keys, "value", (F.sqrt(variance) / F.abs("__bottom")).alias("std_error"))


def _poststratified(
    design: SurveyDesign, clusters: DataFrame, factors: DataFrame, tops: DataFrame, bottoms: DataFrame, points: DataFrame
) -> DataFrame:
    """(keys, __adjustment): what post-strata change in the variance of the linearised totals.

    The score of a cluster is z - (sum over post-strata of k w), with z = y - R x its total, w its weight in the
    post-stratum and k the post-stratum's mean of y - R x. Its variance is that of z, less twice the sum of k times the
    covariance of z and w, plus the sum of k k' times that of w and w'. The last is one matrix for all estimates, so no
    estimate meets a cluster where it has nothing.
    """
    shared = poststratum_products(design, clusters, factors)
    group, by, variable = shared.group, list(design.by), _variable_keys(design)
    keys = [*variable, "level"]
    # Numerators and denominators go the same way, told apart by their side.
    places = [design.strata, design.psu, group]
    y_cells = tops.select(*keys, F.lit("y").alias("__side"), *places, F.col("y").alias("v"))
    x_cells = bottoms.select(*variable, F.lit(NO_LEVEL).alias("level"), F.lit("x").alias("__side"), *places, F.col("x").alias("v"))
    cells, sided = y_cells.unionByName(x_cells), [*keys, "__side"]
    none = F.lit(0.0)
    means = cells.groupBy(*sided, group).agg(F.sum("v").alias("v")).join(shared.sizes, [*by, group])
    totals = cells.groupBy(*sided, design.strata, design.psu).agg(F.sum("v").alias("v"))
    covered = shared.covariances(totals, sided, "v").select(*sided, group, none.alias("k"), F.col("covariance").alias("c"))
    sides = checkpointed(means.select(*sided, group, (F.col("v") / F.col("__n")).alias("k"), none.alias("c")).unionByName(covered))
    # A denominator's part counts -R times in every category of its variable.
    ratios = points.where(~_is_total()).select(*keys, (-F.col("value")).alias("__r"))
    shares = sides.where("__side = 'x'").drop("level").join(ratios, variable)
    shares = shares.select(*keys, group, (F.col("k") * F.col("__r")).alias("k"), (F.col("c") * F.col("__r")).alias("c"))
    both = sides.where("__side = 'y'").select(*keys, group, "k", "c").unionByName(shares)
    # One row per estimate and post-stratum, read three times.
    both = checkpointed(both.groupBy(*keys, group).agg(F.sum("k").alias("k"), F.sum("c").alias("c")))
    linear = both.select(*keys, (-2.0 * F.col("k") * F.col("c")).alias("part"))
    half = both.select(*keys, group, "k").join(shared.pairs, [*by, group])
    half = half.groupBy(*keys, F.col("__other").alias(group)).agg(F.sum(F.col("k") * F.col("product")).alias("kp"))
    square = half.join(both.select(*keys, group, "k"), [*keys, group]).select(*keys, (F.col("kp") * F.col("k")).alias("part"))
    return linear.unionByName(square).groupBy(*keys).agg(F.sum("part").alias("__adjustment"))


def _replicated(design: SurveyDesign, cells: DataFrame) -> DataFrame:
    """Standard errors from replicate weights: mean squared distance from the full-sample estimate."""
    variable = _variable_keys(design)
    # Denominators are one row per variable and weight; the window partitions hold the categories' numbers.
    bottom = F.sum("x").over(Window.partitionBy(*variable, "pos"))
    each = cells.withColumn("e", F.try_divide("y", F.when(_is_total(), F.lit(1.0)).otherwise(bottom)))
    # One estimate has as many values as there are weights.
    gathered = each.groupBy(*variable, "level").agg(F.sort_array(F.collect_list(F.struct("pos", "e"))).alias("es"))
    gathered = gathered.select(*variable, "level", F.col("es.e").alias("e")).withColumn("value", F.col("e")[0])
    squares = F.transform("e", lambda e: (e - F.col("value")) * (e - F.col("value")))
    variance = F.aggregate(squares, F.lit(0.0), lambda total, q: total + q) / F.lit(float(len(design.replicates)))
    return gathered.select(*variable, "level", "value", F.sqrt(variance).alias("std_error"))


def _bootstrapped(design: SurveyDesign, cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Standard errors from bootstrap replicates of the clusters: mean squared distance from the full-sample estimate.

    Every cluster total meets its row of the factor matrix, and tasks add up the products of all replicates at once; no
    row of the design is read again. Replicates without weight in a denominator are left out of the mean.
    """
    variable = _variable_keys(design)
    keys, size = [*variable, "level"], design.bootstrap + 1
    rows = cells.join(drawn_clusters(design, clusters), design.cluster_keys).select(*keys, "y", "x", "scale", "drawn")

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            owner = np.repeat(np.arange(len(batch)), batch["drawn"].map(len).to_numpy())
            drawn = np.concatenate([np.asarray(d, np.int64) for d in batch["drawn"]])
            factors = np.bincount(owner * size + drawn, minlength=len(batch) * size).reshape(-1, size) * batch["scale"].to_numpy()[:, None]
            factors[:, 0] = 1.0
            groups = batch.groupby(keys, sort=False, dropna=False)
            codes = groups.ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[order], np.arange(codes.max() + 1))
            out = batch.iloc[order[starts]][keys].reset_index(drop=True)
            for name in ("y", "x"):
                values = batch[name].fillna(0.0).to_numpy(float)[:, None]
                out[name] = list(np.add.reduceat((factors * values)[order], starts))
            yield out

    types = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    added = (
        rows.mapInPandas(partials, f"{types}y array<double>, x array<double>")
        .select(*keys, F.posexplode(F.arrays_zip("y", "x")).alias("pos", "sums"))
        .groupBy(*keys, "pos")
        .agg(F.sum("sums.y").alias("y"), F.sum("sums.x").alias("x"))
    )
    each = checkpointed(added)
    bottoms = each.where(~_is_total()).groupBy(*variable, "pos").agg(F.sum("x").alias("__bottom"))
    ratio = F.when(_is_total(), F.col("y")).otherwise(F.try_divide("y", "__bottom"))
    each = each.join(bottoms, [*variable, "pos"], "left").select(*keys, "pos", ratio.alias("e"))
    gathered = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "e"))).alias("es"))
    gathered = gathered.select(*keys, F.col("es.e").alias("e")).withColumn("value", F.col("e")[0])
    known = F.filter(F.slice("e", 2, size), lambda e: e.isNotNull())
    squares = F.aggregate(known, F.lit(0.0), lambda total, e: total + (e - F.col("value")) * (e - F.col("value")))
    return gathered.select(*keys, "value", F.sqrt(F.try_divide(squares, F.size(known).cast("double"))).alias("std_error"))


def _with_empty_combinations(design: SurveyDesign, wanted: Statistics, result: DataFrame) -> DataFrame:
    """Add the declared combinations that nobody has, with value 0.

    The finished estimates are written once; of the interactions only their variables and levels are compared.
    """
    variable = _variable_keys(design)
    result = checkpointed(result)
    values = [c for c in result.columns if c not in (*variable, "level")]
    declared = F.array().cast("array<string>")
    for name, columns in wanted.interactions.items():
        combined = [LEVEL_SEPARATOR.join(parts) for parts in product(*[wanted.levels[c] for c in columns])]
        is_this = (F.col("stat") == SHARE) & (F.col("var") == name)
        declared = F.when(is_this, F.array(*[F.lit(c) for c in combined])).otherwise(declared)
    keys = [*variable, "level"]
    expected = result.select(*variable).distinct().withColumn("level", F.explode(declared))
    found = result.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    absent = expected.join(found, same, "left_anti")
    return result.unionByName(absent.select(*keys, *[F.lit(0.0).alias(v) for v in values]))
