"""Times the headline queries and prints one JSON line.

Each query is timed three times to a full materialisation of its result; the median counts, so that the
first run may load classes. The comparison entries time the step-by-step form that a fused operator
replaces.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from panelweave.operators.estimate import svy_mean, svy_share, svy_total, svy_total_by  # noqa: E402
from panelweave.plans import bindings as b  # noqa: E402
from panelweave.plans.queries import QUERIES, batch  # noqa: E402
from panelweave.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
REPEATS = 3
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "household_income_annual",
    "parent_max",
    "audience_flags",
    "pair_dropout",
    "survival_table",
    "evasion_flag",
    "svy_batch",
    "svy_interaction",
    "svy_poststratify",
    "svy_se_taylor",
    "svy_se_poststratified",
    "svy_se_replicate",
    "km_curve_by",
    "cox_fit",
    "mincer_fit",
    "probit_fit",
    "heckman_two_step",
    "residual_impute",
    "report_blocks",
)


def materialise(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def median_time(run) -> float:
    times = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def separate_batch(spark, sf_dir):
    """The fused batch as one aggregate per statistic and sub-population."""
    wanted, design = batch(), b.design(spark, sf_dir, by_year=True)
    for name, condition in b.domains().items():
        domain = {name: condition}
        materialise(svy_total(design, domain))
        for estimate, variables in (
            (svy_total_by, wanted.totals_by),
            (svy_share, wanted.shares),
            (svy_mean, wanted.means),
        ):
            for var, column in variables.items():
                materialise(estimate(design, {var: column}, domain))


def chained_survival(spark, sf_dir):
    """The survival table by one join and one anti-join per wave."""
    rows = b.panel(spark, sf_dir)
    last = rows.groupBy("o_custkey", "wave").agg(F.max_by("o_orderstatus", F.struct(*b.PANEL_ORDER)).alias("status"))
    waves = {w: last.where(F.col("wave") == w).select("o_custkey", "status") for w in b.WAVES}
    alive, parts = waves[1].where("status = 'F'").select("o_custkey"), []
    for w in b.WAVES[1:]:
        joined = alive.join(waves[w], "o_custkey")
        parts.append(joined.where("status = 'P'").selectExpr("o_custkey", "1 AS status", f"{w} AS time"))
        absent = alive.join(waves[w], "o_custkey", "left_anti")
        parts.append(absent.selectExpr("o_custkey", "0 AS status", f"{w - 1} AS time"))
        alive = joined.where("status <> 'P'").select("o_custkey")
    parts.append(alive.selectExpr("o_custkey", "0 AS status", f"{b.WAVES[-1]} AS time"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    materialise(out)


def main() -> None:
    spark = local_session(CPUS, "bench")
    timings: dict[str, float] = {}
    for name in HEADLINE:
        timings[name] = median_time(lambda name=name: materialise(QUERIES[name](spark, SF_DIR)))
    comparison = {}
    for name, run in (("svy_batch_separate", separate_batch), ("survival_table_chained", chained_survival)):
        comparison[name] = median_time(lambda run=run: run(spark, SF_DIR))
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "step_by_step": comparison,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
