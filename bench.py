"""Wall seconds of headline queries, printed as one JSON line."""

from __future__ import annotations

import json
import os
import time

from isobar import registry
from isobar.session import get_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "4"))
HEADLINE = (
    "bc_scaling_add", "bc_mva", "bc_eqm_none", "bc_dqm_add", "bc_qdm_add", "bc_loci", "bc_pqm_gamma", "bc_kfold_scaling", "bc_window_scaling",
    "isimip_additive", "isimip3_tas", "fill_dates", "ub_climatology", "analogs_mean", "glm_gaussian", "downscale_glm",
)


def main() -> None:
    """Run every headline query warm, three times, into the noop sink; report medians."""
    spark = get_session("bench", CPUS, 2 * CPUS, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["bc_scaling_add"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(sorted(runs)[1], 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
