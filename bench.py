"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "bench_flagship", "idw_k8", "adw_k8", "gwr_residual_p3", "fusion_ols_apply", "cv_metrics_stratified", "null_predictors", "rain_events", "event_scores",
    "hours_to_rain", "dry_spells", "silent_gauge", "intensity_confusion_cube", "diurnal_phase", "station_correlation", "regional_series", "mixed_gwr", "tps", "day_block_bootstrap", "supplier_panel_scores",
)


def main() -> None:
    from pluvion import session
    from pluvion.plans import catalogue

    spark = session.local("bench", CPUS, int(CPUS) if CPUS.isdigit() else 8)
    took = {}
    for name in HEADLINE:
        if name not in catalogue.QUERIES:
            continue
        began = time.time()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = SF_DIR.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
