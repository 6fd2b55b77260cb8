"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`stage_ledger` is the time to derive and store the ledger the queries read, `stage_assessment` the time to store the
frames that the packet queries of one run share; both are counted in the total. Every query runs to the end into the
noop sink, so no row is skipped and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

import catalogue
from attestor.operators import validators
from attestor.session import build_session
from attestor.sources.derived import FRAMES, DerivedFrames
from catalogue.rules import assessment

HEADLINE = (
    "jn_01", "jn_03", "win_04", "flt_09", "agg_12", "agg_14", "req_01", "req_02", "req_03", "req_04", "req_06", "val_02", "val_04",
    "val_11", "val_14", "set_05", "rec_12", "rec_13", "map_07", "cit_02", "cit_04", "cit_08", "cit_14", "aud_08", "aud_09", "aud_14",
    "ret_07", "ret_10", "ret_10_blind", "cov_06", "grd_06", "pkt_02", "pkt_04", "pkt_05", "pkt_07", "snk_09", "str_03",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session("attestor-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    catalogue.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    began = time.perf_counter()
    frames = DerivedFrames(spark, folder)
    for name in FRAMES:
        frames[name]
    times["stage_ledger"] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    run = assessment(frames)
    for code in ("R1", "R2", "R4"):
        run.by_class(code)
    run.rows, validators.derive_marks(run)
    times["stage_assessment"] = round(time.perf_counter() - began, 3)
    for key in chosen:
        began = time.perf_counter()
        catalogue.spark_query(catalogue.REGISTRY[key])(spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - began, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(key, times[key], file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": scale, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
