"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

QUERIES = (
    "chunk_dedup_by_lang", "dup_owner_first_seen", "cross_doc_chunk_refs", "chunk_entropy_gate", "lsh_bucket_chunks", "multi_probe_join", "sim_topk",
    "diff_runs", "family_scattered", "ccf_roundtrip", "ring_placement", "quorum_status", "stage_percentiles", "topology_version",
    "legacy_roundtrip", "prepass_statistics", "pframe_savings",
)


def main() -> None:
    from simstrata.plans import catalogue
    from simstrata.session import get_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = get_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start-up isn't part of any query
    seconds = {}
    for name in QUERIES:
        began = time.perf_counter()
        catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
