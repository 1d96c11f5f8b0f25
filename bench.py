"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is built and run once after a short warm-up, its rows counted by a no-op write.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from driftledger.session import local_session
from driftledger.workload import QUERIES

HEADLINE = [
    "content_hash",
    "hash_drift",
    "applied_versions",
    "recompute_cursor",
    "pending",
    "pending_shared",
    "pending_counts_shared",
    "status",
    "ledger_upsert",
    "ledger_fold",
    "backfill",
    "down_plan",
    "soft_revert",
    "record_applied",
    "record_reverted",
    "created_objects_pg",
    "dropped_objects_ms",
    "split_batches",
    "mask_script_text",
    "drop_lifecycle",
    "missing_objects",
    "verify",
    "verify_lite",
    "plan",
    "plan_lines",
    "doctor",
    "lint",
    "repair",
    "parse_instructions",
    "type_map_lite",
    "names",
    "class_names",
    "schema_contract",
    "contract_diff",
    "json_contracts",
    "composite_key",
    "fk_check",
    "self_reference",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # Intermediate tables go to a folder that the session names, as on a cluster.
    spark = local_session(cpus, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
