"""Benchmark: run the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: the headline set).
Each query is executed in full with the no-op sink (every row is computed,
nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.registry import load_all  # noqa: E402
from ledgerloom.session import get_session  # noqa: E402
from ledgerloom.sources import adapters  # noqa: E402

HEADLINE = ["live_balance", "income_report", "consolidated", "balance_series", "weekly_purchases",
            "ledger_load", "request_balance", "receipts_explode", "withdrawals", "requests_append",
            "clients_clean", "client_lookup", "movement_worklist", "assignment_apply",
            "invoice_split", "billing_run", "billing_rejects", "invoice_writeback",
            "receipt_dedupe", "receipt_settlement"]


# domain tables read by the headline queries
STORED = ["ledger", "ledger_raw", "accounts", "requests", "request_forms", "receipts", "movements", "clients",
          "known_customers", "notes", "invoice_register", "assignment_edits"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="ledgerloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    # warm-up (JVM / Python workers), not timed
    reg["last_update"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    # the domain tables (derived from the driver tables by the adapters) are
    # written once as parquet, as they would be stored in production; timed
    t0 = time.perf_counter()
    adapters.store(spark, sf_dir, STORED)
    times["store_domain_tables"] = round(time.perf_counter() - t0, 3)
    for name in names:
        spark.catalog.clearCache()  # no query lives on what another one kept
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
