"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every result is computed in full (no-op sink). One small query first starts the session; no
query runs before it is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lendlake.plans import catalog  # noqa: E402
from lendlake.session import session  # noqa: E402

HEADLINE = [
    "top_defaulters", "monthly_collections_by_mode", "score_trend", "loan_type_performance",
    "eligible_customers", "risk_distribution", "emi_status_summary", "penalty_leaderboard",
    "income_capacity", "income_capacity_exact", "cumulative_repayment",
    "cumulative_repayment_by_loan", "loans_by_risk", "all_loans", "emi_ledger",
    "repayment_progress", "latest_score", "status_timeline", "credit_history_rollup",
    "emi_schedule_generate", "emi_schedule_backfill", "mark_overdue", "detect_defaults",
    "default_sweep", "apply_payments", "disburse_loans", "validate_tables", "rule_default_score",
    "train_score_model", "train_risk_model", "train_default_model", "stream_apply_payments",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.run("loan_status_breakdown", spark, path).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.run(name, spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(path).name}))


if __name__ == "__main__":
    main()
