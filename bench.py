"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factorspark.catalog import QUERIES  # noqa: E402
from factorspark.session import local_session  # noqa: E402

HEADLINE = [
    "monthly_bars", "densify", "session_bars", "ts_mean", "ts_std", "ts_med", "ts_rank", "ts_ema", "ts_rsi", "ts_corr",
    "expr_nested", "expr_alternating", "expr_many", "cs_rank", "cs_zscore", "cs_winsorize", "ic_daily", "rank_ic_daily",
    "ic_summary", "mutual_ic_matrix", "mutual_ic_blocks", "candidate_scores", "pool_metrics", "pool_fit", "turnover_topk",
    "walk_forward", "segment_metrics", "asof_fill", "readjust", "tracking_error", "te_share", "idiosyncratic_vol",
    "style_features", "factor_score", "long_only", "swap_decision", "portfolio_returns", "risk_summary",
    "missing_by_feature", "candidate_validity", "weighted_spearman", "regression_metrics", "pareto_front",
    "prefix_program", "polynomial_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus)
        spark.sparkContext.setLogLevel("ERROR")
        QUERIES["ic_daily"](spark, folder).collect()  # start the JVM paths once
        times = {}
        for name in only or HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        spark.stop()
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else folder,
    }))


if __name__ == "__main__":
    main()
