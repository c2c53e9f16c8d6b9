"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sitegauge.plans.queries import QUERIES  # noqa: E402
from sitegauge.session import build_session  # noqa: E402

HEADLINE = (
    "page_elements",
    "word_count",
    "page_scores",
    "score_report",
    "signals_long",
    "top_fixes",
    "sig_word_count",
    "sig_author_byline",
    "robots_block_counts",
    "url_safety",
    "redirect_chain_safety",
    "rate_limit_decisions",
    "request_ordinals",
    "minute_counts",
    "request_outcome",
    "rate_limit_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        # The given tables are one file each: deal their rows over the cores.
        sitegauge__spread="true",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("OFF")
    # One small run first: the figures show the queries, not the start of the JVM and the workers.
    QUERIES["page_scores"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
