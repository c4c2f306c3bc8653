"""Time the registered queries and a raw refresh; print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, default all but ``ON_REQUEST``), BENCH_RAW_OBJECTS (documents in the refresh).
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from pathlib import Path

from fleetmetrics import build_session, curate
from fleetmetrics.sources.responses import payloads
from fleetmetrics.workload import tables as t
from fleetmetrics.workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
#: Round trips that mostly write one small file an hour: timed only where they are asked for.
ON_REQUEST = ("published_roundtrip", "observed_batches", "live_stream", "monthly_from_states", "registered_hours")
NAMES = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or [n for n in QUERIES if n not in ON_REQUEST]
RAW_OBJECTS = int(os.environ.get("BENCH_RAW_OBJECTS", "1563"))


def seconds(spark, name: str) -> float:
    """Build, plan and run one query into the no-op sink."""
    started = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def write_documents(spark, root: Path) -> int:
    """Raw objects as the collector leaves them: one pretty-printed document per file."""
    rows = payloads(t.response_requests(spark, SF_DIR), t.response_pages(spark, SF_DIR))
    written = 0
    for number, row in enumerate(rows.where("datapoint_count > 0").limit(RAW_OBJECTS).toLocalIterator()):
        document = row.asDict(recursive=True)
        folder = root / (
            f"account_id={row.source_account_id}/region={row.region}/metric={row.metric_name}/"
            f"date={row.end_time[:10]}"
        )
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{row.resource_id}_{number}.json").write_text(json.dumps(document, indent=2))
        written += 1
    return written


def refresh(spark) -> tuple[float, dict[str, float]]:
    """A whole-prefix refresh of raw documents, the one job with a published figure."""
    base = Path(tempfile.mkdtemp(prefix="fleetmetrics-bench-"))
    objects = write_documents(spark, base / "raw")
    started = time.perf_counter()
    stats = curate(spark, str(base / "raw"), str(base / "curated"), partitioned_only=True)
    elapsed = time.perf_counter() - started
    return round(elapsed, 3), {
        "raw_objects": objects,
        "raw_objects_per_sec": round(objects / elapsed, 1),
        "datapoints": stats["raw_datapoint_count"],
        "curated_rows": stats["curated_row_count"],
    }


def main() -> None:
    spark = build_session(
        "fleetmetrics-bench",
        master=f"local[{CPUS}]",
        conf={
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{SF_DIR}/region.parquet").count()
    times = {name: seconds(spark, name) for name in NAMES}
    refresh_seconds, detail = refresh(spark)
    times["raw_refresh"] = refresh_seconds
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "raw_refresh": detail,
            }
        )
    )


if __name__ == "__main__":
    main()
