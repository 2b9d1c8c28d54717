"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR``   tables to run on (default ``/root/testdata/sf0.1``)
``BENCH_CPUS``     cores for ``local[n]`` (default 8)
``BENCH_GROW``     also run the order-based queries on tables enlarged this
                   many times, written once to ``BENCH_GROW_DIR`` (to be set as well)

Every query runs to its end into a sink that drops the rows.  One run warms
the JVM up, the better of the next two counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from joeira.plans.catalogue import QUERIES  # noqa: E402
from joeira.session import local  # noqa: E402

HEADLINE = (
    "missing_values", "id_pattern", "duplicate_ids", "duplicate_id_rows", "duplicate_summary", "id_sequences",
    "serial_gaps", "missing_serials", "date_format_check", "year_consistency", "chronology", "stay_stats",
    "long_stays", "birth_validity", "age_stats", "age_histogram", "unusual_ages", "processo_invalid",
    "value_frequency_destino", "value_frequencies", "unexpected_values", "check_examples", "issues", "findings",
    "report_lines", "validated_patients", "validation_counts", "latest_per_id", "patient_json",
    "fingerprint_documents", "fingerprint_encounters", "change_status", "ship_lag_stats", "line_sequences",
    "line_gaps",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timings(spark, names, sf_dir: str) -> dict[str, float]:
    out = {}
    for name in names:
        run(spark, name, sf_dir)
        out[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
    return out


def grow(spark, sf_dir: str, times: int) -> str:
    """The same tables with ``times`` copies of the orders under new keys."""
    from pyspark.sql import functions as F

    out = f"{os.environ['BENCH_GROW_DIR']}/x{times}"
    if not Path(out, "orders.parquet", "_SUCCESS").exists():
        for name in ("customer", "orders"):
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if name == "orders":
                n = df.count()
                df = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(
                    "o_orderkey", F.col("o_orderkey") + F.col("copy") * n
                ).drop("copy").repartition(16)  # one file would be read by one task
            df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"))
    times = timings(spark, HEADLINE, sf_dir)
    result = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if os.environ.get("BENCH_GROW"):
        factor = int(os.environ["BENCH_GROW"])
        others = {"fingerprint_documents", "change_status", "ship_lag_stats", "line_sequences", "line_gaps"}
        result["grown"] = {
            "factor": factor,
            "queries": timings(spark, [n for n in HEADLINE if n not in others], grow(spark, sf_dir, factor)),
        }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
