"""Quality run over a CSV: ``python -m joeira.jobs.quality --file PATH --out FOLDER``.

Writes the report as Markdown and the findings as Parquet.  Exit code 0, or 1
when the year filter leaves no rows or the run fails.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from joeira.plans.quality import run_quality_csv
from joeira.session import tuned
from joeira.sinks.files import replace
from joeira.sinks.reports import write_report


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="joeira.jobs.quality", description=__doc__)
    args.add_argument("--file", "-f", required=True, help="CSV file, folder or pattern")
    args.add_argument("--year", "-y", help="two digits, or two of them with a dash: 25 or 20-25")
    args.add_argument("--as-of", help="day that counts as today, yyyy-mm-dd")
    args.add_argument("--out", "-o", required=True, help="folder for report and findings")
    args.add_argument("--reuse", action="store_true", help="parse the text once, into the shared folder of the session")
    args.add_argument("--multiline", action="store_true", help="quoted cells may hold line breaks")
    given = args.parse_args(argv)
    spark = tuned(SparkSession.builder.appName("joeira quality").getOrCreate())
    run = None
    try:
        run = run_quality_csv(spark, given.file, given.as_of, given.year, multiline=given.multiline, reuse=given.reuse)
        code = run.exit_code()
        if code:
            print(f"no rows of {given.year} in {given.file}", file=sys.stderr)
            return code
        now = dt.datetime.now()
        print(write_report(run.report(given.file, now), given.out, now))
        replace(spark, f"{given.out.rstrip('/')}/findings", run.findings.write.parquet)
        return 0
    except Exception as problem:  # the caller sees the code, the log says why
        print(f"quality run failed: {problem}", file=sys.stderr)
        return 1
    finally:
        if run is not None:
            run.close()


if __name__ == "__main__":
    sys.exit(main())
