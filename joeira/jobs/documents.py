"""CSV to patient documents: ``python -m joeira.jobs.documents --file PATH --out FOLDER``.

Prints the counts.  Exit code 0, or 1 when no row becomes a document or the run
fails.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from joeira.plans.patients import csv_to_documents
from joeira.session import tuned


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="joeira.jobs.documents", description=__doc__)
    args.add_argument("--file", "-f", required=True, help="CSV file, folder or pattern")
    args.add_argument("--year", "-y", help="year filter, such as 25 or 20-25")
    args.add_argument("--out", "-o", required=True, help="folder for the documents")
    args.add_argument("--by-year", action="store_true", help="a folder for each year")
    args.add_argument("--multiline", action="store_true", help="quoted cells may hold line breaks")
    given = args.parse_args(argv)
    spark = tuned(SparkSession.builder.appName("joeira documents").getOrCreate())
    try:
        job = csv_to_documents(spark, given.file, year_filter=given.year, multiline=given.multiline)
        counts = job.counts.first()
        print(", ".join(f"{k} {v}" for k, v in counts.asDict().items()))
        if not counts.processed:
            return 1
        print(job.write(given.out, by_year=given.by_year))
        return 0
    except Exception as problem:  # the caller sees the code, the log says why
        print(f"documents failed: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
