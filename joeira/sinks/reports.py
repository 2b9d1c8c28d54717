"""Writing a report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from joeira.sinks.files import replace


def report_name(written_at: dt.datetime) -> str:
    # Fixed value: the form of the name.
    return f"report_quality_gsheet_{written_at:%Y%m%d_%H%M}.md"


def write_report(lines: DataFrame, out_dir: str, written_at: dt.datetime | None = None) -> str:
    """Write the ordered lines as text under a time-stamped name.

    The sort leaves the parts in reading order; a report of ordinary size is
    one part file, since small sorted partitions are merged at run time.
    """
    path = f"{out_dir.rstrip('/')}/{report_name(written_at or dt.datetime.now())}"
    ordered = lines.orderBy("section", "part", "rank", "text").select("text")
    return replace(lines.sparkSession, path, lambda staged: ordered.write.text(staged))
