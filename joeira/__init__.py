"""Joeira: table quality checks and record validation as Spark jobs.

The package takes a flat table of hospital admissions (or any table with the
same kinds of columns), finds what is wrong with it, and turns the rows into
typed documents.  Everything is a lazy DataFrame; nothing here calls a Python
function per row.
"""

from joeira.plans.quality import QualityResult, run_quality
from joeira.plans.patients import PatientJob, csv_to_documents

__all__ = ["QualityResult", "run_quality", "PatientJob", "csv_to_documents"]
