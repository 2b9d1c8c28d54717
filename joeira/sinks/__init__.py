"""Writing tables, documents and reports."""
