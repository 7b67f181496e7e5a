"""Reports of a reconciliation."""

from tallyframe.sinks.report import summary_lines, write_csv, write_json, write_tables, write_workbook

__all__ = ["summary_lines", "write_csv", "write_json", "write_tables", "write_workbook"]
