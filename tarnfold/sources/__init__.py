"""Scans and sinks with declared schemas."""

from tarnfold.sources.readers import read_csv, read_database, read_json_documents, read_json_lines, read_rows, read_trees, read_tsv, read_xml, table
from tarnfold.sources.sinks import put_documents, write_chart, write_csv, write_json_document, write_json_lines, write_parquet, write_report, write_table, write_xml
from tarnfold.sources.workspace import Workspace

__all__ = [
    "Workspace", "put_documents", "read_csv", "read_database", "read_json_documents", "read_json_lines", "read_rows", "read_trees", "read_tsv", "read_xml", "table",
    "write_chart", "write_csv", "write_json_document", "write_json_lines", "write_parquet", "write_report", "write_table", "write_xml",
]
