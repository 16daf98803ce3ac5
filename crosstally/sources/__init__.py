from .binding import bind_filter, bind_sql, inline_sql, needs_window
from .documents import extract_documents, filter_column, path_column, read_json_documents
from .extract import extract, select_side, statement_of, stored_statement
from .files import (
    FileTable,
    column_names,
    matching_files,
    parse_workbooks,
    read_csv_table,
    read_file_table,
    read_xlsx_table,
)

__all__ = [
    "FileTable",
    "bind_filter",
    "bind_sql",
    "column_names",
    "extract",
    "extract_documents",
    "filter_column",
    "inline_sql",
    "matching_files",
    "needs_window",
    "parse_workbooks",
    "path_column",
    "read_csv_table",
    "read_file_table",
    "read_json_documents",
    "read_xlsx_table",
    "select_side",
    "statement_of",
    "stored_statement",
]
