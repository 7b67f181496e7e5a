"""Where tables come from."""

from tallyframe.sources.base import Source
from tallyframe.sources.files import CsvSource, ExcelSource, ParquetSource, open_source
from tallyframe.sources.sql import JdbcSource, SqliteSource, open_connection
from tallyframe.sources.urls import connection_url

__all__ = ["CsvSource", "ExcelSource", "JdbcSource", "ParquetSource", "Source", "SqliteSource", "connection_url", "open_connection", "open_source"]
