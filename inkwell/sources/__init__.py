"""Where documents and points come from and go to."""

from inkwell.sources.files import Strategies, Strategy, export_chunks, new_files, read_chunks, scan_files, valid_chunks
from inkwell.sources.store import ConflictError, PointStore, Table, load_hashes, load_status
from inkwell.sources.tables import read_table

__all__ = [
    "ConflictError",
    "PointStore",
    "Strategies",
    "Strategy",
    "Table",
    "export_chunks",
    "load_hashes",
    "load_status",
    "new_files",
    "read_chunks",
    "read_table",
    "scan_files",
    "valid_chunks",
]
