"""File trees and file content, read on the executors."""

from .content import file_chunks, hash_chunks, hash_files
from .tree import list_errors, scan_tree, still_present

__all__ = [
    "file_chunks",
    "hash_chunks",
    "hash_files",
    "list_errors",
    "scan_tree",
    "still_present",
]
