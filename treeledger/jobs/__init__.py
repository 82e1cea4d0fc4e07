"""End-to-end jobs on file trees."""

from .hashing import hash_due_chunks, hash_due_files
from .trees import (
    CorruptManifest,
    Differences,
    Refreshed,
    RootMismatch,
    build,
    compare_stores,
    diff_stores,
    refresh,
    refresh_all,
)
from .records import RecordExists, Records
from .store import CommitConflict, ManifestExists, NoManifest, Store

__all__ = [
    "CommitConflict",
    "CorruptManifest",
    "Differences",
    "ManifestExists",
    "NoManifest",
    "RecordExists",
    "Records",
    "Refreshed",
    "RootMismatch",
    "Store",
    "build",
    "compare_stores",
    "diff_stores",
    "hash_due_chunks",
    "hash_due_files",
    "refresh",
    "refresh_all",
]
