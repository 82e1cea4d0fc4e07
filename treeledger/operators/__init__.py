"""DataFrame to DataFrame operators."""

from .chunks import text_chunks, tree_digest
from .comparison import compare, mismatched, only_in, report, status_counts, verdict
from .hash_trees import compare_directories, counts_with_matches, differences, digest_tree, directory_digests, leaf_bits
from .merging import changes_between, latest_changes, merge_changes
from .timeline import history
from .quality import self_check, violations
from .reconciliation import reconcile, reconcile_multiset
from .planning import (
    action_counts,
    any_change,
    apply_plan,
    change_report,
    plan_changes,
    plan_refresh,
    to_hash,
)
from .sketches import reconcile_by_sketch
from .roots import merged_roots, unexpected_roots
from .summary import tree_summary

__all__ = [
    "action_counts",
    "any_change",
    "apply_plan",
    "change_report",
    "changes_between",
    "compare",
    "compare_directories",
    "counts_with_matches",
    "differences",
    "digest_tree",
    "directory_digests",
    "history",
    "latest_changes",
    "leaf_bits",
    "merge_changes",
    "merged_roots",
    "mismatched",
    "only_in",
    "plan_changes",
    "plan_refresh",
    "reconcile",
    "reconcile_by_sketch",
    "reconcile_multiset",
    "report",
    "self_check",
    "status_counts",
    "text_chunks",
    "to_hash",
    "tree_digest",
    "tree_summary",
    "unexpected_roots",
    "verdict",
    "violations",
]
