"""Building, refreshing and comparing manifests of file trees."""

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.chunks import FAN_OUT
from ..operators.comparison import compare
from ..operators.hash_trees import counts_with_matches, differences
from ..operators.planning import apply_plan, plan_changes, plan_refresh, to_hash
from ..operators.quality import self_check
from ..operators.roots import unexpected_roots
from ..schemas import DELETE_ACTIONS, DIGESTS, HASH_ACTIONS, ROOTS, manifest_schema
from ..sources.content import CHUNK_BYTES
from ..sources.scratch import delete_folder, fresh_folder, materialise
from ..sources.tree import list_errors, recorded_root, scan_tree, still_present
from .hashing import hash_due_chunks, hash_due_files
from .store import HASH, MAX_CHANGES, ManifestExists, NoManifest, Store


class CorruptManifest(Exception):
    """The manifest fails its self-check."""


class RootMismatch(Exception):
    """The manifest was taken from another root; refreshing would drop its rows."""


@dataclass(frozen=True)
class Refreshed:
    plan: DataFrame
    listing: DataFrame
    errors: DataFrame
    changed: bool
    snapshot_id: int | None  # the snapshot that is now the newest; None after a dry run
    manifest: DataFrame | None  # of the root that was refreshed
    work: str

    def discard(self) -> None:
        """Delete the tables that plan, listing and errors are read from."""
        delete_folder(self.plan.sparkSession, self.work)


def build(
    spark: SparkSession, root: str, store: str, digest: str = "sha512", add: bool = False, **options
) -> Refreshed:
    """Make the first manifest of ``root``; refuses when one exists.  Options as in ``refresh``.

    ``add=True`` makes it one more root of a store that has others, which keep their rows (all have the
    same digest).  ``digest="tree_sha512"`` hashes files in chunks, so that a file holding a
    large part of all bytes is hashed by many tasks; refreshes then do the same.
    """
    if digest not in DIGESTS:
        raise ValueError(f"digest must be one of {DIGESTS}")
    home = Store(spark, store)
    last = home.latest_commit()
    if last is not None and last.parts and (not add or recorded_root(root) in last.parts):
        raise ManifestExists(store)
    if last is not None and last.digest != digest:
        raise ValueError(f"the manifests here hold {last.digest}")
    return _run(home, root, last, digest, adding=True, **options)


def refresh(spark: SparkSession, root: str, store: str, **options) -> Refreshed:
    """Bring the manifest of ``root`` up to date, reading only files that need it.  Other roots of the store
    stay as they are.

    ignore, include: patterns; maxdepth: how deep to look; clean_ignored: also
    drop recorded paths that are ignored; allow_root_change: accept another
    root than the saved one (of a store with one root); mode: "incremental" or "full"; run_id: a name for a full
    run: given again after an interruption, the run goes on with what it had hashed
    (a full run without one reads every file); dry_run: plan only;
    batch_bytes: how much to hash between commits of the staging table (by default
    16 GiB per core).

    What changed is written beside the rows of earlier snapshots; all rows are written anew where a quarter of
    them or more have changed, or after 16 such commits.  Raises CommitConflict if another job has committed a newer
    state of the root in between.
    """
    home = Store(spark, store)
    last = home.latest_commit()
    if last is None or not last.parts:
        raise NoManifest(store)
    return _run(home, root, last, last.digest, **options)


def refresh_all(spark: SparkSession, store: str, **options) -> dict[str, Refreshed]:
    """Refresh every root of a store, one after the other, each with a commit of its own."""
    last = Store(spark, store).latest_commit()
    if last is None or not last.parts:
        raise NoManifest(store)
    return {root: refresh(spark, root, store, **options) for root in last.parts}


def checked(manifest: DataFrame, digest: str) -> DataFrame:
    """The manifest itself, after its self-check."""
    result = self_check(manifest, digest).first()
    if not result.ok:
        raise CorruptManifest(str(result.asDict()))
    return manifest


def _replaced(home: Store, last, given: str, allow_root_change: bool) -> list[str]:
    """The saved roots that a refresh of ``given`` replaces: none where it is one of them."""
    wanted, saved = home.spark.createDataFrame([(given,)], ROOTS), home.roots()
    if unexpected_roots(wanted, saved).isEmpty():
        return []
    others = sorted(row.prefix for row in unexpected_roots(saved, wanted).collect())
    if not allow_root_change:
        raise RootMismatch(f"saved {others}, given {given}")
    if len(others) > 1:
        raise RootMismatch(f"{given} cannot take the place of {others}: build it with add=True, or drop them")
    return others


def _run(
    home: Store,
    root: str,
    last,
    digest: str,
    *,
    adding: bool = False,
    ignore: Sequence[str] = (),
    include: Sequence[str] = (),
    maxdepth: int | None = None,
    clean_ignored: bool = False,
    allow_root_change: bool = False,
    mode: str = "incremental",
    run_id: str | None = None,
    dry_run: bool = False,
    batch_bytes: int | None = None,
) -> Refreshed:
    spark, given = home.spark, recorded_root(root)
    replaced = [] if adding else _replaced(home, last, given, allow_root_change)
    if adding:
        saved, state = spark.createDataFrame([], manifest_schema(digest)), None
    else:
        saved_root = replaced[0] if replaced else given
        saved, state = checked(home.read(last, saved_root), digest), last.parts[saved_root]

    work = fresh_folder(spark)
    listing = scan_tree(spark, root, folder=f"{work}/scan")
    unmet = saved.select("relative_path").join(listing, "relative_path", "left_anti")
    found = listing if adding else listing.unionByName(still_present(unmet, root))
    plan = plan_refresh(
        found, saved, ignore=ignore, include=include, maxdepth=maxdepth,
        clean_ignored=clean_ignored, mode=mode, digest_col=digest,
    )
    plan = materialise(plan, f"{work}/plan")
    due = plan.agg(F.count_if(F.col("action").isin(*HASH_ACTIONS, *DELETE_ACTIONS)).alias("n")).first().n
    if dry_run:
        return Refreshed(plan, listing, list_errors(listing), due > 0, None, None, work)
    if not adding and not due and not replaced:
        return Refreshed(plan, listing, list_errors(listing), False, last.snapshot_id, saved, work)

    snapshot_id = last.snapshot_id + 1 if last else 1
    if mode == "full" and run_id is None:
        run_id = uuid.uuid4().hex
    run = (given, digest, CHUNK_BYTES, FAN_OUT, mode, run_id or "")
    hash_due = hash_due_files if digest == "sha512" else hash_due_chunks
    hashed, failed = hash_due(to_hash(plan), root, home.staging(snapshot_id, *run), batch_bytes=batch_bytes)
    per_file = failed.groupBy("relative_path").agg(F.max("error").alias("error"))
    failed = materialise(per_file, f"{work}/failed")
    if adding or replaced or len(state["changes"]) >= MAX_CHANGES or 4 * due >= state["files"]:
        new = apply_plan(plan, hashed, digest_col=digest)
        number = home.write_base(new, given, last, digest, replaced)
    else:
        number = home.write_changes(plan_changes(plan, hashed, digest_col=digest), given, last)
    home.clear_staging(snapshot_id, *run)
    hash_errors = failed.select("relative_path", F.lit("hash").alias("stage"), "error")
    errors = list_errors(listing).unionByName(hash_errors)
    return Refreshed(plan, listing, errors, due > 0, number, home.manifest(number, given), work)


def _newest(spark: SparkSession, left: str, right: str) -> tuple[list[Store], list, str]:
    """Stores, newest commits and digest of two stores that can be compared."""
    homes = [Store(spark, path) for path in (left, right)]
    commits = [home.latest_commit() for home in homes]
    for home, commit in zip(homes, commits):
        if commit is None or not commit.parts:
            raise NoManifest(home.path)
    digest = commits[0].digest
    if commits[1].digest != digest:
        raise ValueError(f"digests cannot be compared: {digest} and {commits[1].digest}")
    return homes, commits, digest


def compare_stores(
    spark: SparkSession, left: str, right: str, roots: Mapping[str, str] | None = None
) -> DataFrame:
    """Compare the newest manifests of two stores, each after its self-check.

    With several roots in either store, paths are compared per root (``prefix``, as the left store names it):
    ``roots`` says which root of the left store is which of the right one; others go by their own name.
    """
    homes, commits, digest = _newest(spark, left, right)
    if all(len(commit.parts) == 1 for commit in commits):
        sides = [checked(home.read(commit), digest) for home, commit in zip(homes, commits)]
        return compare(*sides, digest_col=digest)
    names = {theirs: ours for ours, theirs in (roots or {}).items()}
    sides = []
    for home, commit, renamed in zip(homes, commits, ({}, names)):
        for root in commit.parts:
            side = checked(home.read(commit, root), digest)
            sides.append((renamed is names, side.select(F.lit(renamed.get(root, root)).alias("prefix"), "relative_path", digest)))
    both = [reduce(DataFrame.unionByName, [side for right, side in sides if right is which]) for which in (False, True)]
    return compare(*both, key_cols=("prefix", "relative_path"), digest_col=digest)


@dataclass(frozen=True)
class Differences:
    rows: DataFrame  # relative_path and status of all that is not a match
    counts: DataFrame  # status and files, matches included


def diff_stores(
    spark: SparkSession, left: str, right: str, left_root: str | None = None, right_root: str | None = None
) -> Differences:
    """How the newest manifests of one root in each of two stores differ, by their digest trees.

    Only leaves that are unlike, or hold unfinished rows, are read: with few differences, few row groups of each
    store.  Rows are not checked again; ``compare_stores`` does that.
    """
    homes, commits, digest = _newest(spark, left, right)
    rows, trees, bits = [], [], []
    for home, commit, root in zip(homes, commits, (left_root, right_root)):
        if root is None and len(commit.parts) != 1:
            raise ValueError(f"name one of the roots {list(commit.parts)} of {home.path}")
        state = commit.parts[root if root is not None else next(iter(commit.parts))]
        rows.append(home.read_root(state, digest))
        trees.append(home.tree(state))
        bits.append(state["bits"])
    found = differences(*rows, *trees, min(bits), digest_col=digest, hash_col=HASH)
    return Differences(found, counts_with_matches(found, trees[0]))
