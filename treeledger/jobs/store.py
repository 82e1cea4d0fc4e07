"""Manifests of one or several roots, as a series of snapshots.

A snapshot is one record in ``commits``: for every root a base, later changes in their order, and totals.  Each of these
*parts* is a folder written once, with the rows (stored in order of their path's hash, in small row groups) and the
digest tree over them.  A commit writes the part of one root and refers to the parts of the others, so one changed file
writes one row, and reading merges base and changes.  Nothing that is read is ever overwritten; an interrupted job
leaves the last snapshot as it was.

Records are created only if their number is free.  Who comes second tries again on top of the newest snapshot
if that has the same state of the root in question; otherwise it gets ``CommitConflict``.
"""

import hashlib
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators.hash_trees import added_trees, contributions, digest_tree, leaf_bits, path_hash, rolled_up
from ..operators.merging import latest_changes, merge_changes
from ..schemas import COMMITS, ROOTS, TREE, changes_schema, manifest_schema
from ..sources.scratch import delete_folder
from .records import RecordExists, Records

SNAPSHOT_FILE_BYTES = 256 * 1024 * 1024
ROW_BYTES = 256  # a manifest row on disk, generously
ROW_GROUP_BYTES = 8 * 1024 * 1024
MAX_CHANGES = 16  # changes of a root after which a commit writes a base again
HASH = "path_hash"


class ManifestExists(Exception):
    """A manifest was already built here: refresh it instead."""


class NoManifest(Exception):
    """There is no committed manifest here."""


class CommitConflict(Exception):
    """Another job committed a newer state of the same root: refresh again."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    @property
    def _records(self) -> Records:
        return Records(self.spark, f"{self.path}/commits")

    def staging(self, snapshot_id: int, *identity) -> str:
        """Where digests for the coming snapshot are collected until it is committed.

        ``identity`` is all that a digest depends on besides the file's path, size and times: runs
        that differ in it never take each other's digests.
        """
        name = hashlib.sha256("\0".join(map(str, identity)).encode()).hexdigest()[:32]
        return f"{self.path}/staging/snapshot_id={snapshot_id}/run={name}"

    def clear_staging(self, snapshot_id: int, *identity) -> None:
        """Delete what a run has staged.  What interrupted runs have left is for ``vacuum``."""
        delete_folder(self.spark, self.staging(snapshot_id, *identity))
        self._drop_empty("staging")

    def _listed(self, *below: str) -> list[tuple[str, int]]:
        return self._records.listed("/".join([self.path, *below]))

    def _drop_empty(self, kind: str) -> None:
        """Delete folders of snapshots that hold nothing any more."""
        for name, _ in self._listed(kind):
            if not self._listed(kind, name):
                delete_folder(self.spark, f"{self.path}/{kind}/{name}")
        if not self._listed(kind):
            delete_folder(self.spark, f"{self.path}/{kind}")

    # Commits

    def commits(self) -> DataFrame:
        """All snapshots: snapshot_id, digest, roots, files and bytes."""
        rows = []
        for number in self._records.numbers():
            record = self._records.read(number)
            if record:
                rows.append(tuple(self._shown(record)[name] for name in COMMITS.fieldNames()))
        return self.spark.createDataFrame(rows, COMMITS)

    @staticmethod
    def _shown(record: dict) -> dict:
        parts = record["parts"]
        totals = {name: sum(part[name] for part in parts.values()) for name in ("files", "bytes")}
        return {**record, "roots": list(parts), **totals}

    def latest_commit(self) -> Row | None:
        """The newest snapshot, or None: snapshot_id, digest, roots, files, bytes and the parts of each root."""
        numbers = self._records.numbers()
        return self.commit(numbers[-1]) if numbers else None

    def commit(self, snapshot_id: int) -> Row | None:
        record = self._records.read(snapshot_id)
        return Row(**self._shown(record)) if record else None

    def _commit(self, seen, root: str, state: dict | None, digest: str, replace: Sequence[str] = ()) -> int:
        """Record a new state of ``root`` (None: gone) on top of ``seen``, the snapshot it was made from; roots in
        ``replace`` go.  Returns the number of the snapshot."""
        was = seen.parts.get(root) if seen else None
        while True:
            last = self.latest_commit()
            parts = dict(last.parts) if last else {}
            same = parts.get(root) == was and all(parts.get(r) == seen.parts.get(r) for r in replace)
            if not same or (last and last.digest != digest) or (seen and not last):
                raise CommitConflict(f"{root} of {self.path} was changed by another job")
            for gone in replace:
                parts.pop(gone, None)
            if state is None:
                parts.pop(root, None)
            else:
                parts[root] = state
            number = last.snapshot_id + 1 if last else 1
            try:
                self._records.create(number, {"snapshot_id": number, "digest": digest, "parts": parts})
            except RecordExists:
                continue
            return number

    # Reading

    def _rows(self, folder: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/rows")

    def read_root(self, state: dict, digest: str, hashes: Sequence[int] | None = None) -> DataFrame:
        """The manifest of one root, with the hash of each path; only rows with these hashes, if given."""

        def chosen(df):
            return df if hashes is None else df.where(F.col(HASH).isin(list(hashes)))

        base = chosen(self._rows(state["base"], manifest_schema(digest).add(HASH, "long")))
        if not state["changes"]:
            return base
        changes = [
            chosen(self._rows(folder, changes_schema(digest).add(HASH, "long"))).withColumn("sequence", F.lit(i))
            for i, folder in enumerate(state["changes"])
        ]
        values = [*manifest_schema(digest).fieldNames()[1:], HASH]
        return merge_changes(base, latest_changes(reduce(DataFrame.unionByName, changes), values), values)

    def tree(self, state: dict) -> DataFrame:
        """The digest tree of one root (its leaves have ``state["bits"]`` bits)."""
        folders = [f"{self.path}/{folder}/tree" for folder in (state["base"], *state["changes"])]
        trees = self.spark.read.schema(TREE).parquet(*folders)
        return added_trees(trees) if state["changes"] else trees

    def read(self, commit, root: str | None = None) -> DataFrame:
        """The manifest of a commit.  Of one root, or of a store with one: its rows.  Of several: with ``prefix``."""
        columns = manifest_schema(commit.digest).fieldNames()
        roots = [root] if root is not None else list(commit.parts)
        sides = [self.read_root(commit.parts[r], commit.digest).select(*columns) for r in roots]
        if root is not None or len(roots) == 1:
            return sides[0]
        if not roots:
            return self.spark.createDataFrame([], manifest_schema(commit.digest))
        named = [side.select(F.lit(r).alias("prefix"), *columns) for r, side in zip(roots, sides)]
        return reduce(DataFrame.unionByName, named)

    def _found(self, snapshot_id: int | None):
        commit = self.latest_commit() if snapshot_id is None else self.commit(snapshot_id)
        if commit is None:
            raise NoManifest(self.path)
        return commit

    def manifest(self, snapshot_id: int | None = None, root: str | None = None) -> DataFrame:
        """A committed snapshot; the newest by default."""
        commit = self._found(snapshot_id)
        if root is not None and root not in commit.parts:
            raise NoManifest(f"{root} in {self.path}")
        return self.read(commit, root)

    def lookup(self, paths: Sequence[str], root: str | None = None, snapshot_id: int | None = None) -> DataFrame:
        """The rows of some paths.  Their hashes reach the scan, which reads only row groups that can hold them."""
        commit = self._found(snapshot_id)
        if root is None:
            if len(commit.parts) != 1:
                raise ValueError(f"name one of the roots {list(commit.parts)}")
            (root,) = commit.parts
        wanted = self.spark.createDataFrame([(p,) for p in set(paths)], "relative_path string")
        hashes = [r[0] for r in wanted.select(path_hash()).collect()]
        rows = self.read_root(commit.parts[root], commit.digest, hashes)
        return rows.join(F.broadcast(wanted), "relative_path", "left_semi").drop(HASH)

    def roots(self) -> DataFrame:
        commit = self.latest_commit()
        prefixes = commit.roots if commit else []
        return self.spark.createDataFrame([(p,) for p in prefixes], ROOTS)

    # Writing

    def _new_part(self, number: int) -> str:
        return f"snapshots/snapshot_id={number}/attempt={uuid.uuid4().hex}"

    def _write_rows(self, rows: DataFrame, folder: str, files: int | None = None) -> None:
        hashed = rows.withColumn(HASH, path_hash())
        ranged = hashed.repartitionByRange(files, HASH) if files else hashed.repartitionByRange(HASH)
        writer = ranged.sortWithinPartitions(HASH).write.option("parquet.block.size", ROW_GROUP_BYTES)
        writer.parquet(f"{self.path}/{folder}/rows")

    def _write_tree(self, tree: DataFrame, folder: str, bits: int) -> None:
        tree = tree.select(*TREE.fieldNames())
        if bits:  # by level and node, so that going down reads a part of one level at a time
            tree = tree.repartitionByRange("level", "node").sortWithinPartitions("level", "node")
        tree.write.parquet(f"{self.path}/{folder}/tree")

    def write_base(
        self, manifest: DataFrame, root: str, seen=None, digest: str = "sha512", replace: Sequence[str] = (), files: int | None = None
    ) -> int:
        """Write all rows of a root and commit them on top of the snapshot ``seen``."""
        columns = manifest_schema(digest).fieldNames()
        folder = self._new_part(seen.snapshot_id + 1 if seen else 1)
        self._write_rows(manifest.select(*columns), folder, files)
        written = self._rows(folder, manifest_schema(digest))
        total = written.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
        bits = leaf_bits(total.n)
        self._write_tree(digest_tree(written, bits, digest_col=digest), folder, bits)
        state = {"base": folder, "changes": [], "files": total.n, "bytes": total.b or 0, "bits": bits}
        return self._commit(seen, root, state, digest, replace)

    def write_changes(self, changes: DataFrame, root: str, seen) -> int:
        """Write what changed in a root (``operators.plan_changes``) and commit it on top of the snapshot ``seen``."""
        digest, was = seen.digest, seen.parts[root]
        folder = self._new_part(seen.snapshot_id + 1)
        extra = ["had", "was_size", "was_" + digest]
        self._write_rows(changes.select(*changes_schema(digest).fieldNames(), *extra), folder)
        written = self.spark.read.parquet(f"{self.path}/{folder}/rows")
        came = F.count_if(~F.col("removed") & ~F.col("had")) - F.count_if("removed")
        grown = F.sum(F.coalesce("size", F.lit(0)) - F.when(F.col("had"), F.coalesce("was_size", F.lit(0))).otherwise(0))
        total = written.agg(came.alias("n"), grown.alias("b")).first()
        old = written.where("had").select("relative_path", F.col("was_" + digest).alias(digest))
        parts = contributions(written.where("not removed"), was["bits"], digest_col=digest)
        parts = parts.unionByName(contributions(old, was["bits"], digest_col=digest, sign=-1))
        self._write_tree(rolled_up(parts, was["bits"]), folder, was["bits"])
        state = {
            **was,
            "changes": [*was["changes"], folder],
            "files": was["files"] + total.n,
            "bytes": was["bytes"] + (total.b or 0),
        }
        return self._commit(seen, root, state, digest)

    def write(self, manifest: DataFrame, snapshot_id: int, roots: Sequence[str], digest: str = "sha512") -> DataFrame:
        """Write and commit snapshot ``snapshot_id`` of the one root in ``roots``, which must be the next one."""
        (root,) = roots
        seen = self.latest_commit()
        if (seen.snapshot_id if seen else 0) + 1 != snapshot_id:
            raise CommitConflict(f"snapshot {snapshot_id} of {self.path} is not the next one")
        return self.manifest(self.write_base(manifest, root, seen, digest), root)

    def drop_root(self, root: str) -> int:
        """Commit a snapshot without a root; returns its number."""
        seen = self._found(None)
        if root not in seen.parts:
            raise NoManifest(f"{root} in {self.path}")
        return self._commit(seen, root, None, seen.digest)

    # Upkeep

    def compact(self, file_bytes: int = SNAPSHOT_FILE_BYTES) -> DataFrame:
        """Rewrite the newest snapshot: one base a root, with changes folded in, as files of about ``file_bytes``."""
        commit = self._found(None)
        for root, state in commit.parts.items():
            files = max(1, state["files"] * ROW_BYTES // file_bytes)
            self.write_base(self.read(commit, root), root, self.latest_commit(), commit.digest, files=files)
        return self.manifest()

    def expire(self, keep: int = 1) -> list[int]:
        """Withdraw all but the newest ``keep`` snapshots and delete the parts that no other refers to."""
        if keep < 1:
            raise ValueError("keep at least one snapshot")
        ids = self._records.numbers()
        if not ids:
            raise NoManifest(self.path)
        old = ids[:-keep]
        gone = set().union(*[self._parts_of(i) for i in old]) - set().union(*[self._parts_of(i) for i in ids[-keep:]])
        for snapshot_id in old:
            self._records.delete(snapshot_id)
        for folder in sorted(gone):
            delete_folder(self.spark, f"{self.path}/{folder}")
        self._drop_empty("snapshots")
        for snapshot_id in old:
            delete_folder(self.spark, f"{self.path}/staging/snapshot_id={snapshot_id}")
        return old

    def _parts_of(self, snapshot_id: int) -> set[str]:
        record = self._records.read(snapshot_id)
        states = record["parts"].values() if record else []
        return {folder for state in states for folder in (state["base"], *state["changes"])}

    def vacuum(self, older_than_hours: float = 24.0) -> list[str]:
        """Delete parts that no snapshot refers to, drafts of records, and what was staged for earlier snapshots.

        Marks what the records name and sweeps the rest.  What is younger than ``older_than_hours`` may
        belong to a running job and stays, as does what is staged for the next snapshot.  Returns what was deleted.
        """
        limit = (time.time() - older_than_hours * 3600) * 1000
        # Listed first: a part that is committed in between is then among the marked ones.
        found = [
            (f"{kind}/{number}/{one}", changed)
            for kind in ("snapshots", "staging")
            for number, _ in self._listed(kind)
            for one, changed in self._listed(kind, number)
        ]
        found += [(f"commits/{name}", changed) for name, changed in self._listed("commits") if name.startswith(".draft-")]
        ids = self._records.numbers()
        kept = set().union(*[self._parts_of(i) for i in ids])
        coming = f"staging/snapshot_id={ids[-1] + 1 if ids else 1}/"
        gone = [f for f, changed in found if f not in kept and changed <= limit and not f.startswith(coming)]
        for folder in gone:
            delete_folder(self.spark, f"{self.path}/{folder}")
        for kind in ("snapshots", "staging"):
            self._drop_empty(kind)
        return gone

    def snapshots(self) -> tuple[DataFrame, list[int]]:
        """All committed snapshots as one table with ``snapshot_id``, and their ids in order."""
        commits = [self.commit(i) for i in self._records.numbers()]
        if not commits:
            raise NoManifest(self.path)
        several = len({root for c in commits for root in c.parts}) > 1
        tables = []
        for c in commits:
            for root in c.parts:
                rows = self.read(c, root).withColumn("snapshot_id", F.lit(c.snapshot_id).cast("bigint"))
                tables.append(rows.withColumn("prefix", F.lit(root)) if several else rows)
        return reduce(DataFrame.unionByName, tables), [c.snapshot_id for c in commits]
