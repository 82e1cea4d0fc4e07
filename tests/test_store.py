"""The store: commits, changes beside a base, several roots, lookups and upkeep."""

import hashlib
import json
import os
import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from trees import DIFF1, DIFF2, make_tree

from treeledger.jobs import (
    CommitConflict,
    ManifestExists,
    NoManifest,
    RecordExists,
    Records,
    RootMismatch,
    Store,
    build,
    compare_stores,
    diff_stores,
    refresh,
    refresh_all,
)
from treeledger.operators import compare, history, status_counts
from treeledger.jobs import trees as jobs
from treeledger.schemas import MANIFEST


def state(df):
    return sorted((r.relative_path, r["size"], r.sha512 and bytes(r.sha512), r.bytes_hashed) for r in df.collect())


def many_files(folder, count):
    return make_tree(folder, {f"d{i % 5}/f{i}": f"content {i}".encode() for i in range(count)})


def rows_written(store):
    """Rows of every part of a store, by snapshot."""
    found = {}
    for folder, _, names in os.walk(f"{store}/snapshots"):
        if folder.endswith("/rows"):
            number = int(folder.split("snapshot_id=")[1].split("/")[0])
            rows = sum(pq.read_metadata(f"{folder}/{n}").num_rows for n in names if n.endswith(".parquet"))
            found[number] = found.get(number, 0) + rows
    return found


# --- changes beside a base


def test_one_changed_file_writes_one_row(spark, tmp_path):
    root, store = many_files(tmp_path / "t", 40), str(tmp_path / "s")
    build(spark, root, store)
    (tmp_path / "t/d1/f1").write_bytes(b"other")
    done = refresh(spark, root, store)
    assert rows_written(store) == {1: 40, 2: 1}
    os.remove(f"{root}/d2/f2")
    (tmp_path / "t/new").write_bytes(b"n")
    refresh(spark, root, store)
    assert rows_written(store) == {1: 40, 2: 1, 3: 2}
    home = Store(spark, store)
    expected = {f"d{i % 5}/f{i}": f"content {i}".encode() for i in range(40)}
    expected |= {"d1/f1": b"other", "new": b"n"}
    del expected["d2/f2"]
    assert state(home.manifest()) == sorted((p, len(c), hashlib.sha512(c).digest(), None) for p, c in expected.items())
    commit = home.latest_commit()
    assert (commit.files, commit.bytes) == (40, sum(map(len, expected.values())))
    # Earlier snapshots are as they were, and history reads all.
    assert home.manifest(1).count() == 40 and state(done.manifest) == state(home.manifest(2))
    events = {(r.snapshot_id, r.relative_path, r.event) for r in history(*home.snapshots()).collect()}
    assert events == {(2, "d1/f1", "changed"), (3, "d2/f2", "removed"), (3, "new", "added")}
    before = state(home.manifest())
    assert state(home.compact()) == before and home.latest_commit().parts[root]["changes"] == []
    assert home.expire(keep=1) == [1, 2, 3] and state(home.manifest()) == before
    assert os.listdir(f"{store}/snapshots") == ["snapshot_id=4"]


def test_expire_keeps_the_base_of_later_changes(spark, tmp_path):
    root, store = many_files(tmp_path / "t", 20), str(tmp_path / "s")
    build(spark, root, store)
    for i in range(2):
        (tmp_path / "t/d0/f0").write_bytes(b"x" * (i + 1))
        refresh(spark, root, store)
    home = Store(spark, store)
    before = state(home.manifest())
    assert home.expire(keep=1) == [1, 2]
    assert state(home.manifest()) == before and len(os.listdir(f"{store}/snapshots")) == 3


def test_many_changes_become_a_base(spark, tmp_path, monkeypatch):
    root, store = many_files(tmp_path / "t", 20), str(tmp_path / "s")
    build(spark, root, store)
    for i in range(5):
        (tmp_path / f"t/d{i}/f{i}").write_bytes(b"new")
    refresh(spark, root, store)  # a quarter of all
    assert rows_written(store) == {1: 20, 2: 20}
    monkeypatch.setattr(jobs, "MAX_CHANGES", 1)
    for i in range(2):
        (tmp_path / "t/d0/f5").write_bytes(b"y" * (i + 1))
        refresh(spark, root, store)
    assert rows_written(store) == {1: 20, 2: 20, 3: 1, 4: 20}


def test_a_file_that_cannot_be_read_changes_nothing(spark, tmp_path, monkeypatch):
    root, store = many_files(tmp_path / "t", 12), str(tmp_path / "s")
    first = state(build(spark, root, store).manifest)
    (tmp_path / "t/d0/f0").write_bytes(b"new")

    def unread(due, *args, **kwargs):
        done = due.select("relative_path", "size", "mtime_ns", "ctime_ns", F.lit(None).cast("binary").alias("sha512"))
        return done.where("false"), done.select("relative_path", F.lit("no").alias("error"))

    monkeypatch.setattr(jobs, "hash_due_files", unread)
    done = refresh(spark, root, store)
    assert state(done.manifest) == first and done.errors.count() == 1


def test_reading_merged_rows_does_not_shuffle_the_base(spark, tmp_path):
    root, store = many_files(tmp_path / "t", 40), str(tmp_path / "s")
    build(spark, root, store)
    (tmp_path / "t/d1/f1").write_bytes(b"other")
    merged = refresh(spark, root, store).manifest
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# --- commits


def test_a_record_is_created_once(spark, tmp_path):
    records, won, lost = Records(spark, str(tmp_path / "r")), [], []
    assert records.numbers() == [] and records.read(3) is None

    def write(i):
        try:
            records.create(3, {"writer": i})
            won.append(i)
        except RecordExists:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(won) == 1 and len(lost) == 11
    assert records.read(3) == {"writer": won[0]} and records.numbers() == [3]
    assert os.listdir(tmp_path / "r") == ["00000000000000000003.json"]


def test_a_record_of_another_file_system_is_created_once(spark, tmp_path, monkeypatch):
    """The way without hard links, on a file system that has both."""
    records = Records(spark, f"file://{tmp_path}/r")
    real = records._hadoop

    class Distant:
        def __init__(self, system):
            self.system = system

        def getScheme(self):
            return "distant"

        def __getattr__(self, name):
            return getattr(self.system, name)

    def hadoop(folder=None):
        holder, path, system = real(folder)
        return holder, path, Distant(system)

    monkeypatch.setattr(records, "_hadoop", hadoop)
    records.create(7, {"a": "é"})
    with pytest.raises(RecordExists):
        records.create(7, {"a": 2})
    assert records.read(7) == {"a": "é"} and records.numbers() == [7]
    assert [n for n in os.listdir(tmp_path / "r") if not n.endswith(".crc")] == ["00000000000000000007.json"]


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    root, store = many_files(tmp_path / "t", 10), str(tmp_path / "s")
    build(spark, root, store)
    home = Store(spark, store)
    seen = home.latest_commit()
    outcome = []

    def write(name):
        rows = home.manifest().withColumn("relative_path", F.concat(F.lit(name), "relative_path"))
        try:
            outcome.append((name, home.write_base(rows, root, seen)))
        except CommitConflict as error:
            outcome.append((name, error))

    threads = [threading.Thread(target=write, args=(name,)) for name in "ab"]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    (winner,) = [name for name, result in outcome if result == 2]
    assert sum(isinstance(result, CommitConflict) for _, result in outcome) == 1
    assert {r.relative_path[0] for r in home.manifest().collect()} == {winner}
    assert home.latest_commit().snapshot_id == 2
    with pytest.raises(CommitConflict):
        home.write(home.manifest(), 2, [root])


def test_two_first_builds_of_one_root(spark, tmp_path, monkeypatch):
    root, store = many_files(tmp_path / "t", 6), str(tmp_path / "s")
    real, done = Store._commit, []

    def later(self, *args, **kwargs):  # another job is done first
        if not done:
            done.append(1)
            build(spark, root, store)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(Store, "_commit", later)
    with pytest.raises(CommitConflict):
        build(spark, root, store)
    assert Store(spark, store).manifest().count() == 6


# --- several roots


def test_two_roots_in_one_store(spark, tmp_path):
    a, b, store = many_files(tmp_path / "a", 8), make_tree(tmp_path / "b", DIFF1), str(tmp_path / "s")
    build(spark, a, store)
    with pytest.raises(ManifestExists):
        build(spark, b, store)
    with pytest.raises(RootMismatch):
        refresh(spark, b, store)
    build(spark, b, store, add=True)
    with pytest.raises(ManifestExists):
        build(spark, b, store, add=True)
    home = Store(spark, store)
    assert sorted(r.prefix for r in home.roots().collect()) == sorted([a, b])
    assert home.manifest(root=a).columns == MANIFEST.fieldNames()
    assert home.manifest().columns == ["prefix", *MANIFEST.fieldNames()] and home.manifest().count() == 20
    kept = home.latest_commit().parts[b]
    (tmp_path / "a/d1/f1").write_bytes(b"x")
    done = refresh(spark, a, store)
    assert done.changed and done.manifest.count() == 8
    commit = home.latest_commit()
    assert commit.parts[b] == kept and commit.files == 20 and len(commit.parts[a]["changes"]) == 1
    assert not refresh(spark, b, store).changed
    with pytest.raises(RootMismatch):
        refresh(spark, str(tmp_path), store, allow_root_change=True)
    (tmp_path / "b/extra").write_bytes(b"e")
    results = refresh_all(spark, store)
    assert {root: r.changed for root, r in results.items()} == {a: False, b: True}
    assert home.compact().count() == 21 and not any(p["changes"] for p in home.latest_commit().parts.values())
    home.drop_root(a)
    assert home.latest_commit().roots == [b] and home.manifest().count() == 13
    with pytest.raises(NoManifest):
        home.manifest(root=a)
    with pytest.raises(NoManifest):
        home.drop_root(a)
    table, ids = home.snapshots()
    assert "prefix" in table.columns and ids == list(range(1, ids[-1] + 1))
    home.drop_root(b)
    assert home.manifest().count() == 0
    with pytest.raises(NoManifest):
        refresh(spark, b, store)
    build(spark, b, store)
    assert home.latest_commit().roots == [b]


def test_a_commit_of_another_root_in_between_is_no_conflict(spark, tmp_path, monkeypatch):
    a, b, store = many_files(tmp_path / "a", 8), many_files(tmp_path / "b", 9), str(tmp_path / "s")
    build(spark, a, store)
    build(spark, b, store, add=True)
    for name in "ab":
        (tmp_path / name / "d1/f1").write_bytes(b"x")
    real, done = Store._commit, []

    def later(self, *args, **kwargs):
        if not done:
            done.append(1)
            refresh(spark, b, store)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(Store, "_commit", later)
    assert refresh(spark, a, store).snapshot_id == 4
    parts = Store(spark, store).latest_commit().parts
    assert [len(parts[root]["changes"]) for root in (a, b)] == [1, 1]


def test_stores_with_several_roots_compare_root_by_root(spark, tmp_path):
    folders = {name: make_tree(tmp_path / name, tree) for name, tree in {"a1": DIFF1, "b1": DIFF1, "a2": DIFF2, "b2": DIFF1}.items()}
    left, right = str(tmp_path / "left"), str(tmp_path / "right")
    for store, names in ((left, ("a1", "b1")), (right, ("a2", "b2"))):
        build(spark, folders[names[0]], store)
        build(spark, folders[names[1]], store, add=True)
    roots = {folders["a1"]: folders["a2"], folders["b1"]: folders["b2"]}
    compared = compare_stores(spark, left, right, roots)
    counts = {(r.prefix, r.status): r["count"] for r in compared.groupBy("prefix", "status").count().collect()}
    a, b = folders["a1"], folders["b1"]
    assert counts == {(a, "match"): 6, (a, "mismatch"): 5, (a, "only_left"): 1, (a, "only_right"): 1, (b, "match"): 12}
    assert {r.status for r in compare_stores(spark, left, right).collect()} == {"only_left", "only_right"}
    found = diff_stores(spark, left, right, a, folders["a2"])
    assert {r.status: r.files for r in found.counts.collect()} == {"match": 6, "mismatch": 5, "only_left": 1, "only_right": 1}
    with pytest.raises(ValueError):
        diff_stores(spark, left, right)


# --- comparing by trees, lookups, upkeep


def test_stores_differ_as_their_manifests_do(spark, tmp_path):
    root, left, right = many_files(tmp_path / "t", 60), str(tmp_path / "l"), str(tmp_path / "r")
    build(spark, root, left)
    build(spark, root, right)
    same = diff_stores(spark, left, right)
    assert same.rows.count() == 0 and [tuple(r) for r in same.counts.collect()] == [("match", 60)]
    (tmp_path / "t/d1/f1").write_bytes(b"x")
    os.remove(f"{root}/d2/f2")
    (tmp_path / "t/more").write_bytes(b"m")
    refresh(spark, root, right)
    for _ in range(2):  # with changes beside the base, and folded in
        found = diff_stores(spark, left, right)
        compared = compare(Store(spark, left).manifest(), Store(spark, right).manifest())
        assert sorted(map(tuple, found.rows.collect())) == [("d1/f1", "mismatch"), ("d2/f2", "only_left"), ("more", "only_right")]
        assert sorted(map(tuple, found.counts.collect())) == sorted(map(tuple, status_counts(compared).collect()))
        Store(spark, right).compact()


def big_store(spark, path, count=60_000):
    """A store of that many rows, in small row groups."""
    name = F.concat(F.lit("some/long/folder/name/"), F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(count).select(
        name.alias("relative_path"), F.col("id").alias("size"), F.col("id").alias("mtime_ns"), F.col("id").alias("ctime_ns"),
        F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("sha512"), F.lit(None).cast("bigint").alias("bytes_hashed"),
    )
    home = Store(spark, path)
    home.write(rows, 1, ["/r"])
    return home


def test_large_stores_with_ten_changes_read_few_leaves(spark, tmp_path):
    left, right = big_store(spark, str(tmp_path / "l")), big_store(spark, str(tmp_path / "r"))
    changed = right.manifest().where("size < 10").withColumn("sha512", F.lit(b"\1" * 64))
    old = right.manifest().select("relative_path", F.col("size").alias("was_size"), F.col("sha512").alias("was_sha512"))
    changes = changed.join(old, "relative_path").withColumns({"removed": F.lit(False), "had": F.lit(True)})
    right.write_changes(changes, "/r", right.latest_commit())
    found = diff_stores(spark, left.path, right.path)
    assert {r.status: r.files for r in found.counts.collect()} == {"match": 59_990, "mismatch": 10}
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "path_hash" in plan.split("PushedFilters")[1]
    assert left.latest_commit().parts["/r"]["bits"] == 8


def test_lookup_reads_the_row_groups_that_can_match(spark, tmp_path):
    home = big_store(spark, str(tmp_path / "s"))
    (state,) = home.latest_commit().parts.values()
    some = [r.relative_path for r in home.manifest().where("size in (5, 40000)").collect()]
    found = home.lookup([*some, "not there"])
    assert sorted(r["size"] for r in found.collect()) == [5, 40_000]
    hashes = {r[0] for r in home.lookup(some).select(F.xxhash64("relative_path")).collect()}
    groups = matching = 0
    folder = f"{home.path}/{state['base']}/rows"
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            meta = pq.read_metadata(f"{folder}/{name}")
            at = meta.schema.names.index("path_hash")
            for i in range(meta.num_row_groups):
                stats = meta.row_group(i).column(at).statistics
                groups += 1
                matching += any(stats.min <= h <= stats.max for h in hashes)
    assert groups >= 4 and matching <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(path_hash" in plan or "EqualTo(path_hash" in plan
    assert home.lookup([]).count() == 0


def test_vacuum_deletes_what_no_snapshot_names(spark, tmp_path, monkeypatch):
    root, store = many_files(tmp_path / "t", 10), str(tmp_path / "s")
    home = Store(spark, store)

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(Store, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            build(spark, root, store)
    assert home.latest_commit() is None and os.listdir(f"{store}/snapshots") == ["snapshot_id=1"]
    assert home.vacuum() == []  # it may still be running
    build(spark, root, store)
    before = state(home.manifest())
    os.makedirs(f"{store}/staging/snapshot_id=1/run=old/batch=x")
    os.makedirs(f"{store}/staging/snapshot_id=2/run=next/batch=x")
    (tmp_path / "s/commits/.draft-1").write_text("{")
    assert home.vacuum() == []
    gone = home.vacuum(older_than_hours=-1)
    assert sorted(name.split("/")[0] for name in gone) == ["commits", "snapshots", "staging"]
    assert state(home.manifest()) == before
    assert os.listdir(f"{store}/staging") == ["snapshot_id=2"]
    assert len(os.listdir(f"{store}/snapshots/snapshot_id=1")) == 1
    assert home.vacuum(older_than_hours=-1) == []


def test_a_record_is_plain_json(spark, tmp_path):
    root, store = many_files(tmp_path / "t", 3), str(tmp_path / "s")
    build(spark, root, store)
    (name,) = os.listdir(f"{store}/commits")
    record = json.loads((tmp_path / "s/commits" / name).read_text())
    assert record["snapshot_id"] == 1 and list(record["parts"]) == [root]
    rows = Store(spark, store).commits().collect()
    assert [(r.snapshot_id, r.roots, r.digest, r.files) for r in rows] == [(1, [root], "sha512", 3)]
