import hashlib
import os

import pytest
from pyspark.sql import functions as F
from trees import DIFF1, DIFF2, FOUR_LEVELS, SPACE, make_tree

from treeledger.jobs import (
    CorruptManifest,
    ManifestExists,
    NoManifest,
    RootMismatch,
    Store,
    build,
    compare_stores,
    refresh,
)
from treeledger.operators import history, status_counts, tree_summary, verdict


def actions(plan):
    return {r.relative_path: r.action for r in plan.collect()}


def paths(df):
    return sorted(r.relative_path for r in df.collect())


@pytest.fixture
def diff1(tmp_path):
    return make_tree(tmp_path / "diff1", DIFF1)


@pytest.fixture
def diffs(tmp_path):
    make_tree(tmp_path / "diffs" / "diff1", DIFF1)
    make_tree(tmp_path / "diffs" / "diff2", DIFF2)
    return str(tmp_path / "diffs")


def test_build_and_compare(spark, tmp_path, diff1):
    diff2 = make_tree(tmp_path / "diff2", DIFF2)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    first = build(spark, diff1, a)
    build(spark, diff2, b)
    saved = {r.relative_path: bytes(r.sha512) for r in first.manifest.collect()}
    assert saved == {p: hashlib.sha512(c).digest() for p, c in DIFF1.items()}
    compared = compare_stores(spark, a, b)
    counts = {r.status: r.files for r in status_counts(compared).collect()}
    assert counts == {"match": 6, "mismatch": 5, "only_left": 1, "only_right": 1}
    assert paths(compared.where("status = 'only_right'")) == ["path1/AAA/BCB/CCC/b.txt"]
    assert paths(compared.where("status = 'only_left'")) == ["path2/AAA/ZAW/D/e/f/b_file.txt"]
    row = verdict(compared).first()
    assert (row.files_identical, row.checksums_identical, row.equal) == (False, False, False)
    assert verdict(compare_stores(spark, a, a)).first().equal


def test_tree_summary_counts_the_root(spark, diff1, tmp_path):
    built = build(spark, diff1, str(tmp_path / "s"), dry_run=True)
    row = tree_summary(built.listing).first()
    assert (row.total_size, row.total_size_text) == (45, "45B")
    assert (row.total_items, row.dirs, row.files, row.symlinks) == (58, 46, 12, 0)


def test_refresh_after_changes(spark, diff1, tmp_path):
    store = str(tmp_path / "s")
    with pytest.raises(NoManifest):
        refresh(spark, diff1, store)
    build(spark, diff1, store)
    with pytest.raises(ManifestExists):
        build(spark, diff1, store)
    with open(f"{diff1}/1/AAA/BCB/CCC/a.txt", "ab") as f:
        f.write(SPACE * 2)
    open(f"{diff1}/1/AAA/BCB/CCC/c.txt", "wb").close()
    os.remove(f"{diff1}/path2/AAA/ZAW/D/e/f/b_file.txt")

    dry = refresh(spark, diff1, store, dry_run=True)
    assert dry.changed and Store(spark, store).latest_commit().snapshot_id == 1
    done = refresh(spark, diff1, store)
    for result in (dry, done):
        rows = {r.relative_path: r for r in result.plan.collect()}
        changed = rows.pop("1/AAA/BCB/CCC/a.txt")
        assert (changed.action, changed.change_mask) == ("CHANGED", 7)
        assert changed.change_label == "size & ctime & mtime"
        added = rows.pop("1/AAA/BCB/CCC/c.txt")
        assert (added.action, added.change_mask) == ("ADD", -1)
        gone = rows.pop("path2/AAA/ZAW/D/e/f/b_file.txt")
        assert (gone.action, gone.change_mask) == ("DELETE_MISSING", -1)
        assert {(r.action, r.change_mask) for r in rows.values()} == {("KEEP", 0)}
        assert len(rows) == 10
    saved = {r.relative_path: r for r in done.manifest.collect()}
    assert len(saved) == 12 and sum(r["size"] for r in saved.values()) == 43
    assert bytes(saved["1/AAA/BCB/CCC/c.txt"].sha512) == hashlib.sha512(b"").digest()
    assert bytes(saved["1/AAA/BCB/CCC/a.txt"].sha512) == hashlib.sha512(SPACE * 8).digest()

    again = refresh(spark, diff1, store)
    assert not again.changed and again.snapshot_id == done.snapshot_id == 2
    assert set(actions(again.plan).values()) == {"KEEP"}

    table, ids = Store(spark, store).snapshots()
    events = {(r.snapshot_id, r.relative_path, r.event) for r in history(table, ids).collect()}
    assert events == {
        (2, "1/AAA/BCB/CCC/a.txt", "changed"),
        (2, "1/AAA/BCB/CCC/c.txt", "added"),
        (2, "path2/AAA/ZAW/D/e/f/b_file.txt", "removed"),
    }


@pytest.mark.parametrize(
    "maxdepth, expected",
    [
        (0, ["sss.txt"]),
        (1, ["AAA/tttt.txt", "sss.txt"]),
        (2, ["AAA/BBB/uuu.txt", "AAA/tttt.txt", "sss.txt"]),
        (3, sorted(FOUR_LEVELS)),
    ],
)
def test_maxdepth(spark, tmp_path, maxdepth, expected):
    root = make_tree(tmp_path / "4", FOUR_LEVELS)
    plan = build(spark, root, str(tmp_path / "s"), maxdepth=maxdepth, dry_run=True).plan
    assert paths(plan) == expected


def test_refresh_keeps_rows_deeper_than_maxdepth(spark, tmp_path):
    root, store = make_tree(tmp_path / "4", FOUR_LEVELS), str(tmp_path / "s")
    build(spark, root, store)
    os.remove(f"{root}/AAA/BBB/uuu.txt")
    done = refresh(spark, root, store, maxdepth=0)
    assert actions(done.plan) == {
        "AAA/BBB/CCC/a.txt": "KEEP",
        "AAA/BBB/uuu.txt": "DELETE_MISSING",
        "AAA/tttt.txt": "KEEP",
        "sss.txt": "KEEP",
    }


def test_ignore_while_building(spark, diffs, tmp_path):
    found = actions(build(spark, diffs, str(tmp_path / "s"), ignore=["diff2/1/.*"]).plan)
    assert list(found.values()).count("ADD") == 21
    assert sorted(p for p, a in found.items() if a == "IGNORED") == [
        "diff2/1/AAA/BCB/CCC/a.txt",
        "diff2/1/AAA/ZAW/A/b/c/a_file.txt",
        "diff2/1/AAA/ZAW/D/e/f/b_file.txt",
    ]


def test_clean_ignored_with_and_without_include(spark, diffs, tmp_path):
    store = str(tmp_path / "s")
    build(spark, diffs, store)
    kept = refresh(spark, diffs, store, ignore=["diff2/1/.*"])
    assert not kept.changed
    first = refresh(
        spark, diffs, store, ignore=["diff2/1/.*", "diff2/2/.*"], clean_ignored=True, dry_run=True
    )
    assert paths(first.plan.where("action = 'DELETE_IGNORED'")) == [
        "diff2/1/AAA/BCB/CCC/a.txt",
        "diff2/1/AAA/ZAW/A/b/c/a_file.txt",
        "diff2/1/AAA/ZAW/D/e/f/b_file.txt",
        "diff2/2/AAA/BBB/CZC/a.txt",
    ]
    second = refresh(
        spark,
        diffs,
        store,
        ignore=["^.*/path2/.*", "diff2/.*"],
        include=["diff2/1/AAA/ZAW/A/b/c/.*", "diff2/path1/AAA/ZAW/.*"],
        clean_ignored=True,
    )
    assert paths(second.plan.where("action = 'DELETE_IGNORED'")) == [
        "diff1/path2/AAA/BCB/CCC/a.txt",
        "diff1/path2/AAA/ZAW/A/b/c/a_file.txt",
        "diff1/path2/AAA/ZAW/D/e/f/b_file.txt",
        "diff2/1/AAA/BCB/CCC/a.txt",
        "diff2/1/AAA/ZAW/D/e/f/b_file.txt",
        "diff2/2/AAA/BBB/CZC/a.txt",
        "diff2/3/AAA/BBB/CCC/a.txt",
        "diff2/4/AAA/BBB/CCC/a.txt",
        "diff2/path1/AAA/BCB/CCC/a.txt",
        "diff2/path1/AAA/BCB/CCC/b.txt",
        "diff2/path2/AAA/BCB/CCC/a.txt",
        "diff2/path2/AAA/ZAW/A/b/c/a_file.txt",
    ]
    assert second.manifest.count() == 12


def test_root_change_is_guarded(spark, diff1, tmp_path):
    other, store = make_tree(tmp_path / "other", {"x": b"x"}), str(tmp_path / "s")
    build(spark, diff1, store)
    with pytest.raises(RootMismatch):
        refresh(spark, other, store)
    moved = refresh(spark, other, store, allow_root_change=True)
    assert paths(moved.manifest) == ["x"]
    assert [r.prefix for r in Store(spark, store).roots().collect()] == [other]


def test_full_mode_sees_content_changed_under_the_same_metadata(spark, tmp_path):
    root, store = make_tree(tmp_path / "t", {"a": b"aaa", "b": b"bbb"}), str(tmp_path / "s")
    built = build(spark, root, store)
    tampered = built.manifest.withColumn("sha512", F.unhex(F.sha2(F.lit("before"), 512)))
    Store(spark, store).write(tampered, 2, [root])
    assert not refresh(spark, root, store).changed
    full = refresh(spark, root, store, mode="full")
    assert actions(full.plan) == {"a": "REHASH", "b": "REHASH"}
    saved = {r.relative_path: bytes(r.sha512) for r in full.manifest.collect()}
    assert saved["a"] == hashlib.sha512(b"aaa").digest()


def test_corrupt_manifest_is_refused(spark, diff1, tmp_path):
    store = str(tmp_path / "s")
    built = build(spark, diff1, store)
    Store(spark, store).write(built.manifest.union(built.manifest), 2, [diff1])
    with pytest.raises(CorruptManifest):
        refresh(spark, diff1, store)


def test_discard_leaves_the_store_alone(spark, diff1, tmp_path):
    built = build(spark, diff1, str(tmp_path / "s"))
    assert os.path.isdir(built.work)
    built.discard()
    assert not os.path.exists(built.work)
    assert built.manifest.count() == 12 and sorted(os.listdir(tmp_path / "s")) == ["commits", "snapshots"]


def test_compact_and_expire(spark, diff1, tmp_path):
    store = str(tmp_path / "s")
    before = paths(build(spark, diff1, store).manifest)
    home = Store(spark, store)
    home.compact()
    assert paths(home.manifest()) == before and home.latest_commit().snapshot_id == 2
    assert home.expire(keep=1) == [1]
    assert paths(home.manifest()) == before
    with pytest.raises(NoManifest):
        home.manifest(1)
    assert os.listdir(f"{store}/snapshots") == ["snapshot_id=2"]


def test_manifests_of_chunk_digests(spark, diff1, tmp_path):
    a, b, plain = (str(tmp_path / name) for name in ("a", "b", "plain"))
    diff2 = make_tree(tmp_path / "diff2", DIFF2)
    with pytest.raises(ValueError):
        build(spark, diff1, a, digest="md5")
    first = build(spark, diff1, a, digest="tree_sha512")
    saved = {r.relative_path: bytes(r.tree_sha512) for r in first.manifest.collect()}
    assert saved == {p: hashlib.sha512(hashlib.sha512(c).digest()).digest() for p, c in DIFF1.items()}
    build(spark, diff2, b, digest="tree_sha512")
    counts = {r.status: r.files for r in status_counts(compare_stores(spark, a, b)).collect()}
    assert counts == {"match": 6, "mismatch": 5, "only_left": 1, "only_right": 1}
    build(spark, diff1, plain)
    with pytest.raises(ValueError):
        compare_stores(spark, a, plain)
    with open(f"{diff1}/1/AAA/BCB/CCC/a.txt", "ab") as f:
        f.write(SPACE)
    again = refresh(spark, diff1, a)
    assert again.snapshot_id == 2 and again.manifest.columns == first.manifest.columns
    changed = {r.relative_path: bytes(r.tree_sha512) for r in again.manifest.collect()}
    assert {p for p in saved if saved[p] != changed[p]} == {"1/AAA/BCB/CCC/a.txt"}


def test_a_root_is_recorded_alike_with_and_without_scheme(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    root.mkdir()
    (root / "a").write_text("a")
    build(spark, f"file://{root}", store)
    monkeypatch.chdir(tmp_path)
    assert not refresh(spark, str(root), store).changed
    assert not refresh(spark, "tree", store).changed


@pytest.mark.parametrize("run_id", [None, "audit"])
def test_a_full_run_takes_only_digests_it_is_told_to_resume(spark, tmp_path, monkeypatch, run_id):
    root, store = make_tree(tmp_path / "t", {"a": b"one"}), str(tmp_path / "s")
    build(spark, root, store)

    def interrupted(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(Store, "_commit", interrupted)
        with pytest.raises(KeyboardInterrupt):
            refresh(spark, root, store, mode="full", run_id=run_id)
    # What was staged is marked, to see whether it is taken.
    (left,) = (tmp_path / "s" / "staging" / "snapshot_id=2").glob("run=*")
    staged = spark.read.parquet(str(left)).drop("batch").withColumn("sha512", F.lit(b"\1" * 64))
    rows = spark.createDataFrame(staged.collect(), staged.schema)
    rows.write.mode("overwrite").parquet(f"{left}/{next(left.glob('batch=*')).name}")
    full = refresh(spark, root, store, mode="full", run_id=run_id)
    saved = bytes(full.manifest.first().sha512)
    assert saved == (hashlib.sha512(b"one").digest() if run_id is None else b"\1" * 64)


def test_staging_is_kept_apart_by_all_that_a_digest_depends_on(spark, tmp_path):
    home = Store(spark, str(tmp_path))
    runs = [("/a", "sha512", 1), ("/b", "sha512", 1), ("/a", "tree_sha512", 1), ("/a", "sha512", 2)]
    assert len({home.staging(1, *run) for run in runs}) == len(runs)
    assert home.staging(1, *runs[0]) == home.staging(1, *runs[0])
