import hashlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from trees import make_tree

from treeledger.jobs import hash_due_chunks, hash_due_files, refresh, build
from treeledger.operators.chunks import FAN_OUT
from treeledger.sources import hash_files, list_errors, scan_tree, still_present
from treeledger.sources import content, tree


def walk(root):
    found = {}
    for here, dirs, files in os.walk(os.fsencode(root)):
        for name in dirs + files:
            full = os.path.join(here, name)
            found[os.path.relpath(full, os.fsencode(root))] = os.lstat(full)
    return found


def collected(df):
    return df.withColumn("relative_path", F.col("relative_path").cast("binary")).collect()


@pytest.fixture
def odd_tree(tmp_path):
    root = tmp_path / "odd"
    files = {
        ".hidden": b"h",
        "_under": b"u",
        ".dir/_x": b"x",
        "with space": b"s",
        "per%20cent": b"p",
        "new\nline": b"n",
        "ret\rurn": b"r",
        "naïve/日本": b"j",
        "empty": b"",
    }
    make_tree(root, files)
    (root / "empty_dir").mkdir()
    (root / "live").symlink_to("empty")
    (root / "live_dir").symlink_to(".dir")
    (root / "dangling").symlink_to("nowhere")
    os.mkfifo(root / "fifo")
    for name in (b"bad\xff", b"bad\xfe"):
        with open(os.path.join(os.fsencode(root), name), "wb") as f:
            f.write(name)
    return str(root)


def test_scan_finds_what_walk_finds(spark, odd_tree):
    rows = {bytes(r.relative_path): r for r in collected(scan_tree(spark, odd_tree))}
    expected = walk(odd_tree)
    assert set(rows) == set(expected)
    for path, row in rows.items():
        s = expected[path]
        assert (row["size"], row.mtime_ns, row.ctime_ns) == (s.st_size, s.st_mtime_ns, s.st_ctime_ns)
        assert row.depth == path.count(b"/") and row.error is None
    kinds = {p: r.kind for p, r in rows.items()}
    assert kinds[b"fifo"] == "other" and kinds[b"empty_dir"] == "dir"
    assert kinds[b"live"] == kinds[b"live_dir"] == kinds[b"dangling"] == "symlink"
    assert rows[b"live"].target_exists and not rows[b"dangling"].target_exists
    assert b"live_dir/_x" not in rows


def test_odd_names_survive_a_build_and_refresh(spark, odd_tree, tmp_path):
    store = str(tmp_path / "s")
    built = build(spark, odd_tree, store)
    saved = {bytes(r.relative_path): bytes(r.sha512) for r in collected(built.manifest)}
    for path, digest in saved.items():
        with open(os.path.join(os.fsencode(odd_tree), path), "rb") as f:
            assert digest == hashlib.sha512(f.read()).digest()
    assert len(saved) == 11 and b"bad\xff" in saved and b"bad\xfe" in saved
    assert not refresh(spark, odd_tree, store).changed


@pytest.mark.parametrize("budget", [1, 3, 1000])
def test_scan_in_many_rounds(spark, tmp_path, budget):
    files = {f"d{i}/e{j}/f{k}": b"" for i in range(3) for j in range(2) for k in range(3)}
    files |= {f"flat/{i}": b"" for i in range(40)}
    files["deep/" + "/".join("abcdefgh")] = b""
    root = make_tree(tmp_path / "t", files)
    listed = [bytes(r.relative_path) for r in collected(scan_tree(spark, root, budget=budget))]
    assert len(listed) == len(set(listed)) and set(listed) == set(walk(root))


def test_a_full_directory_is_shared_out(spark, tmp_path):
    """Metadata of one directory's files is read by all tasks alike."""
    root = make_tree(tmp_path / "t", {f"hot/{i}": b"" for i in range(4000)})
    written = scan_tree(spark, root).groupBy(F.input_file_name()).count().collect()
    assert len(written) >= 8 and max(r["count"] for r in written) < 1000


def test_a_large_file_is_shared_out(spark):
    """The chunks of one file fall into all hashing tasks alike."""
    schema = "relative_path string, size long, mtime_ns long, ctime_ns long"
    file = spark.createDataFrame([("big", 1 << 40, 1, 1)], schema)
    chunks = content.file_chunks(file)
    assert chunks.count() == (1 << 40) // content.CHUNK_BYTES
    assert chunks.agg(F.sum("chunk_len")).first()[0] == 1 << 40
    spread = chunks.repartition(8, *content.CHUNK_KEY).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 3000


def test_bad_roots(spark, tmp_path):
    (tmp_path / "file").write_bytes(b"")
    with pytest.raises(FileNotFoundError):
        scan_tree(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        scan_tree(spark, str(tmp_path / "file"))
    with pytest.raises(ValueError):
        scan_tree(spark, "hdfs://somewhere/x")


def test_a_root_that_is_a_link_is_resolved(spark, tmp_path):
    make_tree(tmp_path / "real", {"a": b"a"})
    (tmp_path / "link").symlink_to("real")
    assert [r.relative_path for r in scan_tree(spark, str(tmp_path / "link")).collect()] == ["a"]


def test_a_machine_without_the_mount_fails(tmp_path):
    root = os.fsencode(str(tmp_path))
    inode = os.lstat(root).st_ino
    assert tree.mounted_root(root, inode) == os.lstat(root).st_dev
    with pytest.raises(OSError):
        tree.mounted_root(root, inode + 1)


def test_unreadable_and_foreign_directories_are_opaque(tmp_path, monkeypatch):
    root = os.fsencode(make_tree(tmp_path / "t", {"shut/a": b"", "open/b": b"", "c": b""}))
    device, real = os.lstat(root).st_dev, os.scandir

    def refuse(path):
        if path.endswith(b"shut"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(tree.os, "scandir", refuse)
    rows = {r[0]: r for r in tree._directory(root, b"", device, 100)}
    assert set(rows) == {b"shut", b"open", b"open/b", b"c"}
    assert rows[b"shut"][3:] == (True, "PermissionError: Permission denied")
    assert rows[b"open"][3:] == (False, None)
    elsewhere = list(tree._directory(root, b"open", device + 1, 100))
    assert elsewhere == [(b"open", True, False, True, None)]


def test_paths_a_walk_cannot_meet_are_probed(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"real/a": b"", "b": b""})
    os.symlink("real", f"{root}/link")
    asked = spark.createDataFrame([("link/a",), ("b",), ("link/none",), ("gone/x",), ("b/x",)], "relative_path string")
    found = still_present(asked, root)
    assert sorted(r.relative_path for r in found.collect()) == ["b", "link/a"]
    assert found.columns == scan_tree(spark, root).columns


def test_probe_errors_count_as_present():
    assert tree.is_gone(FileNotFoundError(2, "")) and tree.is_gone(NotADirectoryError(20, ""))
    assert not tree.is_gone(PermissionError(13, "")) and not tree.is_gone(OSError(5, "I/O error"))


def test_directory_replaced_by_a_link_keeps_its_rows(spark, tmp_path):
    root, store = make_tree(tmp_path / "t", {"d/a": b"a", "d/b": b"b"}), str(tmp_path / "s")
    build(spark, root, store)
    os.rename(f"{root}/d", f"{tmp_path}/moved")
    os.symlink(f"{tmp_path}/moved", f"{root}/d")
    os.remove(f"{tmp_path}/moved/b")
    plan = {r.relative_path: r.action for r in refresh(spark, root, store).plan.collect()}
    assert plan == {"d/a": "KEEP", "d/b": "DELETE_MISSING"}


SIZES = [0, 1, 111, 112, 127, 128, 129, 2**20 - 1, 2**20, 2**20 + 1]


@pytest.fixture
def sized_tree(tmp_path):
    return make_tree(tmp_path / "sized", {str(n): bytes(i % 251 for i in range(n)) for n in SIZES})


def files_of(spark, root):
    columns = ["relative_path", "size", "mtime_ns", "ctime_ns"]
    return scan_tree(spark, root).where("kind = 'file'").select(*columns)


def test_digests_at_block_edges(spark, sized_tree):
    got = {r.relative_path: bytes(r.sha512) for r in hash_files(files_of(spark, sized_tree), sized_tree, 3).collect()}
    for n in SIZES:
        with open(f"{sized_tree}/{n}", "rb") as f:
            assert got[str(n)] == hashlib.sha512(f.read()).digest()


def test_an_unreadable_file_is_an_error(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"a", "b": b"b"})
    missing = files_of(spark, root).withColumn("relative_path", F.concat("relative_path", F.lit("x")))
    rows = hash_files(missing, root, 1).collect()
    assert all(r.sha512 is None and "FileNotFoundError" in r.error for r in rows)


def test_a_file_replaced_by_a_pipe_is_an_error(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"a"})
    files = files_of(spark, root)
    os.remove(f"{root}/a")
    os.mkfifo(f"{root}/a")
    row = hash_files(files, root, 1).first()
    assert row.sha512 is None and "not a regular file" in row.error


def test_unreadable_file_during_refresh_keeps_the_old_row(spark, tmp_path, monkeypatch):
    """The files vanish between listing and hashing."""
    root, store = make_tree(tmp_path / "t", {"old": b"1", "other": b"1"}), str(tmp_path / "s")
    build(spark, root, store)
    make_tree(root, {"old": b"22", "new": b"3"})
    from treeledger.jobs import trees as jobs

    plain = jobs.hash_due_files

    def vanish(due, *args, **options):
        os.remove(f"{root}/old"), os.remove(f"{root}/new")
        return plain(due, *args, **options)

    monkeypatch.setattr(jobs, "hash_due_files", vanish)
    done = refresh(spark, root, store)
    saved = {r.relative_path: bytes(r.sha512) for r in done.manifest.collect()}
    assert saved == {p: hashlib.sha512(b"1").digest() for p in ("old", "other")}
    errors = {(r.relative_path, r.stage) for r in done.errors.collect()}
    assert errors == {("old", "hash"), ("new", "hash")}


def test_an_interrupted_run_goes_on_where_it_stopped(spark, tmp_path):
    count = 10 * 4 * spark.sparkContext.defaultParallelism  # enough for ten batches
    root = make_tree(tmp_path / "t", {f"f{i}": b"%03d" % i * 10 for i in range(count)})
    staging, due = str(tmp_path / "staging"), files_of(spark, root)
    calls = []

    def failing(part, tasks):
        calls.append(part.count())
        if len(calls) == 3:
            raise KeyboardInterrupt
        return hash_files(part, root, tasks)

    from treeledger.jobs import hashing

    args = (due, staging, content.FILE_KEY, "sha512", "size")
    with pytest.raises(KeyboardInterrupt):
        hashing._hash_in_batches(*args, failing, count * 3)
    finished = spark.read.parquet(staging).count()
    assert 0 < finished < count
    again = []

    def counting(part, tasks):
        again.append(part.count())
        return hash_files(part, root, tasks)

    with open(f"{root}/f0", "wb") as f:  # changed in between: its staged digest is not used
        f.write(b"other")
    due = files_of(spark, root)
    done, failed = hashing._hash_in_batches(due, *args[1:], counting, count * 3)
    assert sum(again) in (count - finished, count - finished + 1)
    got = {r.relative_path: bytes(r.sha512) for r in done.collect()}
    for i in range(count):
        with open(f"{root}/f{i}", "rb") as f:
            assert got[f"f{i}"] == hashlib.sha512(f.read()).digest()
    assert failed.count() == 0
    same, _ = hash_due_files(due, root, str(tmp_path / "other"))
    assert {r.relative_path: bytes(r.sha512) for r in same.collect()} == got


def test_chunk_ledger(spark, sized_tree, tmp_path):
    ledger, files = str(tmp_path / "ledger"), files_of(spark, sized_tree)
    digests, failed = hash_due_chunks(files, sized_tree, ledger, chunk_bytes=100_000, batch_bytes=1_000_000)
    got = {r.relative_path: bytes(r.tree_sha512) for r in digests.collect()}
    for n in SIZES:
        with open(f"{sized_tree}/{n}", "rb") as f:
            data = f.read()
        parts = [data[i : i + 100_000] for i in range(0, max(n, 1), 100_000)]
        assert len(parts) <= FAN_OUT
        flat = b"".join(hashlib.sha512(p).digest() for p in parts)
        assert got[str(n)] == hashlib.sha512(flat).digest()
    assert failed.count() == 0
    rows = spark.read.parquet(ledger).count()
    again, _ = hash_due_chunks(files, sized_tree, ledger, chunk_bytes=100_000)
    assert {r.relative_path: bytes(r.tree_sha512) for r in again.collect()} == got
    assert spark.read.parquet(ledger).count() == rows


def test_a_truncated_file_has_no_tree_digest(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"x" * 250, "b": b"y" * 250})
    files = files_of(spark, root)
    os.truncate(f"{root}/a", 120)
    digests, failed = hash_due_chunks(files, root, str(tmp_path / "ledger"), chunk_bytes=100)
    got = {r.relative_path: r.tree_sha512 for r in digests.collect()}
    assert got["a"] is None and got["b"] is not None
    assert {(r.chunk_no, r.error) for r in failed.collect()} == {(1, "read 20 of 100 bytes"), (2, "read 0 of 50 bytes")}


def test_list_errors(spark, tmp_path):
    listed = scan_tree(spark, make_tree(tmp_path / "t", {"a": b""}))
    assert list_errors(listed).count() == 0
    broken = listed.withColumn("error", F.lit("OSError: Input/output error"))
    assert [tuple(r) for r in list_errors(broken).collect()] == [("a", "list", "OSError: Input/output error")]


def test_workers_get_the_package_without_its_folder_on_their_path(tmp_path):
    """As the driver script runs: from another folder, importing only the entry module."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = make_tree(tmp_path / "t", {"a": b"a"})
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('entry', {repo + '/__spark_entry__.py'!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print(m.queries()['tree_sha512'](s, {root!r}).count(), 'rows')\n"
    )
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "1 rows" in run.stdout, run.stderr[-2000:]


def test_files_are_dealt_out_by_size(spark):
    import random

    from treeledger.sources.content import FILE_KEY, dealt_by_size

    draw, tasks = random.Random(3), 12
    sizes = [draw.choice([0, 10, 1000, 90_000]) + draw.randrange(50) for _ in range(6000)] + [40_000_000, 26_000_000, 9_000_000]
    rows = [(f"f{i}", size, 1, 1) for i, size in enumerate(sizes)]
    files = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'relative_path' else 'long'}" for c in FILE_KEY))
    dealt = dealt_by_size(files, tasks)
    assert sorted(map(tuple, dealt.collect())) == sorted(rows)
    loads = {r[0]: r[1] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("size")).collect()}
    assert len(loads) == tasks
    huge = [size for size in sizes if size * tasks > sum(sizes)]
    assert sorted(loads.values(), reverse=True)[: len(huge)] == sorted(huge, reverse=True)
    others = sorted(loads.values())[: tasks - len(huge)]
    assert max(others) < 1.2 * min(others) and max(others) * tasks < 1.2 * sum(sizes)
    assert dealt_by_size(files.limit(0), tasks).count() == 0 and dealt_by_size(files, 1).count() == len(rows)
