import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from treeledger.operators import (
    any_change,
    apply_plan,
    change_report,
    compare,
    history,
    merged_roots,
    mismatched,
    only_in,
    plan_refresh,
    reconcile,
    reconcile_multiset,
    report,
    self_check,
    status_counts,
    text_chunks,
    to_hash,
    tree_digest,
    tree_summary,
    unexpected_roots,
    verdict,
    violations,
)
from treeledger.schemas import LISTING, MANIFEST, ROOTS


def sha(text):
    return hashlib.sha512(text.encode()).digest()


def manifest(spark, rows):
    """rows: path -> (size, mtime, ctime, digest, bytes_hashed)"""
    return spark.createDataFrame([(p, *r) for p, r in rows.items()], MANIFEST)


def digests(spark, rows):
    return manifest(spark, {p: (1, 1, 1, d and sha(d), None if d else 1) for p, d in rows.items()})


def listing(spark, rows):
    """rows: path -> (size, mtime, ctime), or a kind, or (kind, target_exists)"""
    out = []
    for path, row in rows.items():
        kind, times, target = "file", (None, None, None), None
        if isinstance(row, str):
            kind = row
        elif isinstance(row[0], str):
            kind, target = row
        else:
            times = row
        out.append((path, kind, *times, path.count("/"), 1, target, False, None))
    return spark.createDataFrame(out, LISTING)


def as_dict(df, column):
    rows = df.collect()
    assert len({r.relative_path for r in rows}) == len(rows)
    return {r.relative_path: r[column] for r in rows}


def test_compare_statuses(spark):
    left = digests(spark, {"l": "1", "same": "1", "diff": "1", "half_left": None, "half_right": "1", "half": None})
    right = digests(spark, {"r": "1", "same": "1", "diff": "2", "half_left": "1", "half_right": None, "half": None})
    assert as_dict(compare(left, right), "status") == {
        "l": "only_left",
        "r": "only_right",
        "same": "match",
        "diff": "mismatch",
        "half_left": "unverified",
        "half_right": "unverified",
        "half": "unverified",
    }
    assert [r[0] for r in only_in(left, right).collect()] == ["l"]
    assert [r[0] for r in only_in(right, left).collect()] == ["r"]
    assert [r[0] for r in mismatched(left, right).collect()] == ["diff"]
    counts = {r.status: r.files for r in status_counts(compare(left, right)).collect()}
    assert counts == {"only_left": 1, "only_right": 1, "match": 1, "mismatch": 1, "unverified": 3}


def test_report_is_in_bytewise_order(spark):
    names = ["zé", "a/b", "Z", "a.b"]
    rows = report(compare(digests(spark, dict.fromkeys(names, "1")), digests(spark, {}))).collect()
    assert [r.relative_path for r in rows] == ["Z", "a.b", "a/b", "zé"]


def test_verdicts(spark):
    empty, full, half = digests(spark, {}), digests(spark, {"a": "1"}), digests(spark, {"a": None})
    assert tuple(verdict(compare(empty, empty)).first()) == (True, True, True, True)
    assert tuple(verdict(compare(full, full)).first()) == (True, True, True, True)
    assert tuple(verdict(compare(full, half)).first()) == (True, True, True, False)
    assert tuple(verdict(compare(full, empty)).first()) == (False, True, False, True)
    other = digests(spark, {"a": "2"})
    assert tuple(verdict(compare(full, other)).first()) == (True, False, False, True)


def test_compare_with_several_roots(spark):
    def side(rows):
        schema = "prefix string, relative_path string, sha512 binary"
        return spark.createDataFrame([(p, r, sha(d)) for p, r, d in rows], schema)

    left = side([("/m1", "a", "1"), ("/m2", "a", "2")])
    right = side([("/m1", "a", "1"), ("/m2", "a", "3")])
    keys = ("prefix", "relative_path")
    assert [tuple(r) for r in mismatched(left, right, key_cols=keys).collect()] == [("/m2", "a")]


T = (5, 10, 20)  # size, mtime, ctime
DONE, HALF = (sha("x"), None), (None, 3)


def test_every_refresh_decision(spark):
    saved = manifest(
        spark,
        {
            "ign/gone": (*T, *DONE),
            "gone": (*T, *DONE),
            "dangling": (*T, *DONE),
            "link": (*T, *DONE),
            "now_dir": (*T, *DONE),
            "a/b/c/deep": (*T, *DONE),
            "a/b/c/deep_gone": (*T, *DONE),
            "same": (*T, *DONE),
            "ign/same": (*T, *DONE),
            "ign/changed": (*T, *DONE),
            "ign/half": (*T, *HALF),
            "ign/taken_back": (*T, *DONE),
            "half": (*T, *HALF),
            "half_changed": (*T, *HALF),
            "mtime_by_1ns": (*T, *DONE),
            "all": (*T, *DONE),
        },
    )
    now = listing(
        spark,
        {
            "dangling": ("symlink", False),
            "link": ("symlink", True),
            "now_dir": "dir",
            "a/b/c/deep": (9, 9, 9),
            "a/b/c/deep_new": T,
            "same": T,
            "ign/same": T,
            "ign/changed": (6, 10, 20),
            "ign/half": T,
            "ign/new": T,
            "ign/taken_back": (6, 10, 20),
            "half": T,
            "half_changed": (5, 10, 21),
            "mtime_by_1ns": (5, 11, 20),
            "all": (6, 11, 21),
            "new": T,
            "new_dir": "dir",
            "new_fifo": "other",
        },
    )
    options = {"ignore": ["^ign/"], "include": ["taken_back"], "maxdepth": 2}
    plan = plan_refresh(now, saved, **options)
    expected = {
        "ign/gone": "DELETE_MISSING",
        "gone": "DELETE_MISSING",
        "dangling": "DELETE_MISSING",
        "link": "KEEP",
        "now_dir": "KEEP",
        "a/b/c/deep": "KEEP",
        "a/b/c/deep_gone": "DELETE_MISSING",
        "same": "KEEP",
        "ign/same": "KEEP",
        "ign/changed": "IGNORED",
        "ign/half": "IGNORED",
        "ign/new": "IGNORED",
        "ign/taken_back": "CHANGED",
        "half": "RESUME",
        "half_changed": "REHASH",
        "mtime_by_1ns": "CHANGED",
        "all": "CHANGED",
        "new": "ADD",
    }
    assert as_dict(plan, "action") == expected
    masks = as_dict(plan, "change_mask")
    assert (masks["mtime_by_1ns"], masks["all"], masks["same"], masks["new"], masks["gone"]) == (4, 7, 0, -1, -1)
    assert (masks["half_changed"], masks["link"], masks["a/b/c/deep"]) == (2, -1, -1)

    cleaned = as_dict(plan_refresh(now, saved, clean_ignored=True, **options), "action")
    for path in ("ign/gone", "ign/same", "ign/changed", "ign/half"):
        assert cleaned.pop(path) == "DELETE_IGNORED"
        expected.pop(path)
    assert cleaned == expected

    everything = as_dict(plan_refresh(now, saved, mode="full", **options), "action")
    assert everything["same"] == "REHASH" and everything["ign/same"] == "IGNORED"
    assert everything["link"] == everything["a/b/c/deep"] == "KEEP"
    with pytest.raises(ValueError):
        plan_refresh(now, saved, mode="other")

    due = to_hash(plan)
    assert sorted(as_dict(due, "size")) == sorted(
        ["ign/taken_back", "half", "half_changed", "mtime_by_1ns", "all", "new"]
    )
    read = due.where("relative_path NOT IN ('all', 'new')").withColumn("sha512", F.lit(sha("y")).cast("binary"))
    new = {r.relative_path: r for r in apply_plan(plan, read).collect()}
    assert "new" not in new  # could not be read and had no row
    assert new["all"]["size"] == 5 and bytes(new["all"].sha512) == sha("x")  # could not be read: old row
    assert new["ign/changed"]["size"] == 5 and new["ign/half"].bytes_hashed == 3  # stale rows stay
    assert new["half"].bytes_hashed is None and bytes(new["half"].sha512) == sha("y")
    assert new["mtime_by_1ns"].mtime_ns == 11
    assert "ign/new" not in new and "gone" not in new
    assert len(new) == 12
    assert any_change(plan).first().any_change


def test_any_change_of_nothing(spark):
    empty = plan_refresh(listing(spark, {}), manifest(spark, {}))
    assert empty.count() == 0 and not any_change(empty).first().any_change
    kept = plan_refresh(listing(spark, {"a": T}), manifest(spark, {"a": (*T, *DONE)}))
    assert not any_change(kept).first().any_change


def test_change_report(spark):
    plan = plan_refresh(listing(spark, {"a": (1536, 10, 21)}), manifest(spark, {"a": (*T, *DONE)}))
    row = change_report(plan).first()
    assert (row.change_label, row.was_size, row.now_size) == ("size & ctime", "5B", "1kB 512B")
    assert row.now_ctime == "1970-01-01 00:00:00.000000021" and row.was_mtime is None


metadata = st.tuples(st.integers(1, 3), st.integers(1, 2), st.integers(1, 2))
names = st.sampled_from(["a", "b", "x/a", "x/b", "x/y/a", "ign/a", "ign/b"])
saved_row = st.tuples(metadata, st.booleans()).map(lambda v: (*v[0], *(DONE if v[1] else HALF)))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(names, metadata), st.dictionaries(names, saved_row), st.booleans())
def test_refresh_twice_changes_nothing_more(spark, now, saved, clean):
    found, old = listing(spark, now), manifest(spark, saved)
    options = {"ignore": ["^ign/"], "maxdepth": 1, "clean_ignored": clean}
    plan = plan_refresh(found, old, **options)
    read = to_hash(plan).withColumn("sha512", F.lit(sha("y")).cast("binary"))
    new = spark.createDataFrame(apply_plan(plan, read).collect(), MANIFEST)
    again = Counter(r.action for r in plan_refresh(found, new, **options).collect())
    assert set(again) <= {"KEEP", "IGNORED"}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(*[st.dictionaries(names, st.sampled_from(["1", "2", None]))] * 2)
def test_compare_mirrors(spark, left, right):
    a, b = digests(spark, left), digests(spark, right)
    turned = {"only_left": "only_right", "only_right": "only_left"}
    there, back = as_dict(compare(a, b), "status"), as_dict(compare(b, a), "status")
    assert there == {p: turned.get(s, s) for p, s in back.items()}


def test_roots(spark):
    saved = spark.createDataFrame([("/a",), ("/b",), ("/it's",)], ROOTS)
    given_roots = spark.createDataFrame([("/a/",), ("/c//",), ("/c",)], ROOTS)
    assert sorted(r.prefix for r in unexpected_roots(saved, given_roots).collect()) == ["/b", "/it's"]
    merged = sorted(r.prefix for r in merged_roots(saved, given_roots).collect())
    assert merged == ["/a", "/b", "/c", "/it's"]
    replaced = sorted(r.prefix for r in merged_roots(saved, given_roots, replace=True).collect())
    assert replaced == ["/a", "/c"]


def test_reconcile_by_key(spark):
    schema = "k1 int, k2 string, v double, w string"
    same = [(1, "a", 1.0, "x"), (2, None, 3.0, "x")]
    left = spark.createDataFrame(same + [(1, "b", 2.0, None), (3, "c", 1.0, "x")], schema)
    right = spark.createDataFrame(same + [(1, "b", 2.0, "x"), (4, "c", 1.0, "x")], schema)
    got = {(r.k1, r.k2): r.status for r in reconcile(left, right, ["k1", "k2"], ["v", "w"]).collect()}
    assert got == {
        (1, "a"): "match",
        (1, "b"): "mismatch",
        (2, None): "match",
        (3, "c"): "only_left",
        (4, "c"): "only_right",
    }
    with pytest.raises(PySparkException, match="not unique"):
        reconcile(left.union(left), right, ["k1", "k2"], ["v", "w"]).collect()


def test_reconcile_multiset_matches_brute_force(spark):
    left = [(1, "a")] * 3 + [(1, "b")] + [(2, "c")] * 2 + [(None, "n")]
    right = [(1, "a")] * 2 + [(1, "b")] + [(3, "d")] + [(None, "n")]
    frames = (spark.createDataFrame(rows, "k int, v string") for rows in (left, right))
    rows = reconcile_multiset(*frames, ["k"], ["v"]).collect()
    got = Counter((r.k, r.left_rows, r.right_rows, r.status) for r in rows)
    count_l, count_r = Counter(left), Counter(right)
    expected = Counter()
    for row in count_l | count_r:
        l, r = count_l[row], count_r[row]
        status = "match" if l == r else "only_left" if not r else "only_right" if not l else "count_differs"
        expected[(row[0], l, r, status)] += 1
    assert got == expected


def test_reconcile_by_fixed_width_values(spark):
    rows = "(1, 0.0, DATE'2020-01-01', true), (2, CAST('NaN' AS DOUBLE), NULL, NULL), (3, 1.0, NULL, true)"
    other = "(1, -0.0, DATE'2020-01-01', true), (2, CAST('NaN' AS DOUBLE), NULL, NULL), (3, 1.0, NULL, NULL)"
    left, right = (spark.sql(f"SELECT * FROM VALUES {r} AS t(k, d, t, b)") for r in (rows, other))
    expected = {1: "match", 2: "match", 3: "mismatch"}
    assert {r.k: r.status for r in reconcile(left, right, ["k"], ["d", "t", "b"]).collect()} == expected
    texts = [df.withColumn("s", F.lit("x")) for df in (left, right)]  # the same through digests
    assert {r.k: r.status for r in reconcile(*texts, ["k"], ["d", "t", "b", "s"]).collect()} == expected


def test_self_check_names_every_fault(spark):
    good = {"fine": (5, 1, 1, sha("x"), None), "half": (5, 1, 1, None, 3), "empty": (0, 1, 1, sha(""), None)}
    ok = self_check(manifest(spark, good)).first()
    assert ok.ok and ok.files == 3
    assert self_check(manifest(spark, {})).first().ok
    assert violations(manifest(spark, good)).count() == 0
    rows = [
        ("", 5, 1, 1, sha("x"), None),
        ("twice", 5, 1, 1, sha("x"), None),
        ("twice", 5, 1, 1, sha("y"), None),
        ("short", 5, 1, 1, sha("x")[:63], None),
        ("zero", 5, 1, 1, bytes(64), None),
        ("beyond", 5, 1, 1, None, 6),
        ("nothing", 5, 1, 1, None, None),
        ("both", 5, 1, 1, sha("x"), 3),
    ]
    bad = spark.createDataFrame(rows, MANIFEST)
    assert {(r.relative_path, r.fault) for r in violations(bad).collect()} == {
        ("", "no_path"),
        ("twice", "duplicate_path"),
        ("short", "digest_length"),
        ("zero", "zero_digest"),
        ("beyond", "bytes_hashed_range"),
        ("nothing", "complete_without_digest"),
        ("both", "incomplete_with_digest"),
    }
    found = self_check(bad).first().asDict()
    assert found.pop("files") == 8 and found.pop("ok") is False
    assert set(found.values()) == {1}


def test_history_over_gaps(spark):
    states = {
        1: {"stays": "1", "changes": "1", "leaves": "1", "returns": "1"},
        2: {"stays": "1", "changes": "2", "half": None},
        3: {"stays": "1", "changes": "2", "half": "1", "returns": "1"},
        5: {},
        6: {"stays": "1"},
    }
    rows = [(i, p, d and sha(d)) for i, files in states.items() for p, d in files.items()]
    table = spark.createDataFrame(rows, "snapshot_id long, relative_path string, sha512 binary")
    got = {(r.snapshot_id, r.relative_path, r.event) for r in history(table, sorted(states)).collect()}
    expected, ids = set(), sorted(states)
    for old, new in zip(ids, ids[1:]):
        for p in states[old].keys() | states[new].keys():
            before, after = states[old], states[new]
            if p not in before:
                expected.add((new, p, "added"))
            elif p not in after:
                expected.add((new, p, "removed"))
            elif before[p] is None or after[p] is None:
                expected.add((new, p, "unverified"))
            elif before[p] != after[p]:
                expected.add((new, p, "changed"))
    assert got == expected


def test_tree_summary(spark):
    rows = listing(
        spark, {"d": "dir", "d/e": "dir", "d/f": (5, 1, 1), "f": (1024, 1, 1), "l": ("symlink", True), "p": "other"}
    )
    assert tree_summary(rows).first()[:] == (1029, "1kB 5B", 6, 3, 2, 1)
    assert tree_summary(rows, maxdepth=0).first()[:] == (1024, "1kB", 5, 3, 1, 1)
    assert tree_summary(listing(spark, {})).first()[:] == (0, "0B", 1, 1, 0, 0)


def brute_tree_digest(content, chunk, fan_out):
    level = [hashlib.sha512(content[i : i + chunk]).digest() for i in range(0, max(len(content), 1), chunk)]
    while True:
        level = [hashlib.sha512(b"".join(level[i : i + fan_out])).digest() for i in range(0, len(level), fan_out)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("fan_out", [2, 3, 1024])
def test_tree_digest_matches_brute_force(spark, fan_out):
    texts = {i: "é" * n for i, n in enumerate([0, 1, 3, 4, 7, 16, 40, 101])}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    chunks = text_chunks(df, ["id"], F.col("t"), 8)
    got = {r.id: bytes(r.tree_digest) for r in tree_digest(chunks, ["id"], 64, fan_out=fan_out).collect()}
    assert got == {i: brute_tree_digest(t.encode(), 8, fan_out) for i, t in texts.items()}


def test_tree_digest_of_a_gap_is_null(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, "y" * 100)], "id int, t string")
    chunks = text_chunks(df, ["id"], F.col("t"), 8)
    for gap in ("id = 1 AND chunk_no = 12", "id = 1 AND chunk_no BETWEEN 4 AND 7"):
        holes = chunks.where(f"NOT ({gap})")
        got = {r.id: r.tree_digest for r in tree_digest(holes, ["id"], 16, fan_out=4).collect()}
        assert got[1] is None and got[2] is not None


def _same(spark, left, right, kind, extra=False):
    """Statuses of reconciling one value with another, alone or beside free text."""
    from treeledger.operators import reconcile

    names = ["v", "note"] if extra else ["v"]
    sides = [
        spark.range(1).selectExpr("id AS k", f"CAST({value} AS {kind}) AS v", "'a,b' AS note") for value in (left, right)
    ]
    return [row.status for row in reconcile(*sides, ["k"], names).collect()]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("extra", [False, True])
def test_reconcile_tells_instants_nested_values_and_bytes_apart(spark, zone, extra):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        first, second = "timestamp'2024-11-03 05:30:00Z'", "timestamp'2024-11-03 06:30:00Z'"
        micro = ["timestamp_micros(1700000000000001)", "timestamp_micros(1700000000000999)"]
        differing = [
            (first, second, "timestamp"),
            (*[f"array({m})" for m in micro], "array<timestamp>"),
            (*[f"named_struct('t', {m})" for m in micro], "struct<t:timestamp>"),
            ("array(CAST(x'ff' AS string))", "array(CAST(x'fe' AS string))", "array<string>"),
            ("array('a', 'b')", "array('a,1:b')", "array<string>"),
            ("array(CAST(NULL AS string))", "array('N')", "array<string>"),
            ("CAST(NULL AS struct<a:int>)", "named_struct('a', CAST(NULL AS int))", "struct<a:int>"),
        ]
        for left, right, kind in differing:
            assert _same(spark, left, right, kind, extra) == ["mismatch"], kind
            assert _same(spark, left, left, kind, extra) == ["match"], kind
        equal = [
            ("array(-0.0D)", "array(0.0D)", "array<double>"),
            ("named_struct('m', map('a', 1, 'b', 2))", "named_struct('m', map('b', 2, 'a', 1))", "struct<m:map<string,int>>"),
        ]
        for left, right, kind in equal:
            assert _same(spark, left, right, kind, extra) == ["match"], kind
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tree_digest_fails_where_its_bound_is_too_small(spark):
    from treeledger.operators import tree_digest

    chunks = spark.range(5).selectExpr("'a' AS k", "id AS chunk_no", "unhex(sha2(CAST(id AS string), 256)) AS digest", "5L AS chunks")
    assert tree_digest(chunks, ["k"], 5, 256, fan_out=2).count() == 1
    with pytest.raises(Exception, match="more than 1 chunks"):
        tree_digest(chunks, ["k"], 1, 256, fan_out=2).collect()


def test_null_content_keeps_its_key(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, t string")
    chunks = text_chunks(df, ["id"], F.col("t"), 2)
    digests = {r.id: r.tree_digest for r in tree_digest(chunks, ["id"], 2).collect()}
    assert digests.keys() == {1, 2, 3}
    assert digests[2] is None and None not in (digests[1], digests[3])
