"""Digest trees, sketches and merging: against the plain operators, and that they read and shuffle less."""

import random
import re

import pytest
from pyspark.sql import functions as F

from treeledger.operators import (
    changes_between,
    compare,
    compare_directories,
    counts_with_matches,
    differences,
    digest_tree,
    latest_changes,
    leaf_bits,
    merge_changes,
    reconcile_by_sketch,
    reconcile_multiset,
    sketches,
    status_counts,
)
from treeledger.operators.hash_trees import added_trees, contributions, hash_ranges, rolled_up

SCHEMA = "relative_path string, sha512 binary"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def manifest(spark, count, other=()):
    """Paths with a digest each; ``other`` gives some another one, None an unfinished row, "" no row."""
    other = dict(other)
    rows = []
    for i in range(count):
        value = other.get(i, f"content {i}")
        if value != "":
            rows.append((f"d{i % 7}/e{i % 3}/f{i}", None if value is None else value.encode()))
    return spark.createDataFrame(rows, SCHEMA)


def plan_of(df):
    return df._jdf.queryExecution().toString()


# --- trees


@pytest.mark.parametrize("bits", [0, 4, 8, 12])
def test_differences_equal_compare(spark, bits):
    left = manifest(spark, 3000, {5: "x", 9: None, 17: ""})
    right = manifest(spark, 3100, {5: "y", 9: "z", 400: None, 401: ""})
    trees = [digest_tree(side, bits) for side in (left, right)]
    found = differences(left, right, *trees, bits)
    compared = compare(left, right)
    assert rows_of(found) == rows_of(compared.where("status <> 'match'"))
    assert rows_of(counts_with_matches(found, trees[0])) == rows_of(status_counts(compared))


def test_trees_of_equal_unfinished_and_empty_manifests(spark):
    side, empty = manifest(spark, 500), manifest(spark, 0)
    tree = digest_tree(side, 4)
    same = differences(side, side, tree, tree, 4)
    assert same.count() == 0 and rows_of(counts_with_matches(same, tree)) == [("match", 500)]
    none = digest_tree(empty, 0)
    both = differences(empty, empty, none, none, 0)
    assert both.count() == 0 and counts_with_matches(both, none).count() == 0
    against = differences(side, empty, tree, none, 0)
    assert rows_of(status_counts(against)) == [("only_left", 500)]
    open_rows = manifest(spark, 500, {3: None})
    tree = digest_tree(open_rows, 8)
    assert rows_of(differences(open_rows, open_rows, tree, tree, 8)) == [("d3/e0/f3", "unverified")]


def test_many_unlike_leaves_go_through_a_join(spark, monkeypatch):
    from treeledger.operators import hash_trees as module

    left, right = manifest(spark, 900), manifest(spark, 900, {i: f"new {i}" for i in range(0, 900, 2)})
    trees = [digest_tree(side, 8) for side in (left, right)]
    for limit in ("FEW_NODES", "FEW_RANGES"):
        monkeypatch.setattr(module, limit, 3)
        found = differences(left, right, *trees, 8)
        assert rows_of(found) == rows_of(compare(left, right).where("status <> 'match'"))


def test_trees_can_be_added(spark):
    old, new = manifest(spark, 800, {3: None}), manifest(spark, 820, {5: "x", 7: ""})
    gone = contributions(old.join(new, ["relative_path", "sha512"], "left_anti"), 8, sign=-1)
    came = contributions(new.join(old, ["relative_path", "sha512"], "left_anti"), 8)
    change = rolled_up(gone.unionByName(came), 8)
    columns = ["level", "node", "rows", "unfinished", *[f"s{i}" for i in range(6)]]
    # The unfinished row has no equal partner, so it is taken away and comes again, finished.
    got = added_trees(digest_tree(old, 8).select(*columns), change.select(*columns))
    assert rows_of(got.select(*columns)) == rows_of(digest_tree(new, 8).select(*columns))


def test_hash_ranges_cover_the_nodes_and_nothing_else():
    draw = random.Random(1)
    for bits in (4, 8, 16):
        nodes = draw.sample(range(1 << bits), 7)
        ranges = hash_ranges(nodes, bits)
        for _ in range(3000):
            value = draw.randrange(-(1 << 63), 1 << 63)
            inside = (value % (1 << 64)) >> (64 - bits) in nodes
            assert any(low <= value <= high for low, high in ranges) == inside
    assert hash_ranges(range(16), 4) == [(-(1 << 63), (1 << 63) - 1)]


def test_leaf_bits_follow_the_rows():
    assert [leaf_bits(n) for n in (0, 1024, 1025, 16_384, 16_385, 10**7)] == [0, 0, 4, 4, 8, 16]


def test_few_differences_shuffle_no_rows_of_like_leaves(spark, tmp_path):
    """Two stored manifests: the differing leaves reach the scan as filters, and only their rows go on."""
    folder = str(tmp_path)
    made = F.concat(F.lit("p/"), F.col("id"))
    for name, salt in (("l", F.lit("")), ("r", F.when(F.col("id").isin(77, 40_000), "!").otherwise(""))):
        side = spark.range(60_000).select(
            made.cast("string").alias("relative_path"), F.unhex(F.sha2(F.concat(made, salt), 512)).alias("sha512")
        )
        side = side.withColumn("path_hash", F.xxhash64("relative_path")).repartitionByRange(8, "path_hash")
        side.sortWithinPartitions("path_hash").write.parquet(f"{folder}/{name}")
    sides = [spark.read.parquet(f"{folder}/{name}") for name in "lr"]
    trees = [digest_tree(side, leaf_bits(60_000)) for side in sides]
    found = differences(*sides, *trees, leaf_bits(60_000), hash_col="path_hash")
    assert rows_of(found) == [("p/40000", "mismatch"), ("p/77", "mismatch")]
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(path_hash", plan_of(found).replace("\n", " "))
    # The rows that pass are those of two leaves of 256.
    leaf = F.shiftrightunsigned("path_hash", 64 - leaf_bits(60_000))
    chosen = [r[0] for r in sides[0].where("relative_path in ('p/77', 'p/40000')").select(leaf).collect()]
    passed = sides[0].where(leaf.isin(chosen)).count()
    assert passed < 60_000 * 4 / 256


def test_directories(spark):
    left = spark.createDataFrame(
        [("a/b/1", b"x"), ("a/b/2", b"y"), ("a/c/1", b"z"), ("top", b"t"), ("n/1", None), ("gone/1", b"g")], SCHEMA
    )
    right = spark.createDataFrame(
        [("a/b/1", b"x"), ("a/b/2", b"y"), ("a/c/1", b"Z"), ("top", b"t"), ("n/1", None), ("new\n/x/1", b"g")], SCHEMA
    )
    assert rows_of(compare_directories(left, right)) == sorted(
        [
            ("", "unlike", 6, 6), ("a", "unlike", 3, 3), ("a/b", "alike", 2, 2), ("a/c", "unlike", 1, 1),
            ("n", "unverified", 1, 1), ("gone", "only_left", 1, 0), ("new\n", "only_right", 0, 1),
            ("new\n/x", "only_right", 0, 1),
        ],
        key=str,
    )


# --- sketches


def tables(spark, seed, count, apart, repeat=1):
    draw = random.Random(seed)
    rows = [(i % 50, draw.choice([None, f"v{i}"]), i) for i in range(count)]
    left = rows * repeat + [(None, None, -1)]
    right = rows * repeat + [(None, None, -1)]
    for i in range(apart):
        (left if draw.random() < 0.5 else right).extend([(i, f"only {i}", -i)] * draw.choice([1, 1, 4]))
    schema = "k long, v string, n long"
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


@pytest.mark.parametrize("apart, repeat", [(0, 1), (1, 3), (40, 1), (900, 2)])
def test_sketched_differences_equal_the_counted_ones(spark, apart, repeat):
    left, right = tables(spark, apart, 2500, apart, repeat)
    expected = rows_of(reconcile_multiset(left, right, ["k"], ["v", "n"]).where("status <> 'match'"))
    assert rows_of(reconcile_by_sketch(left, right, ["k"], ["v", "n"])) == expected
    assert len(expected) == apart


def test_a_copy_more_is_a_difference(spark):
    schema = "k long, v double"
    left = spark.createDataFrame([(1, 0.5)] * 5 + [(2, None)] * 2, schema)
    right = spark.createDataFrame([(1, 0.5)] * 3 + [(2, None)] * 2, schema)
    assert rows_of(reconcile_by_sketch(left, right, ["k"], ["v"])) == [(1, 5, 3, "count_differs")]
    assert rows_of(reconcile_by_sketch(left.limit(0), right.limit(0), ["k"], ["v"])) == []


def test_too_many_differences_are_counted_exactly(spark, monkeypatch):
    left, right = tables(spark, 3, 300, 700)
    expected = rows_of(reconcile_multiset(left, right, ["k"], ["v", "n"]).where("status <> 'match'"))
    assert rows_of(reconcile_by_sketch(left, right, ["k"], ["v", "n"], max_cells=100)) == expected
    monkeypatch.setattr(sketches, "estimated_differences", lambda *sides: 3)  # far too small: it cannot empty
    assert rows_of(reconcile_by_sketch(left, right, ["k"], ["v", "n"])) == expected


@pytest.mark.parametrize("apart", [0, 30, 400, 3000])
def test_estimates(spark, apart):
    left, right = tables(spark, 5, 4000, apart)
    cols = ["k", "v", "n"]
    found = sketches.estimated_differences(*[sketches._identified(side, cols) for side in (left, right)])
    assert apart * 0.6 <= found <= apart * 1.7


def test_peeling_takes_back_what_it_put_in():
    draw = random.Random(4)
    for count, size in ((0, 10), (1, 5), (300, 200)):
        put = {tuple(draw.randrange(1 << 24) for _ in range(4)): draw.choice([-3, -1, 1, 2]) for _ in range(count)}
        cells: dict = {}
        for words, copies in put.items():
            for place in enumerate(sketches._places(list(words), size)):
                held = cells.setdefault(place, [0] * 6)
                for i, value in enumerate([1, *words, sketches._checked(words)]):
                    held[i] += copies * value
        assert sketches.peeled({k: v for k, v in cells.items() if any(v)}, size) == put
    crowded = {(0, 0): [2, 5, 5, 5, 5, 5], (1, 0): [2, 5, 5, 5, 5, 5], (2, 0): [2, 5, 5, 5, 5, 5]}
    assert sketches.peeled(crowded, 1) is None


def test_the_sketch_is_what_is_shuffled(spark):
    """Rows are added up to cells before the exchange: as many rows go through it as there are cells, at most."""
    left, right = (spark.range(50_000).select("id", F.lit(i).alias("v")) for i in (0, 0))
    sides = [sketches._identified(side, ["id", "v"]) for side in (left, right)]
    plan = sketches._sketched(*sides, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "partial_sum" in plan[plan.index("Exchange hashpartitioning(table") :]


# --- merging


def test_merged_changes_are_the_last_state(spark):
    draw, schema = random.Random(6), "relative_path string, size long, sha512 binary"
    values = ["size", "sha512"]
    state = {f"p{i}": (i, b"x") for i in range(300)}
    base = spark.createDataFrame([(p, *v) for p, v in state.items()], schema)
    changes = []
    for step in range(4):
        new = dict(state)
        for _ in range(25):
            path = f"p{draw.randrange(400)}"
            if draw.random() < 0.3:
                new.pop(path, None)
            else:
                new[path] = (draw.choice([None, step]), draw.choice([None, b"y", b"z"]))
        old_df, new_df = (spark.createDataFrame([(p, *v) for p, v in s.items()], schema) for s in (state, new))
        changes.append(changes_between(old_df, new_df, values).withColumn("sequence", F.lit(step)))
        state = new
    every = changes[0].unionByName(changes[1]).unionByName(changes[2]).unionByName(changes[3])
    merged = merge_changes(base, latest_changes(every, values), values)
    assert {r.relative_path: (r["size"], r.sha512 and bytes(r.sha512)) for r in merged.collect()} == state
    assert changes_between(base, base, values).count() == 0
