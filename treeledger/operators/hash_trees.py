"""Digests over prefixes of the path's hash: two manifests are compared by reading only where they differ.

The 64-bit hash of a path is cut into steps of four bits: a node of the tree is a prefix of so many bits, and holds
the number of its rows, how many of them are unfinished, and six sums of 32-bit hashes of (path, digest).  Sums do not depend on order,
so a tree is one aggregate, pre-aggregated before the shuffle, whatever the shape of the directories; and they can be added and
subtracted, so the tree of the next manifest is the old one plus the rows that changed.  Leaves hold about ``LEAF_ROWS`` rows.

``differences`` goes down from the root into nodes that are unlike or hold unfinished rows.  Rows of other leaves are not read further
than their hash, and not at all where the manifest is stored in order of the hash: the ranges reach the scan as filters.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .comparison import PATH_KEY, compare

STEP = 4  # bits a level
LEAF_ROWS = 1_024
MOST_BITS = 48
SUMS = [f"s{i}" for i in range(6)]
AMOUNTS = ["rows", "unfinished", *SUMS]
FEW_NODES = 2_000  # unlike nodes held as a list on the driver; beyond, leaves are compared by one join
FEW_RANGES = 64  # ranges given to the scan as filters


def path_hash(key_cols: Sequence[str] = PATH_KEY) -> Column:
    return F.xxhash64(*key_cols)


def leaf_bits(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """How many bits of the hash name a leaf, so that it holds about ``leaf_rows`` rows."""
    bits = 0
    while rows > leaf_rows << bits and bits < MOST_BITS:
        bits += STEP
    return bits


def _node(bits: int, key_cols: Sequence[str]) -> Column:
    hashed = path_hash(key_cols)
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("bigint")


def _amounts(key_cols: Sequence[str], digest_col: str, sign: int = 1) -> list[Column]:
    """What a manifest row adds to its nodes (``sign=-1``: takes from them)."""
    words = []
    for seed in range(len(SUMS) // 2):
        hashed = F.xxhash64(F.lit(seed), *key_cols, digest_col)
        words += [hashed.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(hashed, 32)]
    amounts = [F.lit(1).cast("bigint"), F.col(digest_col).isNull().cast("bigint"), *words]
    return [(amount * sign).alias(name) for amount, name in zip(amounts, AMOUNTS)]


def contributions(
    rows: DataFrame, bits: int, key_cols: Sequence[str] = PATH_KEY, digest_col: str = "sha512", sign: int = 1
) -> DataFrame:
    """One row per manifest row: its leaf and its amounts."""
    return rows.select(_node(bits, key_cols).alias("node"), *_amounts(key_cols, digest_col, sign))


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in AMOUNTS])


def rolled_up(parts: DataFrame, bits: int) -> DataFrame:
    """The tree (level, node and amounts; a level is a number of bits) of contributions to leaves of so many bits."""
    leaves = _summed(parts, "node")
    if not bits:
        return leaves.select(F.lit(0).alias("level"), *leaves.columns)
    level = F.explode(F.sequence(F.lit(0), F.lit(bits), F.lit(STEP)))
    levels = leaves.withColumn("level", level)
    node = F.expr(f"shiftrightunsigned(node, {bits} - level)")
    return _summed(levels.withColumn("node", node), "level", "node")


def digest_tree(
    rows: DataFrame, bits: int, key_cols: Sequence[str] = PATH_KEY, digest_col: str = "sha512"
) -> DataFrame:
    """The tree of a manifest."""
    return rolled_up(contributions(rows, bits, key_cols, digest_col), bits)


def added_trees(*trees: DataFrame) -> DataFrame:
    """The sum of a tree and of the trees of later changes, without nodes that have become empty."""
    total = _summed(reduce(DataFrame.unionByName, trees), "level", "node")
    return total.where(reduce(Column.__or__, [F.col(name) != 0 for name in AMOUNTS]))


def _unlike(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of one level whose amounts differ, or which hold unfinished rows."""
    sides = []
    for side, mark in ((left, "_l"), (right, "_r")):
        sides.append(side.select("node", *[F.col(name).alias(name + mark) for name in AMOUNTS]))
    joined = sides[0].join(sides[1], "node", "full_outer")
    differ = [~F.col(name + "_l").eqNullSafe(F.col(name + "_r")) for name in AMOUNTS]
    unfinished = F.coalesce(F.col("unfinished_l"), F.lit(0)) > 0
    return joined.where(reduce(Column.__or__, differ) | unfinished).select("node")


def unlike_leaves(left_tree: DataFrame, right_tree: DataFrame, bits: int) -> list[int] | DataFrame:
    """Leaves of ``bits`` bits (both trees have this level) to look into: a list if few, else a table (node)."""
    unlike = None
    for level in range(0, bits + 1, STEP):
        sides = [tree.where(F.col("level") == level) for tree in (left_tree, right_tree)]
        if unlike is not None:
            below = [node << STEP for node in unlike]
            children = [child for first in below for child in range(first, first + (1 << STEP))]
            sides = [side.where(F.col("node").isin(children)) for side in sides]
        found = _unlike(*sides)
        few = [row.node for row in found.limit(FEW_NODES + 1).collect()]
        if not few:
            return []
        if len(few) > FEW_NODES:  # too many to go on node by node
            leaves = [tree.where(F.col("level") == bits) for tree in (left_tree, right_tree)]
            return _unlike(*leaves)
        unlike = few
    return sorted(unlike)


def hash_ranges(nodes: Sequence[int], bits: int) -> list[tuple[int, int]]:
    """The path hashes of neighbouring nodes together, as inclusive signed ranges."""
    width, ranges = 1 << (64 - bits), []
    for low in sorted(((node << (64 - bits)) + (1 << 63)) % (1 << 64) - (1 << 63) for node in nodes):
        if ranges and ranges[-1][1] + 1 == low:
            ranges[-1] = (ranges[-1][0], low + width - 1)
        else:
            ranges.append((low, low + width - 1))
    return ranges


def in_leaves(
    rows: DataFrame, nodes: list[int] | DataFrame, bits: int, key_cols: Sequence[str] = PATH_KEY, hash_col: str | None = None
) -> DataFrame:
    """The rows of some leaves; nothing is shuffled where the leaves are few.

    ``hash_col`` names a stored column with the path's hash, whose filters reach the scan.
    """
    if not isinstance(nodes, list):
        node = F.shiftrightunsigned(F.col(hash_col), 64 - bits) if hash_col and bits else _node(bits, key_cols)
        marked = rows.withColumn("_node", node)
        return marked.join(nodes.withColumnRenamed("node", "_node"), "_node", "left_semi").drop("_node")
    if not nodes:
        return rows.where(F.lit(False))
    if not bits:
        return rows
    hashed = F.col(hash_col) if hash_col else path_hash(key_cols)
    ranges = hash_ranges(nodes, bits)
    if len(ranges) <= FEW_RANGES:
        return rows.where(reduce(Column.__or__, [hashed.between(low, high) for low, high in ranges]))
    return rows.where(F.shiftrightunsigned(hashed, 64 - bits).isin(nodes))


def differences(
    left: DataFrame,
    right: DataFrame,
    left_tree: DataFrame,
    right_tree: DataFrame,
    bits: int,
    key_cols: Sequence[str] = PATH_KEY,
    digest_col: str = "sha512",
    hash_col: str | None = None,
) -> DataFrame:
    """The rows of ``compare`` that are not a match, read from the leaves that are not alike.

    ``bits`` is a level of both trees; the smaller of their leaf levels is best.
    """
    nodes = unlike_leaves(left_tree, right_tree, bits)
    sides = [in_leaves(side, nodes, bits, key_cols, hash_col) for side in (left, right)]
    return compare(*sides, key_cols, digest_col).where(F.col("status") != "match")


def counts_with_matches(found: DataFrame, left_tree: DataFrame) -> DataFrame:
    """status and files as ``status_counts`` gives them; the matches are what the left root holds besides ``found``."""
    counted = found.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    both = counted.where(F.col("status") != "only_right").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("unlike"))
    root = left_tree.where(F.col("level") == 0).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("all"))
    matches = root.crossJoin(both).select(F.lit("match").alias("status"), (F.col("all") - F.col("unlike")).alias("files"))
    return counted.unionByName(matches.where(F.col("files") > 0))


def directory_digests(manifest: DataFrame, digest_col: str = "sha512") -> DataFrame:
    """directory ("" is the root), rows and sums of every directory, all below it included.

    Files are added up per directory first, so that only directories are repeated for those above them.
    """
    above = F.regexp_extract("relative_path", "(?s)^(.*)/[^/]*$", 1)
    own = _summed(manifest.select(above.alias("directory"), *_amounts(PATH_KEY, digest_col)), "directory")
    steps = F.split("directory", "/")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(steps))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    return _summed(own.withColumn("directory", F.explode(prefixes)), "directory")


def compare_directories(left: DataFrame, right: DataFrame, digest_col: str = "sha512") -> DataFrame:
    """directory, status (only_left, only_right, unlike, unverified or alike) and the rows of each side below it."""
    sides = []
    for side, mark in ((left, "left"), (right, "right")):
        digests = directory_digests(side, digest_col)
        sides.append(digests.select("directory", *[F.col(name).alias(f"{mark}_{name}") for name in AMOUNTS]))
    joined = sides[0].join(sides[1], "directory", "full_outer")
    differ = [F.col(f"left_{name}") != F.col(f"right_{name}") for name in AMOUNTS]
    status = (
        F.when(F.col("right_rows").isNull(), "only_left")
        .when(F.col("left_rows").isNull(), "only_right")
        .when(reduce(Column.__or__, differ), "unlike")
        .when(F.col("left_unfinished") > 0, "unverified")
        .otherwise("alike")
    )
    return joined.select(
        "directory",
        status.alias("status"),
        *[F.coalesce(F.col(f"{mark}_rows"), F.lit(0)).alias(f"{mark}_rows") for mark in ("left", "right")],
    )
