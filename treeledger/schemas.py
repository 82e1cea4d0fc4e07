"""Table schemas.

Times are BIGINT nanoseconds: change detection compares full nanosecond
values, and Spark timestamps stop at microseconds.  ``relative_path`` carries
the name's bytes unchanged (POSIX names need not be valid UTF-8), so equality
and ordering are bytewise.
"""

from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("relative_path", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),  # file, dir, symlink, other
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("ctime_ns", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("dev", T.LongType()),
        T.StructField("target_exists", T.BooleanType()),  # symlinks only
        T.StructField("opaque", T.BooleanType()),  # directory that was not descended
        T.StructField("error", T.StringType()),
    ]
)

# Digests a manifest can hold: of the whole file, or of its chunk digests.  They
# are different values and are never compared with each other.
DIGESTS = ("sha512", "tree_sha512")


def manifest_schema(digest: str = "sha512") -> T.StructType:
    return T.StructType(
        [
            T.StructField("relative_path", T.StringType(), False),
            T.StructField("size", T.LongType()),
            T.StructField("mtime_ns", T.LongType()),
            T.StructField("ctime_ns", T.LongType()),
            T.StructField(digest, T.BinaryType()),
            T.StructField("bytes_hashed", T.LongType()),  # NULL: hashed to the end
        ]
    )


MANIFEST = manifest_schema()


def changes_schema(digest: str = "sha512") -> T.StructType:
    """Rows that came or replaced others, and paths that went."""
    return manifest_schema(digest).add("removed", T.BooleanType(), False)


ERRORS = T.StructType(
    [
        T.StructField("relative_path", T.StringType()),
        T.StructField("stage", T.StringType()),  # list, hash
        T.StructField("error", T.StringType()),
    ]
)

ROOTS = T.StructType([T.StructField("prefix", T.StringType(), False)])

COMMITS = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType(), False),
        T.StructField("roots", T.ArrayType(T.StringType()), False),
        T.StructField("digest", T.StringType(), False),
        T.StructField("files", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)

# A node is a prefix of ``level`` bits of the path's hash.
TREE = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        *[T.StructField(name, T.LongType(), False) for name in ("node", "rows", "unfinished")],
        *[T.StructField(f"s{i}", T.LongType(), False) for i in range(6)],
    ]
)

STATUSES = ("only_left", "only_right", "mismatch", "unverified", "match")

# What a refresh does with a path.
HASH_ACTIONS = ("ADD", "CHANGED", "REHASH", "RESUME")
DELETE_ACTIONS = ("DELETE_IGNORED", "DELETE_MISSING")
