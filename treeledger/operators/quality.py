"""Checking a manifest before it is trusted."""

from pyspark.sql import DataFrame, functions as F

DIGEST_BYTES = 64


def _row_faults(digest_col: str) -> dict:
    path, digest = F.col("relative_path"), F.col(digest_col)
    hashed = F.col("bytes_hashed")
    return {
        "no_path": path.isNull() | (path == ""),
        "digest_length": F.octet_length(digest) != DIGEST_BYTES,
        "zero_digest": F.hex(digest) == "00" * DIGEST_BYTES,
        "bytes_hashed_range": (hashed <= 0) | (hashed >= F.col("size")),
        "complete_without_digest": hashed.isNull() & digest.isNull(),
        "incomplete_with_digest": hashed.isNotNull() & digest.isNotNull(),
    }


def violations(manifest: DataFrame, digest_col: str = "sha512") -> DataFrame:
    """One row per fault: relative_path and what is wrong with it."""
    faults = F.array(*[F.when(bad, name) for name, bad in _row_faults(digest_col).items()])
    per_row = manifest.select("relative_path", F.explode(faults).alias("fault")).where(
        F.col("fault").isNotNull()
    )
    repeated = (
        manifest.where(F.col("relative_path").isNotNull())
        .groupBy("relative_path")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("relative_path", F.lit("duplicate_path").alias("fault"))
    )
    return per_row.unionByName(repeated)


def self_check(manifest: DataFrame, digest_col: str = "sha512") -> DataFrame:
    """One row of counts and ``ok``; rows of a repeated path are counted before the shuffle."""
    faults = _row_faults(digest_col)
    per_path = manifest.groupBy("relative_path").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(bad).alias(name) for name, bad in faults.items()],
    )
    repeated = F.count_if((F.col("_rows") > 1) & F.col("relative_path").isNotNull())
    totals = per_path.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("files"),
        repeated.alias("duplicate_path"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in faults],
    )
    bad = [F.col(name) == 0 for name in ("duplicate_path", *faults)]
    ok = bad[0]
    for condition in bad[1:]:
        ok = ok & condition
    return totals.withColumn("ok", ok)
