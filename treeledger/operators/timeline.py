"""What happened to each path over a series of snapshots."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def history(
    snapshots: DataFrame, snapshot_ids: Sequence[int], digest_col: str = "sha512"
) -> DataFrame:
    """Events between neighbouring snapshots: added, removed, changed, unverified.

    ``snapshots`` holds snapshot_id, relative_path and a digest, one row per path
    and snapshot; ``snapshot_ids`` lists every snapshot in order, so that a
    snapshot without any rows still counts.  A window group is one path, with at
    most one row per snapshot.
    """
    ids = F.array(*[F.lit(i).cast("bigint") for i in snapshot_ids])
    by_path = Window.partitionBy("relative_path").orderBy("_at")
    rows = snapshots.select(
        "relative_path",
        F.col(digest_col).alias("_digest"),
        F.array_position(ids, F.col("snapshot_id").cast("bigint")).cast("int").alias("_at"),
    ).where(F.col("_at") > 0)
    seen = rows.select(
        "relative_path",
        "_at",
        "_digest",
        F.lag("_at").over(by_path).alias("_before"),
        F.lag("_digest").over(by_path).alias("_old"),
        F.lead("_at").over(by_path).alias("_after"),
    )
    continues = F.coalesce(F.col("_before") == F.col("_at") - 1, F.lit(False))
    arrived = (
        F.when(~continues, F.when(F.col("_at") > 1, "added"))
        .when(F.col("_digest").isNull() | F.col("_old").isNull(), "unverified")
        .when(F.col("_digest") != F.col("_old"), "changed")
    )
    leaves = (F.col("_at") < len(snapshot_ids)) & (
        F.col("_after").isNull() | (F.col("_after") > F.col("_at") + 1)
    )
    events = F.array(
        F.struct(F.col("_at").alias("at"), arrived.alias("event")),
        F.struct((F.col("_at") + 1).alias("at"), F.when(leaves, "removed").alias("event")),
    )
    return (
        seen.select("relative_path", F.inline(events))
        .where(F.col("event").isNotNull())
        .select(F.element_at(ids, F.col("at")).alias("snapshot_id"), "relative_path", "event")
    )
