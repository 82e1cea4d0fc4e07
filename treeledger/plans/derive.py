"""Manifests and listings derived from the given tables.

Every document stands for a file.  A is the saved copy.  B is a second copy that
has drifted: some files are gone, some have other content or times, some are
unfinished and some are new, by rules on ``doc_id``.  Both come from one pass
over the whole table.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import digest, relative_to
from ..functions.columns import div

EPOCH_NS = 1_700_000_000_000_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _rows(df: DataFrame, path, body, mtime, ctime, unfinished) -> DataFrame:
    size = F.octet_length(body).cast("bigint")
    return df.select(
        path.alias("relative_path"),
        size.alias("size"),
        mtime.cast("bigint").alias("mtime_ns"),
        ctime.cast("bigint").alias("ctime_ns"),
        F.when(~unfinished, digest(body)).alias("sha512"),
        F.when(unfinished, div(size, 2)).alias("bytes_hashed"),
        "source",
        "lang",
    )


def copy_a(documents: DataFrame) -> DataFrame:
    mtime = F.lit(EPOCH_NS) + F.col("doc_id") * 1_000_003
    return _rows(documents, document_path(), F.col("text"), mtime, mtime + 7, F.col("doc_id") % 19 == 6)


def copy_b(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    copies = F.array(F.when(doc % 11 != 3, "kept"), F.when(doc % 13 == 5, "new"))
    rows = documents.withColumn("copy", F.explode(copies)).where(F.col("copy").isNotNull())
    new = F.col("copy") == "new"
    path = F.when(new, F.concat(F.lit("new/"), document_path())).otherwise(document_path())
    base = F.lit(EPOCH_NS) + doc * 1_000_003
    body = F.when(~new & (doc % 7 == 2), F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    mtime = F.when(new, F.lit(EPOCH_NS) + doc).otherwise(base + (doc % 5 == 0).cast("bigint"))
    ctime = F.when(new, F.lit(EPOCH_NS) + doc).otherwise(base + 7 + (doc % 3 == 0).cast("bigint"))
    return _rows(rows, path, body, mtime, ctime, ~new & (doc % 17 == 4))


def copy_c(documents: DataFrame) -> DataFrame:
    """A third state: A with other files gone and other content, all finished."""
    doc = F.col("doc_id")
    rows = documents.where(doc % 10 != 1)
    mtime = F.lit(EPOCH_NS) + doc * 1_000_003
    body = F.when(doc % 6 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return _rows(rows, document_path(), body, mtime, mtime + 9, F.lit(False))


def copy_d(documents: DataFrame) -> DataFrame:
    """Nearly C: few files gone, few with other content, few new ones."""
    doc = F.col("doc_id")
    copies = F.array(F.when((doc % 10 != 1) & (doc % 103 != 5), "kept"), F.when(doc % 107 == 9, "late"))
    rows = documents.withColumn("copy", F.explode(copies)).where(F.col("copy").isNotNull())
    late = F.col("copy") == "late"
    mark = F.when(late, "").when(doc % 101 == 7, "?").when(doc % 6 == 4, "!").otherwise("")
    path = F.when(late, F.concat(F.lit("late/"), document_path())).otherwise(document_path())
    mtime = F.lit(EPOCH_NS) + doc * 1_000_003
    return _rows(rows, path, F.concat("text", mark), mtime, mtime + 9, F.lit(False))


def per_root(manifest: DataFrame) -> DataFrame:
    """The same manifest with one root per source (``new/`` is a root of its own)."""
    first = F.substring_index("relative_path", "/", 1)
    return manifest.withColumns({"prefix": first, "relative_path": relative_to("relative_path", first)})


def as_listing(manifest: DataFrame, *keys: str) -> DataFrame:
    """The listing of a tree with exactly these files."""
    return manifest.select(
        *keys,
        "relative_path",
        F.lit("file").alias("kind"),
        "size",
        "mtime_ns",
        "ctime_ns",
        F.lit(None).cast("boolean").alias("target_exists"),
    )


def document_tree(documents: DataFrame) -> DataFrame:
    """Files and the directories above them, one row each."""
    files = documents.select(
        document_path().alias("relative_path"),
        F.lit("file").alias("kind"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("source").alias("top"),
    )
    above = F.explode(F.array(F.col("source"), F.concat("source", F.lit("/"), "lang")))
    dirs = documents.select(above.alias("relative_path"), F.col("source").alias("top")).distinct()
    return files.unionByName(
        dirs.select("relative_path", F.lit("dir").alias("kind"), F.lit(None).cast("bigint").alias("size"), "top")
    )


def url_path():
    return F.regexp_replace("url", "^https?://[^/]+/|[?#].*$", "")


def drifted_orders(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    copies = F.array(F.when(key % 17 != 4, key), F.when(key % 23 == 6, -key - 1))
    price = F.when(key % 13 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(key % 29 == 8, F.lit(None)).otherwise(F.col("o_orderstatus"))
    return orders.select(
        F.explode(copies).alias("o_orderkey"),
        status.alias("o_orderstatus"),
        price.alias("o_totalprice"),
        "o_orderdate",
    ).where(F.col("o_orderkey").isNotNull())


def drifted_lineitem(lineitem: DataFrame) -> DataFrame:
    key = F.col("l_orderkey") + F.col("l_partkey")
    times = F.when(key % 19 == 3, 0).when(key % 31 == 5, 2).otherwise(1)
    tax = F.when(key % 37 == 7, F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    copies = F.explode(F.array_repeat(F.lit(1), times))
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", tax.alias("l_tax"), copies.alias("_copy")
    ).drop("_copy")


def drifted_documents(documents: DataFrame) -> DataFrame:
    """Some documents gone, some with other text or without a language, some new ones with negative ids."""
    doc = F.col("doc_id")
    kept = documents.where(doc % 11 != 3).select(
        "doc_id",
        F.when(doc % 7 == 2, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"),
        F.when(doc % 13 != 5, F.col("lang")).alias("lang"),
    )
    return kept.union(documents.where(doc % 17 == 4).select(-doc - 1, "text", "lang"))


def drifted_events(events: DataFrame) -> DataFrame:
    """Some events gone, some a microsecond later, some so only in their nested copy, some with other text."""
    event, later = F.col("event_id"), F.expr("ts + INTERVAL '0.000001' SECOND")
    return events.where(event % 9 != 2).select(
        "event_id",
        F.when(event % 5 == 1, later).otherwise(F.col("ts")).alias("ts"),
        "event_type",
        F.when(event % 8 == 6, F.concat("props", F.lit(","))).otherwise(F.col("props")).alias("props"),
        F.array(F.struct(F.when(event % 7 == 3, later).otherwise(F.col("ts")).alias("ts"), "user_id")).alias("marks"),
    )
