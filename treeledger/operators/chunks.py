"""Digests of large content put together from chunk digests.

A file's ``tree_sha512`` is the SHA-512 of its chunk digests in order.  Where
there are more than ``FAN_OUT`` of them, runs of that many are digested first and
the same is done with the results, so that no group of rows outgrows ``FAN_OUT``
whatever the size of the file.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import digest
from ..functions.columns import div

FAN_OUT = 1024


def text_chunks(
    df: DataFrame, key_cols: Sequence[str], content: Column, chunk_bytes: int, bits: int = 512
) -> DataFrame:
    """Chunk digests of a string or binary column: key, chunk_no, digest, chunks.

    A NULL column has one chunk with a NULL digest.

    The bytes are read as Latin-1, one character each, and cut by one pass of a
    regular expression; taking substrings instead would copy the whole content
    once per chunk.
    """
    data = content.cast("binary")
    pieces = F.regexp_extract_all(
        F.decode(data, "ISO-8859-1"), F.lit(f"(?s).{{1,{chunk_bytes}}}"), F.lit(0)
    )
    cut = df.select(
        *key_cols,
        F.when(F.octet_length(data) == 0, F.array(F.lit(""))).otherwise(pieces).alias("_pieces"),
        F.greatest(
            div(F.octet_length(content).cast("bigint") + chunk_bytes - 1, chunk_bytes), F.lit(1)
        ).alias("chunks"),
    )
    # The outer form keeps rows without pieces, whose content is NULL.
    rows = cut.select(*key_cols, "chunks", F.posexplode_outer("_pieces").alias("_no", "_piece"))
    return rows.select(
        *key_cols,
        F.coalesce("_no", F.lit(0)).cast("bigint").alias("chunk_no"),
        digest(F.encode("_piece", "ISO-8859-1"), bits).alias("digest"),
        "chunks",
    )


def tree_digest(
    chunks: DataFrame,
    key_cols: Sequence[str],
    max_chunks: int,
    bits: int = 512,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """One digest per key from rows of key, chunk_no, digest and chunks (how many there are).

    NULL where chunks are missing.  ``max_chunks`` bounds the chunks of any key; a key with more fails the job.
    """
    keys = list(key_cols)
    nodes = chunks.select(
        *keys,
        F.col("chunk_no").alias("_no"),
        "digest",
        F.col("chunks").alias("_of"),
        F.lit(False).alias("_root"),
    )
    levels, left = 1, -(-max_chunks // fan_out)
    while left > 1:
        levels, left = levels + 1, -(-left // fan_out)
    for _ in range(levels):
        runs = nodes.groupBy(*keys, div(F.col("_no"), fan_out).alias("_no"), "_of", "_root").agg(
            F.count("digest").alias("_known"),
            F.sort_array(F.collect_list(F.struct("_no", F.hex("digest").alias("hex")))).alias("_parts"),
        )
        joined = F.unhex(F.array_join("_parts.hex", ""))
        expected = F.least(F.lit(fan_out).cast("bigint"), F.col("_of") - F.col("_no") * fan_out)
        node = F.when(F.col("_root"), joined).when(F.col("_known") == expected, digest(joined, bits))
        nodes = runs.select(
            *keys,
            "_no",
            node.alias("digest"),
            div(F.col("_of") + fan_out - 1, fan_out).alias("_of"),
            (F.col("_root") | (F.col("_of") <= fan_out)).alias("_root"),
        )
    short = F.raise_error(F.lit(f"a key has more than {max_chunks} chunks")).cast("binary")
    return nodes.select(*keys, F.when(F.col("_root"), F.col("digest")).otherwise(short).alias("tree_digest"))
