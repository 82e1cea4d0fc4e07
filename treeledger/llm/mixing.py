"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Every source has a weight; together they share the total size by weight.  A source whose share exceeds
``max_epochs`` times its own size is clamped there, and what it cannot take is shared by the others in
proportion to their weights, until no share is above its cap.

A source takes its documents target / size times: all of them as often as that number is whole, and for
its fraction a seeded sample once more: documents in the order of a seeded digest of doc_id, until the
fraction of the source's words is reached.  The document on which that happens is taken in part (its
first words), so a source takes its target rounded to a word, however long its documents are.

The order within a source is found in two levels, so that a source with a third of all rows is never
sorted in one task: words are summed by source and the first three digits of the digest (4,096 bins);
only the documents of the one bin in which the fraction ends are sorted.

Defined cases: NULL texts have size 0 and are taken never.  Sources are ordered by code point with NULL
(a source of its own) last.  A total of 0 gives targets of 0.  NULL doc_ids share one digest and are
ordered by a digest of their text.  Equal rows take what their place gives them.  Reruns agree.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, ordered_table, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
BROADCAST_SOURCES = 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Each round of the clamping is one aggregate over the sources; what comes back to the driver is two sums.
    """
    placed = ordered_table(sizes, ["source"], "part")
    bases = offsets(placed.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    # As many rows as the sort has partitions: small enough for every task.
    ranked = placed.withColumn("row", within).join(F.broadcast(bases), "part")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("base") + F.col("row") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped = F.lit(False)
    rest, shares = total, None
    cap, before = F.col("source_size") * max_epochs, -1
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("weights"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        rest, shares = total - row.taken, row.weights
        if row.n == before or not shares:
            break
        before = row.n
        # Clamped sources stay so: the share per weight only grows.
        clamped = cap * shares <= F.col("weight") * F.lit(rest)
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(shares or 1))
    return sources.select("source", "source_size", F.when(clamped, cap.cast("double")).otherwise(share).alias("target"))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """doc_id, source, body, size, source_size, target, taken for every row of ``docs``; ``body`` is a digest of the text."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    rows = written(
        docs.select(
            "doc_id", "source", n_words("text").alias("size"), draw.alias("draw"), F.xxhash64("text").alias("body")
        ).withColumn("bin", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    )
    bins = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")))
    sizes = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    wanted = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    targets = written(
        targets.withColumn("whole", whole).withColumn("quota", wanted - whole * F.col("source_size"))
        .withColumnRenamed("source", "named")
    )
    # At most 4,096 rows a source: the bin in which its quota ends, and the words of the bins before it.
    up_to = F.sum("size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    placed = bins.withColumn("up_to", up_to).join(targets, F.col("source").eqNullSafe(F.col("named")))
    ending = placed.where((F.col("up_to") - F.col("size") <= F.col("quota")) & (F.col("up_to") > F.col("quota")))
    last = ending.groupBy("named").agg(
        F.min("bin").alias("last"), F.min(F.struct("bin", F.col("up_to") - F.col("size")))["col2"].alias("before")
    )
    plan = targets.join(last.withColumnRenamed("named", "other"), F.col("named").eqNullSafe(F.col("other")), "left")
    # One row per source: sent to every task while they are few, so that a hot source stays where it lies.
    plan = F.broadcast(plan) if targets.count() <= BROADCAST_SOURCES else plan
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("named")), "left")
    # Without such a bin the quota is 0 words of nothing: no document of the source has a word.
    sorted_bin = F.col("bin") == F.col("last")
    outer = joined.where(~F.coalesce(sorted_bin, F.lit(False))).withColumn(
        "extra", F.when(F.col("bin") < F.col("last"), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "body", "size")
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("quota") - F.col("before") - ahead
    inner = joined.where(sorted_bin).withColumn(
        "extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    )
    return outer.unionByName(inner).select(
        "doc_id",
        "source",
        "body",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + F.col("extra")).cast("long").alias("taken"),
    )


def first_words(text: str | Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, white space kept."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), count.cast("int")), "")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The mix itself: each row as often as it is taken, one of a source's rows in part; columns as in ``docs``.

    ``n_chars``, where there is such a column, follows the text.
    """
    names = docs.columns
    taken = mixed(docs, weights, max_epochs, seed).where("taken > 0")
    # Equal rows (doc_id, text and source) are interchangeable: number them, and the takes of each.
    keys = ["_id", "_source", "_body"]
    same = Window.partitionBy(*keys).orderBy(F.desc("_taken"))
    takes = taken.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("body").alias("_body"),
        F.col("size").alias("_size"), F.col("taken").alias("_taken"),
    ).withColumn("_at", F.row_number().over(same))
    numbered = docs.select(F.struct(*names).alias("_row")).withColumns(
        {"_i": F.col("_row")["doc_id"], "_s": F.col("_row")["source"], "_b": F.xxhash64(F.col("_row")["text"])}
    )
    place = F.row_number().over(Window.partitionBy("_i", "_s", "_b").orderBy("_b"))
    numbered = numbered.withColumn("_n", place)
    on = (
        F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source"))
        & (F.col("_b") == F.col("_body")) & (F.col("_n") == F.col("_at"))
    )
    joined = numbered.join(takes, on)
    copies = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    each = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    part = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    text = F.when(part == F.col("_size"), F.col("_row")["text"]).otherwise(first_words(F.col("_row")["text"], part))
    each = each.withColumn("_text", text)
    columns = []
    for field in docs.schema:
        value = F.col("_row")[field.name]
        if field.name == "text":
            value = F.col("_text")
        elif field.name == "n_chars":
            value = F.when(part == F.col("_size"), value).otherwise(F.length("_text").cast(field.dataType))
        columns.append(value.alias(field.name))
    return each.select(*columns)
