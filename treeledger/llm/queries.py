"""The operators as registered queries: each over its whole table, reduced to comparable columns."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.sources.scratch import fresh_folder

from . import decontamination, language, licences, line_dedup, mixing, near_duplicates, near_vectors, neighbours
from . import repetition, secrets, token_files, toxicity, whitening
from .common import fold, table

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return toxicity.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def count(kind: int) -> Column:  # a lambda's second parameter, even with a default, would be the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    return found.select(
        "doc_id", *map(count, range(3)), F.sha2(secrets.as_text("base"), 256).alias("base_sha256"), secrets.as_text("spans").alias("spans")
    )


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mixed(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_tokens(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_folder(spark)
    token_files.write_tokens(table(spark, folder, "documents"), out, vocabulary())
    return token_files.describe_tokens(spark, out)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(fold("doc_id", 3) != 1))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan_licences(table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_notices", "entire", "text_digest")


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), shingle_words=2)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kept = line_dedup.drop_common_lines(docs, line_dedup.line_index(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where a tenth of the texts, by the CRC-32 of doc_id, repeat a part of themselves from
    some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    whole = F.coalesce(F.pmod(h, F.lit(10)) != 0, F.lit(True))
    # A column of its own, generated, so that the words are looked for once.
    words = F.when(~whole, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.select("doc_id", "text", F.call_function("div", h, F.lit(10)).alias("g"), F.explode(F.array(words)).alias("w"))
    n = F.size("w")
    a = F.pmod("g", n).cast("int")
    p = (1 + F.call_function("div", n - a, 3 + F.pmod("g", F.lit(8)))).cast("int")
    times = F.call_function("div", n - a + p - 1, p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), 1, n - a)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return docs.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = planted(table(spark, folder, "documents").select("doc_id", "text"))
    runs, digest = F.col("found.runs"), lambda column: F.sha2(column, 256)
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    found = repetition.find_runs(docs).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
        digest(text).alias("runs_sha256"), digest("found.collapsed").alias("collapsed_sha256"),
    )
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    milli = F.call_function("div", length * 1000, period)
    return found.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    # NULL where the exact number has no 64-bit form.
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity, op2_decontamination, op3_secrets, op4_neighbours, op5_mixing,
        op6_tokens, op7_language, op8_licences, op9_near_duplicates, op10_line_dedup,
        op11_periodic_runs, op12_near_vectors, op13_whitening,
    ]
    return {query.__name__: query for query in found}
