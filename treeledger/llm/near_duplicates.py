"""Near-duplicate documents: MinHash bands find pairs, odd sketches screen them, full sets confirm them.

A document is the set of its distinct word shingles.  Two documents are linked if the Jaccard
similarity of their sets is at least the threshold; components of linked documents are groups.

1. Documents with equal sets become one class (one row from here on, however many copies).
2. Each class gets 200 MinHash values for 40 band keys of five values each, and the 1,024 smallest hashes
   of its set (a MinHash sample of another kind, which is the whole set if it is that small), folded into
   an *odd sketch*: a bitmap of 2,048 parity bits, where each sampled hash flips one.  The population
   count of the XOR of two sketches never exceeds the number of hashes in only one of the two samples, and
   is close to it where the similarity is high.
3. Classes that share a band key are candidates.  Not all pairs of a bucket are tested: first each
   member against one centre (the one that shares most band keys, then others), then only those pairs that
   the links found so far have not joined.  A group of thousands of near copies costs one test each.
4. A pair whose sketches differ too much for the threshold, or whose set sizes do, is dropped; the
   others are confirmed on their full sets.  Nothing is capped.

A link at exactly 0.8 is missed with probability (1 - 0.8^5)^40 = 1.2e-7 by the bands and 3e-7 by the
sketch (never by the sketch if both sets have at most 1,024 shingles); both fall quickly above 0.8.

Defined cases: no text or no words: empty set, linked with nothing.  Fewer words than a shingle has:
the whole sequence is one shingle.  Rows with one doc_id are one document: where their texts differ, the groups of
these texts are joined.  A NULL doc_id takes no part: it gets a NULL component and is kept.
"""

import math
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, written
from .components import connected_components, heavy_join

BANDS = 40
ROWS = 5
SAMPLE = 1_024
SKETCH_BITS = 2_048
FOLDED = 8  # words of a folded sketch
BROADCAST_IDS = 400_000  # most classes sent to every task (24 bytes each); more are joined by a shuffle
_MASK = (1 << 64) - 1
_SIGNATURE = "n_shingles long, digest binary, bands array<long>, sketch array<long>"


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (multiply and fold the high half down, twice)."""
    with np.errstate(over="ignore"):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            values = (values ^ (values >> np.uint64(33))) * np.uint64(factor)
        return values ^ (values >> np.uint64(33))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are split at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(word) for word in words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    shingles = np.full(count, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            shingles = _mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return np.unique(shingles)


class _Signer:
    """Signatures of sets: the random multipliers are fixed by a seed."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        samples = BANDS * ROWS
        self.factors = draw.integers(1, _MASK, samples, dtype=np.uint64) | np.uint64(1)
        self.shifts = draw.integers(0, _MASK, samples, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), _MASK, np.uint64)
        with np.errstate(over="ignore"):
            for start in range(0, len(shingles), 512):
                part = shingles[start : start + 512]
                values = self.factors[:, None] * part[None, :]
                values += self.shifts[:, None]
                np.minimum(least, values.min(axis=1), out=least)
        return least

    def sign(self, shingles: np.ndarray) -> tuple[list[int], list[int]]:
        minima = self.minima(shingles)
        key = np.zeros(BANDS, np.uint64)
        with np.errstate(over="ignore"):
            for column in minima.reshape(BANDS, ROWS).T:
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
        # The smallest hashes share their high bits; the low ones say which bit to flip.
        flips = (shingles[:SAMPLE] % np.uint64(SKETCH_BITS)).astype(np.int64)
        parity = np.bincount(flips, minlength=SKETCH_BITS) & 1
        sketch = np.packbits(parity.astype(np.uint8)).view(np.int64)
        return key.view(np.int64).tolist(), sketch.tolist()


def sketch_limit(threshold: float) -> int:
    """The most XORed bits that a pair of large sets at the threshold shows, but for 3 pairs in ten millions.

    Of the smallest ``SAMPLE`` hashes of the union, a binomial number is common, and common to both samples.
    """
    common = SAMPLE * threshold - 5 * math.sqrt(SAMPLE * threshold * (1 - threshold))
    return math.ceil(2 * (SAMPLE - common))


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set, band keys and odd sketch of every document."""

    @F.pandas_udf(_SIGNATURE)
    def sign(texts: pd.Series) -> pd.DataFrame:
        signer, rows = _Signer(), []
        for text in texts:
            shingles = shingle_set(text, shingle_words)
            if len(shingles):
                rows.append((len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), *signer.sign(shingles)))
            else:
                rows.append((0, None, None, None))
        release_memory()
        return pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sketch"])

    signed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sign(F.col("text").cast("binary")).alias("s"))
    return signed.select("doc_id", "text_hash", "s.*")


def _alike(bits, threshold: float):
    """Whether so many XORed bits, and the set sizes of the sides x and y, allow the threshold."""
    small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    share = round(threshold * 100)
    # Whole sets in the sketches: what may lie in only one of them follows from the sizes.
    apart = (small + large) * (100 - share) / (100 + share)
    limit = F.when(large <= SAMPLE, apart).otherwise(F.lit(float(sketch_limit(threshold))))
    return (small * 100 >= large * share) & (bits <= limit)


def _close(threshold: float):
    """The test of two whole sketches."""
    apart = F.zip_with("x.sketch", "y.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return _alike(F.aggregate(apart, F.lit(0), lambda a, b: a + b), threshold)


def _folded() -> list:
    """A sketch's words folded to 512 bits (their XOR is the parity of the same hashes in fewer bins)."""
    words = SKETCH_BITS // 64
    return [
        reduce(lambda a, b: a.bitwiseXOR(b), [F.col("sketch")[i] for i in range(start, words, FOLDED)]).alias(f"w{start}")
        for start in range(FOLDED)
    ]


def _close_when_folded(threshold: float):
    """The same limit for folded sketches, which never show more bits: short enough to be compiled well."""
    bits = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(FOLDED)), F.lit(0))
    return _alike(bits, threshold)


def _screened(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that sketches and sizes let through."""
    side = classes.select("node", "n_shingles", "sketch")
    joined = pairs.join(side.alias("x"), F.col("a") == F.col("x.node"))
    joined = joined.join(side.alias("y"), F.col("b") == F.col("y.node"))
    return joined.where(_close(threshold)).select("a", "b")


def _confirmed(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle_words: int, threshold: float
) -> DataFrame:
    """The pairs whose full sets reach the threshold.  Only texts that occur in a pair are read into sets."""

    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: shingle_set(text, shingle_words).tobytes())

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        share, result = round(threshold * 100), []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            result.append(100 * common >= share * (len(x) + len(y) - common))
        return pd.Series(result, dtype=bool)

    pairs = written(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # An id may have several texts, and a text several rows: one row of the class's first text will do.
    wanted = written(classes.select("node", "doc_id", "text_hash").join(nodes, "node", "left_semi"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(few, ["doc_id", "text_hash"])
    read = texts.select("node", sets(F.col("text").cast("binary")).alias("set"))
    held = written(read.groupBy("node").agg(F.first("set").alias("set")))
    joined = pairs.join(held.alias("y"), F.col("b") == F.col("y.node"))
    joined = joined.join(held.alias("x"), F.col("a") == F.col("x.node"))
    return written(joined.where(alike("x.set", "y.set")).select("a", "b").distinct())


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, node) of the band keys that several classes share, with ``weight``: how many members the
    buckets of the node have together.  Written once; most keys are not shared."""
    bands = classes.select("node", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(bands.join(sizes, "key"))
    weights = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    return written(shared.select("key", "node").join(weights, "node"))


def _starred(buckets: DataFrame, mixing: bool) -> DataFrame:
    """Each bucket's members against its centre: the heaviest one, or any (another in each bucket)."""
    draw = F.xxhash64("node", "key") if mixing else F.struct("weight", F.xxhash64("node"))
    centres = buckets.groupBy("key").agg(
        F.max(F.struct(draw.alias("draw"), "node", "component")).alias("c"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    )
    joined = buckets.join(centres.where("low < high").select("key", "c"), "key")
    different = joined.where(F.col("component") != F.col("c.component"))
    return different.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _crossing(buckets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a bucket that lie in different components, screened inside the join.

    Every such pair has a member outside the bucket's largest component, so only those are held
    against the bucket: members of the largest one never meet each other.
    """
    sizes = buckets.groupBy("key", "component").agg(F.count("*").alias("members"))
    parts = sizes.groupBy("key").agg(
        F.max(F.struct("members", "component"))["component"].alias("main"), F.count("*").alias("components")
    )
    mixed = buckets.join(parts.where("components > 1").select("key", "main"), "key")
    side = classes.select("node", "n_shingles", *_folded())
    mixed = written(mixed.join(side, "node"))
    outside = mixed.where("component <> main").alias("x")
    condition = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    # A pair with both members outside is met twice: keep the order of its nodes.
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    joined = outside.join(mixed.alias("y"), condition & once & _close_when_folded(threshold))
    pairs = joined.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return _screened(pairs.distinct(), classes, threshold)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, shingle_words))
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    # Written, so that the numbers of the classes are fixed.
    classes = whole.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"),
        F.count("*").alias("copies"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    numbered = classes.withColumn("node", F.monotonically_increasing_id())
    classes = written(numbered.select("node", "digest", "least.*", "copies", "n_shingles", "bands", "sketch"))
    buckets = _buckets(classes)
    spark = docs.sparkSession
    components = spark.createDataFrame([], "node long, component long")
    links = _same_ids(signed, classes)
    for step in ("star", "other star", "crossing"):
        labelled = buckets.join(components, "node", "left").select(
            "node", "key", "weight", F.coalesce("component", "node").alias("component")
        )
        if step == "crossing":
            pairs = _crossing(labelled, classes, threshold)
        else:
            pairs = _screened(_starred(labelled, step == "other star"), classes, threshold)
        found = _confirmed(pairs, docs, classes, shingle_words, threshold)
        if not found.isEmpty():
            links = links.unionByName(found)
            components = connected_components(links)
            links = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not links.isEmpty():  # where only repeated ids link
        components = connected_components(links)
    return _named(signed, classes, components)


def _same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the classes in which rows of one id lie (rows without words have none)."""
    pairs = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "digest").distinct()
    several = pairs.groupBy("doc_id").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = pairs.join(several, "doc_id").where("digest <> first").select("digest", "first")
    nodes = classes.select("digest", "node")
    joined = joined.join(nodes.withColumnRenamed("node", "a"), "digest")
    firsts = nodes.select(F.col("digest").alias("first"), F.col("node").alias("b"))
    return written(joined.join(firsts, "first").select("a", "b").distinct())


def _named(signed: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; a component is named by its smallest doc_id."""
    named = classes.select("node", "digest", "doc_id", "copies").join(components, "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    named = written(heavy_join(named, least, "component", "members", named.count()).select("digest", "copies", "component_id"))
    rows = signed.select("doc_id", "n_shingles", "digest")
    whole = "n_shingles > 0 and doc_id is not null"
    linked = heavy_join(rows.where(whole), named, "digest", "copies", signed.count())
    linked = linked.select("doc_id", "n_shingles", "component_id")
    # An empty row of an id that has words elsewhere belongs to that id's group.
    empty = rows.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    groups = linked.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    empty = empty.join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    unnamed = rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    found = linked.unionByName(empty).unionByName(unnamed)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
