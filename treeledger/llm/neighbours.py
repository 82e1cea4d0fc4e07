"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

*Codes.* Unit vectors are centred, turned to their principal axes and then by a learned rotation that
makes their signs lose least (alternating between the signs and the best rotation for them); the signs
are the code.  Several rotations from different starts give a code of at least ``bits`` bits.

*Index.* A code is cut into substrings of 16 bits.  Each block of about ``block_rows`` vectors has one
table per substring, from its value to the vectors that have it.

*Search.* Two codes within Hamming radius r differ in some substring by at most r / substrings.  The
radius grows by one at a time; each step probes one substring's table at its next distance, so that all
codes within r have been met.  It stops when a block has ``enough`` codes within the radius (or all).
These are ranked by the cosine of the original vectors in double precision.

Equal vectors are one class: only classes are indexed and searched, each with its smallest ids, as many
as can be among the answers, so a vector that fills a third of the table is one entry.

Blocks are groups of a hash of the vector, and so are blocks of about ``query_rows`` queries.  Every block
meets every block of queries in a task of its own, which holds these two and nothing else, whatever the
size of the table.  Answers carry the number of the query, not its vector; the best of each block are
merged by a window whose limit Spark applies before the shuffle.

Defined cases: vectors that are NULL, empty, all zero, of another length than most or with a NULL or
non-finite component take no part.  Ties go to the smaller id.  With fewer candidates than ``k`` all are
returned.  Equal rows count once; an id with two vectors is two candidates and two queries, but never a
candidate for its own id.  Rows with a NULL id take no part.
"""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 128
PIECE_BITS = 16
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
ENOUGH = 600
SAMPLE = 4_096


class Rotations:
    """Learned rotations: from vectors to codes."""

    def __init__(self, sample: np.ndarray, bits: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.centre = sample.mean(axis=0)
        spread = sample - self.centre
        axes = np.linalg.eigh(spread.T @ spread)[1]
        turned, parts = spread @ axes, []
        for _ in range(-(-bits // dim)):
            rotation = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
            for _ in range(30):
                signs = np.where(turned @ rotation >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(signs.T @ turned)
                rotation = (left @ right).T
            parts.append(axes @ rotation)
        self.projection = np.concatenate(parts, axis=1)[:, :bits]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        signs = (vectors - self.centre) @ self.projection >= 0
        missing = -signs.shape[1] % PIECE_BITS
        signs = np.pad(signs, ((0, 0), (0, missing)))
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint16)


def _masks(distance: int) -> np.ndarray:
    """All 16-bit values with so many bits set."""
    if not distance:
        return np.zeros(1, np.uint16)
    places = np.array(list(combinations(range(PIECE_BITS), distance)))
    return (1 << places).sum(axis=1).astype(np.uint16)


class MultiIndex:
    """One table per substring: rows sorted by its value, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.pieces = codes, codes.shape[1]
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -self.pieces % 4)))).view(np.uint64)
        self.order = [np.argsort(codes[:, i], kind="stable") for i in range(self.pieces)]
        values = np.arange((1 << PIECE_BITS) + 1)
        self.starts = [np.searchsorted(codes[o, i], values) for i, o in enumerate(self.order)]
        self.masks: dict[int, np.ndarray] = {}

    def _probe(self, piece: int, value: int, distance: int) -> np.ndarray:
        if distance not in self.masks:
            self.masks[distance] = _masks(distance)
        probes = (self.masks[distance] ^ np.uint16(value)).astype(np.int64)
        begin = self.starts[piece][probes]
        size = self.starts[piece][probes + 1] - begin
        full = size > 0
        begin, size = begin[full], size[full]
        steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.order[piece][np.repeat(begin, size) + steps]

    def search(self, code: np.ndarray, enough: int) -> np.ndarray:
        """Rows of all codes within the smallest radius that holds ``enough`` of them."""
        rows = len(self.codes)
        word = np.pad(code, (0, -self.pieces % 4)).view(np.uint64)
        met = np.zeros(rows, bool)
        within = np.zeros(self.pieces * PIECE_BITS + 1, np.int64)  # codes met, by distance
        distances = np.full(rows, -1, np.int64)
        for radius in range(self.pieces * PIECE_BITS + 1):
            piece, distance = radius % self.pieces, radius // self.pieces
            found = self._probe(piece, int(code[piece]), distance)
            found = found[~met[found]]
            if len(found):
                met[found] = True
                apart = np.bitwise_count(self.words[found] ^ word).sum(axis=1)
                distances[found] = apart
                within += np.bincount(apart, minlength=len(within))
            if within[: radius + 1].sum() >= min(enough, rows):
                break
        return np.flatnonzero(met & (distances <= radius))


def _usable(vectors: DataFrame, dim: int | None) -> tuple[DataFrame, int | None]:
    """Vectors that take part, as arrays of doubles, and their length."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("embedding", lambda x: x != 0))
    if dim is None:
        counts = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
        most = counts.orderBy(F.desc("n"), "dim").first()
        dim = most.dim if most else None
    return rows.where(F.size("embedding") == F.lit(dim or 0)), dim


def learn(classes: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> Rotations:
    """Rotations from at most ``sample`` vectors, those with the smallest hash."""
    rows = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).collect()
    vectors = np.array([row.embedding for row in rows], np.float64)
    return Rotations(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), bits)


def _paired(classes: DataFrame, wanted: DataFrame, blocks: int, query_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``block`` and ``query_block``: each class meets each query in one group of the two columns."""

    def every(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    block = F.pmod(F.xxhash64(F.lit(3), "embedding"), F.lit(blocks).cast("long"))
    query_block = F.pmod(F.xxhash64(F.lit(5), "embedding"), F.lit(query_blocks).cast("long"))
    return (
        classes.withColumn("block", block).withColumn("query_block", every(query_blocks)),
        wanted.withColumn("query_block", query_block).withColumn("block", every(blocks)),
    )


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    bits: int = BITS,
    block_rows: int = BLOCK_ROWS,
    enough: int = ENOUGH,
    sample: int = SAMPLE,
    dim: int | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` (vec_id, embedding) to each of ``queries``."""
    usable, dim = _usable(vectors, dim)
    asked = _usable(queries, dim)[0].distinct()
    # The k + 1 smallest ids of a class: all that can be among k answers besides the query itself.
    ids = usable.select("vec_id", "embedding").distinct()
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = ids.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = written(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")))
    count = classes.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotations = learn(classes, bits, sample)
    blocks = -(-count // block_rows)
    # Written, so that its numbers are fixed.
    wanted = written(asked.select("embedding").distinct().withColumn("query", F.monotonically_increasing_id()))
    query_blocks = max(1, -(-wanted.count() // query_rows))
    schema = "query long, members array<long>, score double"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["query", "members", "score"])
        if left.empty or right.empty:
            return empty
        base, query = np.stack(left["embedding"]), np.stack(right["embedding"])
        size, query_size = np.linalg.norm(base, axis=1), np.linalg.norm(query, axis=1)
        index = MultiIndex(rotations.codes(base / size[:, None]))
        codes = rotations.codes(query / query_size[:, None])
        members, numbers, found = left["members"].to_numpy(), right["query"].to_numpy(), []
        for i, code in enumerate(codes):
            rows = index.search(code, enough)
            score = base[rows] @ query[i] / (size[rows] * query_size[i])
            firsts = np.fromiter((members[row][0] for row in rows), np.int64, len(rows))
            for j in np.lexsort((firsts, -score))[: k + 1]:
                found.append((numbers[i], members[rows[j]], float(score[j])))
        return pd.DataFrame(found, columns=["query", "members", "score"]) if found else empty

    base, copies = (side.groupBy("block", "query_block") for side in _paired(classes, wanted, blocks, query_blocks))
    found = base.cogroup(copies).applyInPandas(search, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("members")[0])
    kept = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = written(kept.groupBy("query").agg(F.collect_list(F.struct("score", "members")).alias("near")))
    # Each query against the members of its few classes.
    spread = F.flatten(
        F.transform("near", lambda c: F.transform(c["members"], lambda m: F.struct((-c["score"]).alias("s"), m.alias("m"))))
    )
    # A query's answers come from its own row: rank is the place after sorting.
    rows = asked.join(wanted, "embedding").select(F.col("vec_id").alias("query_id"), "query").join(answers, "query")
    rows = rows.select("query_id", spread.alias("all"))
    own = F.filter("all", lambda c: c["m"] != F.col("query_id"))
    ranked = rows.select("query_id", F.posexplode(F.slice(F.array_sort(own), 1, k)).alias("at", "c"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("c.m").alias("vec_id"),
        (-F.col("c.s")).alias("score"),
    )
