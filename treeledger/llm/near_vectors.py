"""Near-duplicate vectors by product quantisation: all links at a cosine of ``threshold`` or more, and their groups.

*Classes.*  Equal vectors are one class from here on, however many rows they fill.

*Model*, from a sample of bounded size: coarse centroids (k-means; a neighbourhood that holds 1 % of the sample or more
gets a centroid of its own first) and, for the residuals from them, a codebook of at most 256 words in each of
``SUBSPACES`` subspaces.

*Index.*  Every class goes to the list of its nearest centroid with its residual's codes and the length of what the codes
leave out.  The *core* of a list are the classes within half the search radius of its centroid: any two of them
are linked, by the triangle inequality, so they are counted and never compared.  A group of near copies that
holds a third of all rows is such a core, and costs one row each.

*Probes.*  Unit vectors at the threshold are r = sqrt(2 - 2 threshold) apart.  A class is held against its own list, and
against each later list whose bisecting plane is within ``SIGMAS`` standard deviations of where a neighbour at
distance r in a random direction of the space falls (r / sqrt(dimensions) each).  So each pair of lists is met from one side.

*Search.*  Lists are cut in blocks, and so are the classes that probe them; each task holds one of each.  Distances from
tables of query subspace to code words (asymmetric: the query is not coded) leave out what cannot be a link: the true distance is never
shorter than the table's less the length that the codes leave out, so no met pair is lost here.  The others are
confirmed by the cosine of the original vectors in double precision.  A task returns, for each class it linked, how many rows it
is linked with and the smallest class of its group in this task; pairs never leave it.

Defined cases: vectors that are NULL, empty, all zero, of another length than most or with NULL or non-finite entries
link with nothing.  Equal rows are separate vectors, linked with each other.  Rows with one vec_id are one node: their groups are joined.
A NULL vec_id takes no part: no links, NULL component, kept.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, written
from .components import connected_components, heavy_join

THRESHOLD = 0.9
SUBSPACES = 8
WORDS = 256
LIST_ROWS = 1_024  # classes of a list, as long as the sample allows so many lists
MAX_LISTS = 4_096
SAMPLE = 8_192  # vectors learned from: at least; 16 a list
SIGMAS = 2.0
BLOCK_ROWS = 4_096
MAX_TASKS = 20_000
QUERIES_AT_ONCE = 256
_SLACK = 1e-4  # of single precision in the tables
_CORE_SLACK = 1e-9


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow on the way."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    apart = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.maximum(apart, 0)


def _k_means(points: np.ndarray, count: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most ``count`` centroids; starting points are drawn by squared distance from those before."""
    chosen = [points[draw.integers(len(points))]]
    nearest = _squares(points, chosen[0][None])[:, 0]
    while len(chosen) < count and nearest.sum() > 1e-12 * len(points):
        chosen.append(points[draw.choice(len(points), p=nearest / nearest.sum())])
        nearest = np.minimum(nearest, _squares(points, chosen[-1][None])[:, 0])
    centres = np.array(chosen)
    for _ in range(rounds):
        own = _squares(points, centres).argmin(axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, column, minlength=len(centres)) for column in points.T], axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float, seed: int = 13):
        draw = np.random.default_rng(seed)
        hot, rest = self._crowded(sample, radius)
        if len(rest):
            cold = _k_means(rest, max(1, min(lists, len(rest))), draw)
            hot = np.concatenate([hot, cold]) if len(hot) else cold
        self.centres = hot
        residuals = sample - self.centres[_squares(sample, self.centres).argmin(axis=1)]
        dim = sample.shape[1]
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        parts = zip(self.cuts, self.cuts[1:], strict=False)
        self.books = [_k_means(residuals[:, a:b], WORDS, draw, 8) for a, b in parts]

    @staticmethod
    def _crowded(sample: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Centres of neighbourhoods that hold 1 % of the sample, and the sample without them."""
        some, centres = sample[: SAMPLE // 2], []
        least = max(16, len(some) // 100)
        close = _squares(some, some) <= (radius / 2) ** 2
        while True:
            crowd = close.sum(axis=1)
            most = int(crowd.argmax())
            if crowd[most] < least:
                break
            centres.append(some[close[most]].mean(axis=0))
            gone = _squares(some, centres[-1][None])[:, 0] <= radius**2
            gone |= close[most]
            close[gone] = False
            close[:, gone] = False
        if not centres:
            return np.empty((0, sample.shape[1])), sample
        far = _squares(sample, np.array(centres)).min(axis=1) > radius**2
        return np.array(centres), sample[far]

    def place(self, units: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each row's list, its distance from the centroid, and the later lists whose plane is within ``reach``."""
        squares = _squares(units, self.centres)
        own = squares.argmin(axis=1)
        nearest = squares[np.arange(len(units)), own]
        apart = np.sqrt(_squares(self.centres[own], self.centres))
        plane = (squares - nearest[:, None]) / np.maximum(2 * apart, 1e-12)
        later = (plane <= reach) & (np.arange(len(self.centres))[None, :] > own[:, None])
        return own, np.sqrt(nearest), [np.flatnonzero(row) for row in later]

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, one byte a subspace, and the length of what they leave out."""
        codes, left = [], np.zeros(len(residuals))
        for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False):
            squares = _squares(residuals[:, a:b], book)
            code = squares.argmin(axis=1)
            left += squares[np.arange(len(code)), code]
            codes.append(code)
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(left)

    def distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """From each query residual to each coded row: sums of table entries."""
        total = np.zeros((len(residuals), len(codes)), np.float32)
        for i, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            total += _squares(residuals[:, a:b], book).astype(np.float32)[:, codes[:, i]]
        return np.sqrt(total)


def _groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of rows and columns that the true cells join; -1 without any."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for start in np.flatnonzero(linked.any(axis=1)):
        if rows[start] >= 0:
            continue
        fresh = np.array([start])
        rows[start] = start
        while len(fresh):
            met = np.flatnonzero(linked[fresh].any(axis=0) & (columns < 0))
            columns[met] = start
            fresh = np.flatnonzero(linked[:, met].any(axis=1) & (rows < 0)) if len(met) else met
            rows[fresh] = start
    return rows, columns


def _sums(linked: np.ndarray, weights: np.ndarray, columns: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the links of each row weigh, by the ``weights`` of columns, and of each column, by those of the rows counted."""
    rows, across = np.zeros(len(linked), np.int64), np.zeros(linked.shape[1], np.int64)
    for start in range(0, len(linked), QUERIES_AT_ONCE):
        part = slice(start, start + QUERIES_AT_ONCE)
        cells = linked[part].astype(np.int64)
        rows[part] = cells @ columns
        across += (weights[part] * counted[part]) @ cells
    return rows, across


def confirmed(model: Quantiser, base: pd.DataFrame, asked: pd.DataFrame, threshold: float) -> np.ndarray:
    """Cells (query, row of the block) of one list that are links."""
    own, wanted = (np.stack(side["embedding"].to_numpy()).astype(np.float64) for side in (base, asked))
    own, wanted = (side / np.abs(side).max(axis=1, keepdims=True) for side in (own, wanted))
    own_size, size = np.linalg.norm(own, axis=1), np.linalg.norm(wanted, axis=1)
    codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), -1)
    limit = math.sqrt(2 - 2 * threshold) + base["left_out"].to_numpy() + _SLACK
    centre = model.centres[int(base["list"].iloc[0])]
    nodes, ids = base["node"].to_numpy(), asked["node"].to_numpy()
    linked = np.zeros((len(asked), len(base)), bool)
    for start in range(0, len(asked), QUERIES_AT_ONCE):
        part = slice(start, start + QUERIES_AT_ONCE)
        close = model.distances(wanted[part] / size[part, None] - centre, codes) <= limit
        left, right = np.nonzero(close & (ids[part, None] != nodes[None, :]))
        left += start
        for at in range(0, len(left), 1 << 17):
            i, j = left[at : at + (1 << 17)], right[at : at + (1 << 17)]
            cosine = np.einsum("ij,ij->i", wanted[i], own[j]) / (size[i] * own_size[j])
            hit = cosine >= threshold
            linked[i[hit], j[hit]] = True
    return linked


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (NULL where it takes no part) of the rows with an id."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    item = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~item & F.exists("embedding", lambda x: x != 0), F.lit(False))
    lengths = rows.where(good).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    good = good & (F.size("embedding") == F.lit(most.dim if most else 0))
    return rows.withColumn("embedding", F.when(good, F.col("embedding")))


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, key and embedding: equal vectors have equal keys (128 bits of hashes); rows that take no part are keyed by id."""
    one = F.coalesce(F.xxhash64(F.lit(1), "embedding").cast("string"), F.lit("-"))
    vector = F.concat_ws(":", one, F.xxhash64(F.lit(2), "embedding").cast("string"))
    nothing = F.concat(F.lit("-:"), F.col("vec_id").cast("string"))
    key = F.when(F.col("embedding").isNull(), nothing).otherwise(vector)
    return _usable(vectors).select("vec_id", key.alias("key"), "embedding")


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    list_rows: int = LIST_ROWS,
    sample: int = SAMPLE,
    sigmas: float = SIGMAS,
) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id of the group) and kept for every row of ``vectors``."""
    rows = _keyed(vectors)
    classes = rows.groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    # Written, so that its numbers are fixed.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    found = _linked(classes.where("embedding is not null"), threshold, list_rows, sample, sigmas)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(_same_ids(rows, classes))
    named = classes.select("node", "key", "id", "copies", F.col("embedding").isNotNull().alias("usable"))
    named = named.join(connected_components(edges), "node", "left").join(sums, "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    others = F.when(F.col("usable"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    found = heavy_join(named, written(least), "component", "members", named.count()).select(
        "key", "copies", "component_id", others.cast("long").alias("n_links")
    )
    keyed = written(rows.select("vec_id", "key"))
    shown = heavy_join(keyed, written(found), "key", "copies", keyed.count())
    shown = shown.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    nothing = F.lit(None).cast("long")
    missing = vectors.where("vec_id is null").select(
        nothing.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), nothing.alias("component_id"), F.lit(True).alias("kept")
    )
    return shown.unionByName(missing)


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes that rows of one id lie in."""
    pairs = rows.select("vec_id", "key").distinct()
    several = pairs.groupBy("vec_id").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = pairs.join(several, "vec_id").where("key <> first").select("key", "first")
    nodes = classes.select("key", "node")
    joined = joined.join(nodes.withColumnRenamed("node", "a"), "key")
    firsts = nodes.select(F.col("key").alias("first"), F.col("node").alias("b"))
    return joined.join(firsts, "first").select("a", "b")


def _linked(classes: DataFrame, threshold: float, list_rows: int, sample: int, sigmas: float) -> DataFrame:
    """node, links (rows linked with it) and other (a class of its group): any number of rows a class, one a task that
    links it."""
    count, radius = classes.count(), math.sqrt(2 - 2 * threshold)
    if not count:
        return classes.sparkSession.createDataFrame([], "node long, links long, other long")
    lists = max(1, min(count // list_rows, MAX_LISTS))
    picked = classes.select("key", "embedding").orderBy(F.xxhash64("key"), "key").limit(max(sample, 16 * lists))
    learned = np.stack(picked.toPandas()["embedding"].to_numpy()).astype(np.float64)
    model = Quantiser(_units(learned), lists, radius)
    index = written(_indexed(classes, model, radius, sigmas * radius / math.sqrt(learned.shape[1])))
    # A class probes the rest of its own list and both parts of later ones; the core is never held against itself.
    own = F.struct(F.col("list").alias("at"), F.lit(False).alias("core"), (~F.col("core")).alias("within"))

    def part(at, core):
        return F.struct(at.alias("at"), F.lit(core).alias("core"), F.lit(False).alias("within"))

    later = F.flatten(F.transform("later", lambda at: F.array(part(at, False), part(at, True))))
    probes = index.select("node", "copies", "embedding", F.inline(F.concat(F.array(own), later)))
    base = index.select("node", "copies", "embedding", "list", "core", "codes", "left_out")
    base, asked, groups = _blocks(base, probes.withColumnRenamed("at", "list"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
        if left.empty or right.empty:
            return empty
        linked = confirmed(model, left, right, threshold)
        if not linked.any():
            return empty
        # Inside the rest of a list each pair is met from both sides: there the query's side alone is counted.
        counted = ~right["within"].to_numpy(bool)
        weights, columns = (side["copies"].to_numpy(np.int64) for side in (right, left))
        links = np.concatenate(_sums(linked, weights, columns, counted))
        group = np.concatenate(_groups(linked))
        found = pd.DataFrame({"node": pd.concat([right["node"], left["node"]]).to_numpy(), "links": links, "group": group})
        found = found[found["group"] >= 0]
        found["other"] = found.groupby("group")["node"].transform("min")
        release_memory()
        return found[["node", "links", "other"]]

    keys = ["list", "core", "block", "query_block"]
    # As many partitions as groups (up to a bound), which are not merged again by their bytes.
    sides = (side.repartition(max(1, min(groups, MAX_TASKS)), *keys).groupBy(*keys) for side in (base, asked))
    pieces = next(sides).cogroup(next(sides)).applyInPandas(search, "node long, links long, other long")
    cores = index.where("core").groupBy("list").agg(
        F.min("node").alias("other"), F.sum("copies").alias("all"), F.count("*").alias("n")
    )  # at most one row a list
    sure = index.where("core").join(F.broadcast(cores.where("n > 1")), "list")
    sure = sure.select("node", (F.col("all") - F.col("copies")).alias("links"), "other")
    return written(pieces.unionByName(sure))


def _indexed(classes: DataFrame, model: Quantiser, radius: float, reach: float) -> DataFrame:
    """The classes with list, core, codes, left_out and the later lists to probe."""

    @F.pandas_udf("list int, core boolean, codes binary, left_out double, later array<int>")
    def place(columns: pd.Series) -> pd.DataFrame:
        rows = []
        for start in range(0, len(columns), 512):
            units = _units(np.stack(columns.iloc[start : start + 512].to_numpy()).astype(np.float64))
            own, distance, later = model.place(units, reach)
            codes, left = model.encode(units - model.centres[own])
            core = distance <= radius / 2 - _CORE_SLACK
            rows += zip(own.tolist(), core.tolist(), map(bytes, codes), left.tolist(), map(list, later), strict=True)
        release_memory()
        return pd.DataFrame(rows, columns=["list", "core", "codes", "left_out", "later"])

    columns = ["node", "copies", "embedding"]
    return classes.select(*columns, place("embedding").alias("p")).select(*columns, "p.*")


def _blocks(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both with block and query_block: each class of a part of a list meets each class that probes it in one group.
    Also the number of groups."""
    sizes = index.groupBy("list", "core").agg(F.count("*").alias("n"))
    wanted = asked.groupBy("list", "core").agg(F.count("*").alias("m"))
    parts = [F.ceil(F.col(c) / BLOCK_ROWS).alias(name) for c, name in (("n", "blocks"), ("m", "query_blocks"))]
    cuts = written(sizes.join(wanted, ["list", "core"]).select("list", "core", *parts))  # at most two rows a list

    def number(parts: str, seed: int):
        return F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(parts))

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))

    index, asked = (side.join(F.broadcast(cuts), ["list", "core"]) for side in (index, asked))
    index = index.withColumn("block", number("blocks", 3)).withColumn("query_block", every("query_blocks"))
    asked = asked.withColumn("query_block", number("query_blocks", 5)).withColumn("block", every("blocks"))
    # Columns of their own for one side, as both come from one table.
    return (
        index.drop("blocks", "query_blocks"),
        asked.select(*[F.col(c).alias(c) for c in asked.columns if c not in ("blocks", "query_blocks")]),
        cuts.agg(F.sum(F.col("blocks") * F.col("query_blocks"))).first()[0] or 0,
    )
