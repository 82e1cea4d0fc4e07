"""Line dedup that can be undone: exact reference counts, with sharded cuckoo filters in front.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  The *index* is a table
with one row per key: its 128-bit digest, its shard and the number of documents that hold it.  Adding
or removing documents adds or subtracts their distinct keys, so removing what was added leaves the
index as it was.  Keys in at least ``least_docs`` documents are *common*; their lines are dropped.

Each shard's common keys go into a cuckoo filter (buckets of four 32-bit fingerprints), which takes
insertions and deletions.  A filter answers most look-ups ("not common") without the table.  Since it
may also say yes to another key, the shard lists those of its keys for which it does: filter and list
together are exact for every key of the index.

Where the filters fit ``filter_bytes``, they are sent to all tasks and documents are rewritten where
they lie, without a shuffle.  Beyond that size, the line keys are joined with the table of common keys.
Both ways give the same result.

Defined cases: a NULL or empty text is one empty line.  A key of fewer code points than ``least_chars``
is never common (with the default of 1, the empty line).  A line repeated inside a document counts
once.  Repeated rows are separate documents.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SHARD_KEYS = 1_000_000  # keys a shard holds in the mean: one task's memory
FILTER_BYTES = 64 << 20  # most bytes of filters sent to every task
_KICKS = 500
_SPACE = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _code_points(key: bytes) -> int:
    return sum((byte & 0xC0) != 0x80 for byte in key) if len(key) < 8 else len(key.decode("utf-8", "replace"))


def _digest(key: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_digest(key)
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; a key lies in one of two buckets.

    ``lo`` of a key's digest gives the fingerprint, ``hi`` the bucket.  An insertion that finds no room
    keeps the fingerprint in a small overflow, so no key is ever lost.
    """

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / 3.4))))
        self.slots = np.zeros((self.buckets, 4), np.uint32)
        self.overflow: list[tuple[int, int]] = []

    @staticmethod
    def _mark(lo: int) -> int:
        return (lo & 0xFFFFFFFF) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def _places(self, hi: int, lo: int) -> tuple[int, int, int]:
        mark = self._mark(lo)
        bucket = (hi >> 16) & (self.buckets - 1)
        return mark, bucket, self._other(bucket, mark)

    def insert(self, hi: int, lo: int) -> None:
        mark, first, second = self._places(hi, lo)
        for bucket in (first, second):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return
        bucket = first
        for kick in range(_KICKS):
            slot = (mark + kick) & 3
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return
        self.overflow.append((min(bucket, self._other(bucket, mark)), mark))

    def delete(self, hi: int, lo: int) -> bool:
        """Take one copy of a key that was inserted; whether there was one."""
        mark, first, second = self._places(hi, lo)
        for bucket in (first, second):
            held = np.flatnonzero(self.slots[bucket] == mark)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return True
        entry = (min(first, second), mark)
        if entry in self.overflow:
            self.overflow.remove(entry)
            return True
        return False

    def __contains__(self, key: tuple[int, int]) -> bool:
        return bool(self.contains(np.array([key[0]]), np.array([key[1]]))[0])

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        marks = (lo.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32)
        marks[marks == 0] = 1
        first = (hi.astype(np.int64) >> 16) & (self.buckets - 1)
        second = first ^ ((marks.astype(np.int64) * 0x5BD1E995 >> 7) & (self.buckets - 1))
        found = (self.slots[first] == marks[:, None]).any(axis=1) | (self.slots[second] == marks[:, None]).any(axis=1)
        if self.overflow:
            extra = set(self.overflow)
            places = zip(np.minimum(first, second).tolist(), marks.tolist(), strict=True)
            found |= np.fromiter((place in extra for place in places), bool, len(marks))
        return found


def _distinct_keys(least_chars: int):
    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = [], []
            for text in batch.column(0):
                keys = {line_key(line) for line in (text.as_py() or b"").split(b"\n")}
                for key in keys:
                    if _code_points(key) >= least_chars:
                        hi, lo = _digest(key)
                        high.append(hi)
                        low.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["hi", "lo"])

    return batches


def document_keys(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(hi, lo): one row per document and distinct key."""
    return docs.select(F.col("text").cast("binary")).mapInArrow(_distinct_keys(least_chars), "hi long, lo long")


def line_index(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """The reference counts: hi, lo, n_docs."""
    return written(document_keys(docs, least_chars).groupBy("hi", "lo").agg(F.count("*").alias("n_docs")))


def add_documents(index: DataFrame, docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """The index with the documents' lines added."""
    delta = document_keys(docs, least_chars).groupBy("hi", "lo").agg(F.count("*").alias("n_docs"))
    return written(index.unionByName(delta).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs")))


def remove_documents(index: DataFrame, docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """The index without the documents, which must have been added before; a count below zero is an error."""
    delta = document_keys(docs, least_chars).groupBy("hi", "lo").agg((-F.count("*")).alias("n_docs"))
    summed = index.unionByName(delta).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"))
    checked = summed.withColumn(
        "n_docs",
        F.when(F.col("n_docs") < 0, F.raise_error(F.lit("a removed document was never added")).cast("long"))
        .otherwise(F.col("n_docs")),
    )
    return written(checked.where("n_docs > 0"))


def shard_filters(index: DataFrame, least_docs: int, shards: int) -> DataFrame:
    """shard, buckets, slots, overflow, false_hi, false_lo: the filter of each shard's common keys, and
    the other keys of the shard that it would let through."""
    schema = (
        "shard long, buckets long, slots binary, over_bucket array<long>, over_mark array<long>, "
        "false_hi array<long>, false_lo array<long>"
    )

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hi, lo = rows["hi"].to_numpy(), rows["lo"].to_numpy()
        common = rows["n_docs"].to_numpy() >= least_docs
        cuckoo = CuckooFilter(int(common.sum()))
        for pair in zip(hi[common].tolist(), lo[common].tolist(), strict=True):
            cuckoo.insert(*pair)
        false = ~common & cuckoo.contains(hi, lo)
        over = list(zip(*cuckoo.overflow, strict=True)) or [(), ()]
        row = (key[0], cuckoo.buckets, cuckoo.slots.tobytes(), list(over[0]), list(over[1]), hi[false], lo[false])
        return pd.DataFrame([row], columns=[part.split()[0] for part in schema.split(", ")])

    return index.groupBy(F.pmod("hi", F.lit(shards)).alias("shard")).applyInPandas(build, schema)


class _Common:
    """Exact test for common keys from the collected shards."""

    def __init__(self, rows: list, shards: int):
        self.shards, self.filters, self.false = shards, {}, set()
        for row in rows:
            cuckoo = CuckooFilter(1)
            cuckoo.buckets = row.buckets
            cuckoo.slots = np.frombuffer(row.slots, np.uint32).reshape(row.buckets, 4)
            cuckoo.overflow = list(zip(row.over_bucket, row.over_mark, strict=True))
            self.filters[row.shard] = cuckoo
            self.false.update(zip(row.false_hi, row.false_lo, strict=True))

    def test(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found, shard = np.zeros(len(hi), bool), hi % self.shards
        for number in np.unique(shard).tolist():
            if number in self.filters:
                own = shard == number
                found[own] = self.filters[number].contains(hi[own], lo[own])
        for i in np.flatnonzero(found).tolist() if self.false else ():
            found[i] = (int(hi[i]), int(lo[i])) not in self.false
        return found


def _rewriting(common: _Common, least_chars: int):
    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def rewrite(texts: pd.Series) -> pd.DataFrame:
        lines = [(text or b"").split(b"\n") for text in texts]
        keys = [line_key(line) for each in lines for line in each]
        digests = np.array([_digest(key) for key in keys], np.int64).reshape(-1, 2)
        drop = common.test(digests[:, 0], digests[:, 1])
        drop &= np.fromiter((_code_points(key) >= least_chars for key in keys), bool, len(keys))
        rows, start = [], 0
        for each in lines:
            own = drop[start : start + len(each)]
            start += len(each)
            kept = b"\n".join(line for line, gone in zip(each, own, strict=True) if not gone)
            rows.append((len(each), int(own.sum()), kept.decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    return rewrite


def _numbered(docs: DataFrame, least_chars: int) -> DataFrame:
    """One row per line: the text's digest, the line's number and key."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(0):
                text = text.as_py() or b""
                for number, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _code_points(key) >= least_chars:
                        for column, value in zip(columns, (xxhash.xxh3_128_digest(text), number, *_digest(key)), strict=True):
                            column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["body", "number", "hi", "lo"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(lines, "body binary, number long, hi long, lo long")


def _joined(docs: DataFrame, common: DataFrame, least_chars: int) -> DataFrame:
    """The way for filters of any size: line keys meet the common keys in a join."""

    @F.pandas_udf("binary")
    def body(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: xxhash.xxh3_128_digest(text or b""))

    hits = _numbered(docs, least_chars).distinct().join(common.select("hi", "lo"), ["hi", "lo"], "left_semi")
    dropped = hits.groupBy("body").agg(F.collect_set("number").alias("gone"))  # at most one document's lines
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.withColumn("body", body(F.col("text").cast("binary"))).join(dropped, "body", "left")
    gone = F.coalesce("gone", F.array().cast("array<long>"))
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone, i.cast("long")))
    return rows.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )


def drop_common_lines(
    docs: DataFrame,
    index: DataFrame,
    least_docs: int = 10,
    least_chars: int = 1,
    filter_bytes: int = FILTER_BYTES,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row of ``docs``, whose lines the index counts."""
    docs = docs.select("doc_id", "text")
    shards = max(1, -(-index.count() // shard_keys))
    filters = written(shard_filters(index, least_docs, shards))
    held = F.length("slots") + 16 * (F.size("over_mark") + F.size("false_hi"))
    size = filters.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    if size > filter_bytes:
        return _joined(docs, index.where(F.col("n_docs") >= least_docs), least_chars)
    rewrite = _rewriting(_Common(filters.collect(), shards), least_chars)
    return docs.select("doc_id", rewrite(F.col("text").cast("binary")).alias("r")).select("doc_id", "r.*")
