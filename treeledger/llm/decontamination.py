"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Text is normalised to its words, A-Z lower-cased, each between single blanks.  An item's windows are its
runs of ten words (the whole item, if it has fewer).  The automaton holds every window with a blank at
both ends, so that it matches whole words only, and reads each text once, whatever the number of items.
Word numbers and code-point offsets of what it finds refer to the original text.

Items are held in blocks whose windows have at most ``block_bytes`` of text together (or one window), which
bounds the nodes of the automaton; a long item is spread over several.  A larger benchmark is scanned block
after block, keeping of each what it met, and the answers of a row are united, so no task holds more than
one block.

Defined cases: NULL or wordless texts and items have no words and match nothing.  Equal items each count.
An item without an id marks words but is not counted.  Every row of ``docs`` gives one row.
"""

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

WINDOW = 10
BLOCK_BYTES = 4 << 20  # of windows, which overlap: some 0.4 MiB of items
_RUNS = "array<struct<first:long,last:long,start:long,end:long>>"
_RESULT = f"n_words long, items array<string>, hits {_RUNS}"
# A-Z lower-cased, other ASCII but a-z and 0-9 to blanks, everything else as it is.
_NORMAL = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in (ord(chr(b).lower()) if b < 128 else b for b in range(256))
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    if len(words) <= size:
        return [words] if words else []
    return [words[i : i + size] for i in range(len(words) - size + 1)]


class Scanner:
    """The automaton of one block of items; built where it is first used."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.items, self.window, self.automaton = items, window, None

    def _build(self):
        entries: dict[bytes, tuple[int, set]] = {}
        for item, text in self.items:
            for words in windows_of(words_of(text), self.window):
                entries.setdefault(b" " + b" ".join(words) + b" ", (len(words), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, (length, ids) in entries.items():
            self.automaton.add_word(pattern.decode("latin-1"), (length, tuple(ids)))
        if entries:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[str], list[tuple[int, int, int, int]]]:
        """Number of words, ids of the items met, and the runs of hit words with their offsets."""
        if self.automaton is None:
            self._build()
        words = words_of(text)
        if not words or not len(self.automaton):
            return len(words), [], []
        found = list(self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
        if not found:
            return len(words), [], []
        ends = np.cumsum([len(word) + 1 for word in words])
        last = np.searchsorted(ends, [end for end, _ in found])
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, last - np.array([value[0] for _, value in found]) + 1, 1)
        np.add.at(edges, last + 1, -1)
        hit = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
        firsts, stops = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        places = [match.span() for match in re.finditer(rb"[^ ]+", text.translate(_NORMAL))]
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        runs = [
            (int(first), int(stop) - 1, int(points[places[first][0]]), int(points[places[stop - 1][1]]))
            for first, stop in zip(firsts, stops, strict=True)
        ]
        items = {item for _, value in found for item in value[1] if item is not None}
        return len(words), sorted(items), runs


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items, or runs of their windows, in blocks of bounded size, read one partition at a time; at least one block."""
    rows = items.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
    )
    block, size = [], 0
    for row in rows.toLocalIterator():
        words, first = words_of(bytes(row.text)), 0
        count = max(1, len(words) - window + 1) if words else 0
        for i in range(count):
            added = sum(len(word) + 1 for word in words[i : i + window]) + 1
            if size and size + added > block_bytes:
                if i > first:
                    block.append((row.item, b" ".join(words[first : i - 1 + window])))
                yield block
                block, size, first = [], 0, i
            size += added
        if count:
            block.append((row.item, b" ".join(words[first:])))
    yield block


def _scanning(scanner: Scanner):
    @F.pandas_udf(_RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [scanner.scan(text) for text in texts]
        return pd.DataFrame(rows, columns=["n_words", "items", "hits"])

    return scan


def _joining():
    """Runs of several blocks as those of one: in order, without overlap."""

    @F.pandas_udf(_RUNS)
    def join(hits: pd.Series) -> pd.Series:
        result = []
        for runs in hits:
            held = [] if runs is None else runs  # NULL where other blocks met nothing
            joined = []
            for run in sorted((r["first"], r["last"], r["start"], r["end"]) for r in held):
                if joined and run[0] <= joined[-1][1] + 1:
                    joined[-1] = max(joined[-1], (joined[-1][0], run[1], joined[-1][2], run[3]))
                else:
                    joined.append(run)
            result.append(joined)
        return pd.Series(result, dtype=object)

    return join


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "found"
) -> DataFrame:
    """``docs`` with a struct ``name``: n_words, items, and hits (runs of hit words and their offsets)."""
    blocks = _blocks(items, window, block_bytes)
    docs = docs.withColumn(name, _scanning(Scanner(next(blocks), window))(F.col("text").cast("binary")))
    more, row, other = None, free_name(docs, "row"), free_name(docs, "more")
    for block in blocks:
        if more is None:
            # Written, so that its numbers are fixed.
            docs = written(docs.withColumn(row, F.monotonically_increasing_id()))
        found = docs.select(row, _scanning(Scanner(block, window))(F.col("text").cast("binary")).alias("f"))
        part = written(found.where(F.size("f.hits") > 0).select(row, "f.items", "f.hits"))
        more = part if more is None else more.unionByName(part)
    if more is None:
        return docs
    united = more.groupBy(row).agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("hits")).alias("hits")
    )
    docs = docs.join(united.select(row, F.struct("items", "hits").alias(other)), row, "left").drop(row)
    runs = _joining()(F.concat(F.col(name)["hits"], F.col(other)["hits"]))
    both = F.struct(
        F.col(name)["n_words"].alias("n_words"),
        F.array_sort(F.array_union(F.col(name)["items"], F.col(other)["items"])).alias("items"),
        runs.alias("hits"),
    )
    # Written, so that the runs are joined once.
    return written(docs.withColumn(name, F.when(F.col(other).isNull(), F.col(name)).otherwise(both)).drop(other))


def hit_words(hits) -> F.Column:
    """Number of words in a column of runs, which may overlap where they come from several blocks."""
    ordered = F.array_sort(hits)
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("last"))
    return F.aggregate(
        ordered,
        start,
        lambda state, run: F.struct(
            (state["words"] + F.greatest(F.lit(0).cast("long"), run["last"] - F.greatest(run["first"] - 1, state["last"])))
            .alias("words"),
            F.greatest(state["last"], run["last"]).alias("last"),
        ),
        lambda state: state["words"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids in string order), spans and contaminated for every row of ``docs``."""
    found = find_contamination(docs.select("doc_id", "text"), items, window, block_bytes)
    counted = found.select("doc_id", "found.*").withColumn("n_hit", hit_words(F.col("hits")))
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.array_sort("items").alias("items"),
        F.transform("hits", lambda run: F.struct(run["start"], run["end"])).alias("spans"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
