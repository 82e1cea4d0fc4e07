"""Token ids as binary files whose document boundaries are Elias-Fano encoded.

The ids of all documents, each ended by ``end_id``, form one array in ascending doc_id order.  It is cut
into segments of whole documents with about ``segment_ids`` ids.  A segment is one row of a Parquet table
(so Spark commits it whole or not at all, on any store it can write to):

    part, segment   place: range of doc_ids, then number within it
    first           ids of the same part before this segment
    doc_ids         its documents, ascending
    ids             their ids, little-endian; two bytes each if the vocabulary allows, else four
    width           bytes per id
    n_docs, n_ids
    low_bits, low, high, samples   Elias-Fano code of where each document ends

Elias-Fano keeps the ``low_bits`` low bits of each end packed, and the high parts as a bitmap in unary:
about 2 + log2(ids / documents) bits a document instead of 64.  ``samples`` holds the position of every
256th set bit, so ``select`` (the end of the i-th document) reads a few bytes.

Defined cases: a NULL or empty text is its end id alone.  NULL doc_ids come last; rows with equal doc_id
are ordered by a hash of their text.  An empty table gives an empty file.  A document longer than a
segment is one.
"""

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets, process_cache, release_memory

END_ID = 2
SEGMENT_IDS = 1 << 20
_SAMPLE = 256
_PIECE_BYTES = 4 << 20  # text encoded at a time: its distinct words go through the tokenizer once
_GROUP = 1_000  # words per call of the tokenizer
_KNOWN_PARTS = 500_000  # parts of words remembered by a worker process; some 50 bytes each
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.int64)
_SEGMENT = (
    "part int, segment int, first long, n_docs long, n_ids long, doc_ids array<long>, width int, ids binary, "
    "low_bits int, low binary, high binary, samples array<long>"
)
_ARROW_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_ARROW_SEGMENT = pa.schema([(name, _ARROW_KINDS[kind]) for name, kind in map(str.split, _SEGMENT.split(", "))])


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples):
        self.count, self.low_bits = count, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values, count = np.asarray(values, np.int64), len(values)
        if not count:
            return cls(0, 0, b"", b"", [])
        low_bits = max(0, int(np.floor(np.log2(max(1, int(values[-1]) / count)))))
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> low_bits) + np.arange(count)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(count, low_bits, low.tobytes(), high.tobytes(), places[::_SAMPLE].tolist())

    def _low(self, i: int) -> int:
        start, stop = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[start // 8 : -(-stop // 8)], "little")
        return (word >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample before it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = place // 8
        held = self.high[byte] >> (place % 8) << (place % 8)  # without the ones before the sample
        while (ones := int(_POPULATION[held])) <= left:
            left -= ones
            byte += 1
            held = self.high[byte]
        for _ in range(left):
            held &= held - 1
        place = byte * 8 + (held & -held).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        high = (np.flatnonzero(bits) - np.arange(self.count)) << self.low_bits
        if not self.low_bits:
            return high
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.count * self.low_bits]
        return high | (low.reshape(self.count, -1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def _gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (of the given sizes, one after the other) numbered by ``index``, joined."""
    each = sizes[index]
    ends = np.cumsum(each, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = (np.cumsum(sizes, dtype=np.int64) - sizes)[index] - (ends - each)
    place = np.repeat(shift.astype(kind), each)
    place += np.arange(total, dtype=kind)
    return flat[place]


class WordEncoder:
    """Encodes texts through the library, each distinct word of a call once.

    For vocabularies that lower-case, mark the ends of words and never join characters across ASCII white
    space, the ids of a text are those of its words one after the other, and those of a word with
    punctuation behind an ASCII letter or digit are those of the two parts.  Other letters may end in a
    combining mark once they are normalised, which the punctuation would join.  Words of letters only are encoded
    many at a time and told apart by the ends of words; should their number not fit, one by one.
    The opened vocabulary and a bounded table of parts of words stay with the worker process.
    """

    def __init__(self, path: str):
        self.path = path

    def _kept(self) -> dict:
        """tokenizer; word_ends: which of its ids end a word; parts known so far, their ids in a row and how many each has."""
        kept = process_cache()
        if self.path not in kept:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)
            ends = np.zeros(tokenizer.get_vocab_size(), bool)
            ends[[number for token, number in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
            kept[self.path] = {"tokenizer": tokenizer, "word_ends": ends}
            self._forget(kept[self.path])
        return kept[self.path]

    def _forget(self, kept: dict) -> None:
        kept |= {"parts": pa.array([], pa.large_string()), "ids": np.zeros(0, np.uint32), "sizes": np.zeros(0, np.int32)}

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of known parts in a row, how many each has, and the number of each of ``parts`` among them."""
        kept = self._kept()
        if len(kept["parts"]) > _KNOWN_PARTS:
            self._forget(kept)
        missing = parts.filter(pc.invert(pc.is_in(parts, value_set=kept["parts"])))
        if len(missing):
            is_word = pc.utf8_is_alpha(missing)
            words, others = missing.filter(is_word), missing.filter(pc.invert(is_word))
            held, sizes = [kept["ids"]], [kept["sizes"]]
            for group in (words, others):
                for start in range(0, len(group), _GROUP):
                    ids, each = self._tokenize(group.slice(start, _GROUP).to_pylist(), group is words)
                    held.append(ids)
                    sizes.append(each)
            kept["parts"] = pa.concat_arrays([kept["parts"], words, others])
            kept["ids"], kept["sizes"] = np.concatenate(held), np.concatenate(sizes)
        return kept["ids"], kept["sizes"], pc.index_in(parts, value_set=kept["parts"]).to_numpy()

    def _tokenize(self, texts: list[str], are_words: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in a row, and how many each has."""
        kept = self._kept()
        tokenizer = kept["tokenizer"]
        if are_words:
            code = tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0]
            ids = np.array(code.ids, np.uint32)
            ends = np.flatnonzero(kept["word_ends"][ids]) + 1
            if len(ends) == len(texts) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0).astype(np.int32)
        codes = [code.ids for code in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in codes for i in ids], np.uint32), np.array([len(ids) for ids in codes], np.int32)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        # A special token is spelt in lower case: lower-casing must not make one.
        lowered = ["" if t is None else (t if b"<|" in t else t.lower()).decode("utf-8", "replace") for t in texts]
        split = pc.ascii_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary
        # Punctuation behind an ASCII letter or digit is a part of its own.
        core = pc.ascii_rtrim(words, characters=".,;:!?")
        apart = pc.and_(pc.not_equal(core, words), pc.match_substring_regex(core, "[A-Za-z0-9]$"))
        tails = pc.replace_substring_regex(words.filter(apart), r"(?s)^.*[^.,;:!?]", "")
        parts = pa.concat_arrays([pc.if_else(apart, core, words), tails]).dictionary_encode()
        flat, sizes, place = self._encode_parts(parts.dictionary)
        number = place[parts.indices.to_numpy()]
        apart = apart.to_numpy(zero_copy_only=False)
        first = np.arange(len(words)) + np.cumsum(apart) - apart
        order = np.empty(len(number), np.int64)
        order[first] = number[: len(words)]
        order[first[apart] + 1] = number[len(words) :]
        word_sizes = sizes[number[: len(words)]]
        word_sizes[apart] += sizes[number[len(words) :]]
        index = coded.indices.to_numpy()
        ids = _gather(_gather(flat, sizes, order), word_sizes, index)
        ends = np.concatenate([[0], np.cumsum(word_sizes[index], dtype=np.int64)])[split.offsets.to_numpy()]
        return [ids[start:end] for start, end in zip(ends, ends[1:], strict=False)]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``_PIECE_BYTES`` of text, or one row with more."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    number = np.cumsum(sizes, dtype=np.int64) // _PIECE_BYTES
    starts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    for start, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
        yield batch.slice(start, stop - start)


def _segments(encoder: WordEncoder, end_id: int, segment_ids: int, width: int):
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of earlier tasks
        part = TaskContext.get().partitionId()
        doc_ids, held, ends, size, first, number = [], [], [], 0, 0, 0

        def row():
            code = EliasFano.encode(np.array(ends))
            values = (part, number, first, len(ends), size, doc_ids, width, np.concatenate(held).tobytes())
            values += (code.low_bits, code.low, code.high, code.samples)
            columns = [pa.array([v], k) for v, k in zip(values, _ARROW_SEGMENT.types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW_SEGMENT)

        for batch in batches:
            for piece in _pieces(batch):
                codes = encoder.encode(piece.column("text").to_pylist())
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), codes, strict=True):
                    doc_ids.append(doc_id)
                    held.append(np.append(ids, np.uint32(end_id)).astype(kind))
                    size += len(ids) + 1
                    ends.append(size)
                    if size >= segment_ids:
                        yield row()
                        number, first = number + 1, first + size
                        doc_ids, held, ends, size = [], [], [], 0
                codes = None
                release_memory()
        if ends:
            yield row()

    return write


def _width(vocabulary: str, end_id: int, width: int | None) -> int:
    """Bytes per id: what is asked for, if all ids fit, else the least that holds them."""
    from tokenizers import Tokenizer

    largest = max([end_id, *Tokenizer.from_file(vocabulary).get_vocab().values()])
    least = 2 if largest < 1 << 16 else 4
    if width is not None and (width not in (2, 4) or width < least):
        raise ValueError(f"width {width} does not hold ids up to {largest}")
    return width or least


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, width: int | None = None
) -> None:
    """Encode every row of ``docs`` (doc_id, text) and write the segments to ``folder``.

    ``width``: bytes per id, 2 or 4; by default 2 for vocabularies whose ids are all below 65,536.
    """
    width = _width(vocabulary, end_id, width)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = _segments(WordEncoder(vocabulary), end_id, segment_ids, width)
    placed.mapInArrow(writer, _SEGMENT).write.mode("overwrite").parquet(folder)


def _with_base(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with ``start``: ids before each one in the whole array."""
    segments = spark.read.schema(_SEGMENT).parquet(folder)
    bases = offsets(segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids")), "part", "n_ids")
    # One row per range of the sort, so as many as that had partitions: small enough for every task.
    joined = segments.join(F.broadcast(bases), "part")
    return joined.withColumn("start", F.col("base") + F.col("first"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array) of every document, from the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, bounds = _opened(row)
                for i, doc_id in enumerate(row.doc_ids):
                    low, high = int(bounds[i]), int(bounds[i + 1])
                    yield pd.DataFrame([(_number(doc_id), row.start + low, ids[low:high].tolist())], columns=["doc_id", "start", "ids"])

    return _with_base(spark, folder).mapInPandas(read, "doc_id long, start long, ids array<int>")


def _number(doc_id) -> int | None:
    return None if pd.isna(doc_id) else int(doc_id)


def _opened(row) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document bounds of a segment row."""
    ids = np.frombuffer(row.ids, "<u2" if row.width == 2 else "<u4")
    ends = EliasFano(row.n_docs, row.low_bits, row.low, row.high, row.samples).values()
    return ids, np.concatenate([[0], ends])


def describe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    import zlib

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, bounds = _opened(row)
                ids = ids.astype("<u4")
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([_number(d) for d in row.doc_ids], "Int64"),
                        "start": row.start + bounds[:-1],
                        "n_tokens": np.diff(bounds),
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])],  # noqa: B905
                    }
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _with_base(spark, folder).mapInPandas(read, schema)


def document_ids(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that doc_id), by ``select`` on its segment."""
    found = _with_base(spark, folder).where(F.array_contains("doc_ids", doc_id)).toLocalIterator()
    result = []
    for row in found:
        ids = np.frombuffer(row.ids, "<u2" if row.width == 2 else "<u4")
        code = EliasFano(row.n_docs, row.low_bits, row.low, row.high, row.samples)
        for i, each in enumerate(row.doc_ids):
            if each == doc_id:
                result.append(ids[code.select(i - 1) if i else 0 : code.select(i)].tolist())
    return result
