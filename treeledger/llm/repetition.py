"""Periodic runs of words, found by seeds on diagonals.

A *run* is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(min_words, 2 q)`` words that neither neighbour extends.  On the diagonal of lag q it is a stretch of
matches, word i = word i + q, at least ``max(min_words - q, q)`` long, and that bounds the seeds:

1. *Index.*  Lags below 12 guarantee 6 matching words in a row, so every 6-gram is a seed for them.  Lags from
   2k to 4k guarantee 2k, which holds a k-gram at a multiple of k: of k = 6, 12, 24, ... only those k-grams are
   seeds.  Equal k-grams of a document have one number, made exactly from the numbers of their halves.
2. *Occurrence pairs.*  A seed meets the occurrences of its k-gram in the same document at the lags of its class
   only: at most two pairs per word and class, also in a text that repeats one word.
3. *Furthest covered.*  Seeds are taken by lag and place; one that touches what its lag has covered so far
   belongs to the stretch already extended and is skipped.
4. *Extension.*  The first seed of a stretch is extended to both sides by the largest equal k-grams, halving.
   Stretches long enough are runs; where several lags give one stretch of words the smallest is its period (the others are
   its multiples).

Documents are worked on in groups of about 50,000 words, whose tables fit a processor's cache.  Time is proportional to words times the logarithm of
the longest document, and so is memory where a text is periodic throughout (levels of k-grams stop
where none repeats).

Defined cases: NULL and empty texts have no words and no runs.  Words are split at ASCII white space.  Repeated rows and rows
with NULL ids are treated alike, as the column is made row by row; an existing column is replaced only if it
has the name asked for.  Text that is not UTF-8 keeps its bytes.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

MIN_WORDS = 12
GROUP_WORDS = 50_000
PAIRS_AT_ONCE = 4_000_000
_FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _numbered(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all places: equal keys at ``places`` share one, every other place has its own, negative.
    Also the places whose key is repeated."""
    numbers = -1 - np.arange(size, dtype=np.int64)
    if not len(keys):
        return numbers, places
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    repeated = np.bincount(group)[group] > 1
    chosen = places[order[repeated]]
    numbers[chosen] = group[repeated]
    return numbers, np.sort(chosen)


class _Texts:
    """Words of several documents in one row, and numbers for their k-grams."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.words, self.size = words, len(words)
        self.ends = np.cumsum(lengths)
        self.document = np.repeat(np.arange(len(lengths)), lengths)
        self.end = self.ends[self.document] if self.size else np.empty(0, np.int64)
        # By document and word, so that equal numbers mean the same document.
        kinds = int(words.max()) + 1 if self.size else 1
        self.levels = [(1, self.document * kinds + words)]
        every = np.arange(self.size)
        two = self._joined(every, self.levels[0][1], self.levels[0][1], 1, 2)
        three = self._joined(two[1], two[0], self.levels[0][1], 2, 3)
        self.levels.append((3, three[0]))
        self.repeated = three[1]

    def _joined(self, places, left, right, apart: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the grams made of ``left`` at a place and ``right`` so many words on."""
        inside = places + length <= self.end[places]
        places = places[inside]
        a, b = left[places], right[places + apart]
        both = (a >= 0) & (b >= 0)
        places, a, b = places[both], a[both], b[both]
        span = int(b.max()) + 1 if len(b) else 1
        if len(a) and int(a.max()) > (1 << 62) // span:  # the product would not fit
            a = np.unique(a, return_inverse=True)[1]
            b = np.unique(b, return_inverse=True)[1]
            span = int(b.max()) + 1
        return _numbered(a * span + b, places, self.size)

    def double(self) -> int:
        """Add the level of twice the length; returns it."""
        length, numbers = self.levels[-1]
        level, self.repeated = self._joined(self.repeated, numbers, numbers, length, 2 * length)
        self.levels.append((2 * length, level))
        return 2 * length

    def extended(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, on the side of ``left``, of the matches around each pair of equal places."""
        begin, end, lag = left.copy(), left.copy(), right - left
        for ahead, places in ((True, end), (False, begin)):
            for n, (length, numbers) in enumerate(reversed(self.levels)):
                todo = np.arange(len(places))
                # Above the next level down a length fits once; on the top and at single words it may go on.
                while len(todo):
                    at = places[todo] if ahead else places[todo] - length
                    inside = (at >= 0) & (at + lag[todo] + length <= self.size)
                    at, todo = at[inside], todo[inside]
                    same = numbers[at] == numbers[at + lag[todo]]
                    todo = todo[same]
                    places[todo] += length if ahead else -length
                    if 0 < n < len(self.levels) - 1:
                        break
        return begin, end


def _seed_pairs(texts: _Texts, seeds: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of the seeds' later occurrences at lags low <= lag < high, some seeds at a time."""
    numbers = texts.levels[-1][1]
    span = texts.size + 1
    index = numbers[texts.repeated] * span + texts.repeated
    index.sort()
    first = np.searchsorted(index, numbers[seeds] * span + np.minimum(seeds + low, texts.size))
    last = np.searchsorted(index, numbers[seeds] * span + np.minimum(seeds + high, texts.size))
    sizes = last - first
    met = sizes > 0
    seeds, first, sizes = seeds[met], first[met], sizes[met]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS_AT_ONCE, sizes.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    begin = 0
    for cut in cuts:
        part = slice(begin, min(int(cut) + 1, len(seeds)))
        begin = part.stop
        many = sizes[part]
        if not len(many):
            continue
        steps = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = np.repeat(seeds[part], many)
        yield place, index[np.repeat(first[part], many) + steps] % span - place


def word_runs(words: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in this order; ``words`` are the numbers of the words of
    all documents one after the other, ``lengths`` how many each has."""
    if min_words < MIN_WORDS:
        raise ValueError(f"seeds are made for runs of {MIN_WORDS} words or more")
    texts, found = _Texts(words, lengths), []
    longest, k, low, high = int(lengths.max(initial=0)), 0, 1, MIN_WORDS
    while longest >= max(min_words, 2 * low) and len(texts.repeated):
        if low == 1 or k * 2 * 2 == low:  # the index of the class's own length is still to be made
            k = texts.double()
        seeds = texts.repeated if low == 1 else texts.repeated[
            (texts.repeated - (texts.ends - lengths)[texts.document[texts.repeated]]) % k == 0
        ]
        for place, lag in _seed_pairs(texts, seeds, low, high):
            order = np.lexsort((place, lag))
            place, lag = place[order], lag[order]
            fresh = np.ones(len(place), bool)
            covered = place[:-1] + k  # furthest covered on the lag, when the next seed is taken
            fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] > covered)
            place, lag = place[fresh], lag[fresh]
            begin, end = texts.extended(place, place + lag)
            long = end - begin >= np.maximum(min_words - lag, lag)
            found.append(np.stack([begin[long], end[long] - begin[long] + lag[long], lag[long]], axis=1))
        low, high = high, 2 * high
    if not found:
        return np.empty((0, 4), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[new]  # of several lags of one stretch, the smallest
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    document = texts.document[runs[:, 0]]
    start = runs[:, 0] - (texts.ends - lengths)[document]
    return np.stack([document, start, runs[:, 1], runs[:, 2]], axis=1)


def _read(texts: list[list[bytes]], min_words: int) -> list[tuple]:
    """(n_words, runs, collapsed) of each list of words."""
    numbers = defaultdict(count().__next__)
    lengths = np.array([len(words) for words in texts], np.int64)
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    runs = word_runs(words, lengths, min_words)
    firsts = np.cumsum(lengths) - lengths
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, firsts[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, firsts[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(change[:-1]) == 0
    cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    rows = []
    for i, text in enumerate(texts):
        own = runs[cuts[i] : cuts[i + 1], 1:].tolist()
        stay = text
        if own:
            stay = [text[j] for j in np.flatnonzero(kept[firsts[i] : firsts[i] + len(text)])]
        rows.append((len(text), [dict(zip(("start", "length", "period"), run, strict=True)) for run in own], b" ".join(stay)))
    return rows


def find_runs(docs: DataFrame, name: str = "found", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a column ``name``: n_words, runs (start, length, period; by start, then period) and collapsed, the
    words that no run repeats (all but what comes after the first period of a run), joined by one space."""

    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows, group, held = [], [], 0
        for value in texts:
            words = (value or b"").split()
            group.append(words)
            held += len(words)
            if held >= GROUP_WORDS:
                rows += _read(group, min_words)
                group, held = [], 0
        rows += _read(group, min_words)
        release_memory()
        return pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return docs.withColumn(name, find(F.col(f"`{text}`").cast("binary")))
