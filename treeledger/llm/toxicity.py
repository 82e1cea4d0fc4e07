"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Words are runs of letters and digits, lower-cased, and each is written as twelve bytes of its hash, so that one that a dictionary
holds saves a fixed number of bytes, and one that it lacks cannot be compressed by chance.  A text is cut into windows of eight words.  Each
window is compressed with either dictionary; one that gets shorter with the toxic one has words in common with toxic text that
ordinary text lacks.  How many windows save about one, two or three words, and their share, goes through thresholds
calibrated by a logistic fit; its probability is the score.  (A window without any word of the toxic dictionary alone cannot save
and is not compressed.)

*Dictionaries* are trained on the text of their class: each holds the words of a certain share of its documents, the most frequent last.  The share for
ordinary text is smaller, so that what is at all usual there is known to both.  Both end in different words at the end only: the toxic
dictionary is the ordinary one and what toxic text has beside it.  Documents that share an eighth of a sketch of their
word triples with an earlier one count as its copies and are left out, or their words would count again and again.

*Calibration* is by cross-fitting: every sampled document is measured, in whole, with dictionaries made without its third of the
sample; the fitted weights then serve the dictionaries of the whole sample.

Fitting reads a bounded sample: ``sample_toxic`` and ``sample_ordinary`` labelled documents, those with the smallest hash of doc_id.
Of texts longer than ``sample_chars`` code points, dictionaries see windows of that size in all, spread evenly over the text.
The share of toxic documents is counted over all labelled ones.  Scoring reads whole texts.

Defined cases: NULL and empty texts have no windows and get the score of a document without any saving
window.  Without toxic or without ordinary examples the score is the share of toxic labels (one in
a million without labels).  Several labels of a document count as toxic if one is; of several texts of one id the smallest is learned from.
Every row of ``docs`` gives one row.
"""

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, written

WINDOW_WORDS = 8
SAMPLE_TOXIC = 1_500
SAMPLE_ORDINARY = 3_000
SAMPLE_CHARS = 8_000
TOXIC_SHARE, ORDINARY_SHARE = 0.01, 0.002  # of the documents of a class that hold a word of its dictionary, at least
FOLDS = 3
_SPREAD_WORDS = 40  # of each piece of a long text
_CODE = 12
_SAVED = (4, 12, 20)  # bytes: a word saves some nine
_WORD = re.compile(r"\w+")
_REMEMBERED = 200_000  # codes that a model keeps
_PARAMETERS = {
    "window_log": 22, "chain_log": 21, "hash_log": 18, "search_log": 4, "min_match": 6, "target_length": 8,
    "strategy": zstandard.STRATEGY_LAZY, "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _code(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))[:_CODE]


class _Codes(dict):
    """The codes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        code = self[word] = _code(word)
        return code


def _spread(text: str, limit: int) -> str:
    """The text itself, or pieces of it from everywhere, of about ``limit`` code points."""
    if len(text) <= limit:
        return text
    found = text.split()
    pieces = [" ".join(found[i : i + _SPREAD_WORDS]) for i in range(0, len(found), _SPREAD_WORDS)]
    step = max(1.0, len(text) / limit)
    return " ".join(pieces[int(i * step)] for i in range(int(len(pieces) / step)))[: 2 * limit]


def _apart(texts: list[str]) -> list[int]:
    """The places of the texts that are no near copies of earlier ones."""
    held, kept = defaultdict(list), []
    for place, text in enumerate(texts):
        own = words(text)
        size = min(3, len(own))
        grams = {zlib.crc32(" ".join(own[i : i + size]).encode("utf-8", "replace")) for i in range(len(own) - size + 1)}
        sketch = sorted(grams)[:64] if own else []
        shared = Counter(other for gram in sketch for other in held.get(gram, ()))
        if shared and max(shared.values()) >= max(2, len(sketch) // 8):
            continue
        for gram in sketch:
            held[gram].append(place)
        kept.append(place)
    return kept


def _frequent(texts: list[str], share: float, least: int) -> list[str]:
    """The words that so many texts hold, the most frequent last."""
    counts = Counter()
    for text in texts:
        counts.update(set(words(text)))
    floor = max(least, share * len(texts))
    return [word for word, count in sorted(counts.items(), key=lambda item: (item[1], item[0])) if count >= floor]


@dataclass
class ToxicityModel:
    """What both dictionaries hold, what the toxic one holds beside it, and the calibrated weights (intercept first)."""

    ordinary: list[str]
    toxic: list[str]
    weights: list[float]

    def __post_init__(self):
        self._open = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _opened(self):
        """Both compressors, the toxic words and the codes: made once a worker and model."""
        if self._open is None:
            parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
            ordinary, toxic = (b"".join(map(_code, held)) for held in (self.ordinary, self.toxic))
            made = []
            for content in (ordinary, toxic + ordinary):
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=parameters)
                made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress)
            self._open = (*made, frozenset(self.toxic), _Codes())
        return self._open

    def savings(self, text: str | None) -> tuple[list[int], int]:
        """Bytes that windows save with the toxic dictionary (those that can), and the number of all windows."""
        ordinary, toxic, marks, codes = self._opened()
        own, saved = words(text), []
        for start in range(0, len(own), WINDOW_WORDS):
            part = own[start : start + WINDOW_WORDS]
            if not marks.isdisjoint(part):
                window = b"".join([codes[word] for word in part])
                saved.append(len(ordinary(window)) - len(toxic(window)))
        return saved, -(-len(own) // WINDOW_WORDS)

    def features(self, text: str | None) -> list[float]:
        saved, total = self.savings(text) if self.toxic else ([], 0)
        total = max(1, total)
        counts = [sum(s >= least for s in saved) for least in _SAVED]
        return [1.0, *(math.log1p(c) for c in counts), *(math.sqrt(c / total) for c in counts), math.log(total)]

    def score(self, text: str | None) -> float:
        value = float(np.dot(self.features(text), self.weights)) if self.toxic else self.weights[0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def _logistic(features: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> list[float]:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    weights = np.zeros(features.shape[1])
    ridge = np.full(len(weights), 0.5)
    ridge[0] = 1e-3
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (importance * (labels - chance)) - ridge * weights
        curve = (features * (importance * chance * (1 - chance))[:, None]).T @ features + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return weights.tolist()


def _dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    usual = _frequent(ordinary, ORDINARY_SHARE, 2)
    known = set(usual)
    return ToxicityModel(usual, [word for word in _frequent(toxic, TOXIC_SHARE, 3) if word not in known], [])


# From the fold of each text (by place) and the models of the folds to the features of each text.
Measure = Callable[[list[int], list[ToxicityModel]], list[list[float]]]


def fit(toxic: list[str], ordinary: list[str], toxic_share: float, measure: Measure | None = None) -> ToxicityModel:
    """A model from examples.  ``measure`` reads the whole texts of the examples (toxic ones first) where these are
    shortened; a fold of -1 says that a text is not needed."""
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    texts, folds = toxic + ordinary, [-1] * (len(toxic) + len(ordinary))
    sides = [_apart(toxic), [len(toxic) + i for i in _apart(ordinary)]]
    if min(map(len, sides)) < 2 * FOLDS:
        return ToxicityModel([], [], [math.log(share / (1 - share))])
    for side in sides:
        for i, place in enumerate(side):
            folds[place] = i % FOLDS
    models = [
        _dictionaries(*[[texts[p] for p in side if folds[p] != fold] for side in sides]) for fold in range(FOLDS)
    ]
    if measure is None:
        measured = [models[fold].features(text) if fold >= 0 else [] for text, fold in zip(texts, folds, strict=True)]
    else:
        measured = measure(folds, models)
    used = sides[0] + sides[1]
    labels = np.array([1.0] * len(sides[0]) + [0.0] * len(sides[1]))
    mean = labels.mean()
    importance = np.where(labels == 1, share / mean, (1 - share) / (1 - mean))
    model = _dictionaries(*[[texts[p] for p in side] for side in sides])
    model.weights = _logistic(np.array([measured[p] for p in used]), labels, importance)
    if not model.toxic:
        return ToxicityModel([], [], [math.log(share / (1 - share))])
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_toxic: int = SAMPLE_TOXIC,
    sample_ordinary: int = SAMPLE_ORDINARY,
    sample_chars: int = SAMPLE_CHARS,
) -> ToxicityModel:
    """A model from the documents that ``labels`` (doc_id, toxic) covers."""
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null")
    marked = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    known = named.select("doc_id").distinct().join(marked, "doc_id")
    counts = {row.toxic: row.n for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids: list[tuple] = []
    for label, size in ((1, sample_toxic), (0, sample_ordinary)):
        chosen = known.where(F.col("toxic") == label).select("doc_id")
        ids += [(row.doc_id, label) for row in chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()]
    if not ids:
        return fit([], [], 0.0)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sent(numbers: list, name: str) -> DataFrame:
        # At most sample_toxic + sample_ordinary ids: small enough for every task.
        return F.broadcast(spark.createDataFrame(numbers, f"doc_id {kind}, {name} int"))

    sample = named.join(sent(ids, "toxic"), "doc_id")
    sample = written(sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))

    @F.pandas_udf("string")
    def shortened(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: _spread(text, sample_chars))

    shown = sample.select("doc_id", "toxic", shortened("text").alias("text")).collect()
    place = {doc_id: i for i, (doc_id, _) in enumerate(ids)}
    shown.sort(key=lambda row: place[row.doc_id])  # toxic ones first, by hash

    def measure(folds: list[int], models: list[ToxicityModel]) -> list[list[float]]:
        @F.pandas_udf("array<double>")
        def features(texts: pd.Series, numbers: pd.Series) -> pd.Series:
            return pd.Series([models[n].features(text) for text, n in zip(texts, numbers, strict=True)])

        needed = [(row.doc_id, fold) for row, fold in zip(shown, folds, strict=True) if fold >= 0]
        found = sample.join(sent(needed, "fold"), "doc_id").select("doc_id", features("text", "fold").alias("f")).collect()
        by_id = {row.doc_id: list(row.f) for row in found}
        return [by_id.get(row.doc_id, []) for row in shown]

    texts = [[row.text for row in shown if row.toxic == label] for label in (1, 0)]
    model = fit(*texts, counts.get(1, 0) / sum(counts.values()), measure)
    release_memory()  # the counts of words, on the driver
    return model


def score_column(model: ToxicityModel, text: str = "text") -> Column:
    """The score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda raw: model.score(None if raw is None else raw.decode("utf-8", "replace"))).astype(float)

    return score(F.col(text).cast("binary"))


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``."""
    scored = docs.select("doc_id", score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
