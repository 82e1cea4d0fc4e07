"""Language by cross parsing: the language whose sample needs the fewest phrases to build a text wins.

A suffix automaton of a labelled sample recognises every substring of it.  A text is parsed greedily:
follow the automaton as far as it goes, count a phrase, start again.  Phrases times log2 of the sample's
length over the text's length estimate the cross entropy in bits a letter (letters outside the sample
cost a phrase each), which makes samples of different lengths comparable.

Texts are lower-cased and runs of anything but letters become one blank.  A whole text is parsed in
pieces of 256 letters, many pieces and all languages side by side in numpy; a piece's end closes a phrase.

A language's sample is bounded: ``sample_docs`` labelled documents with the smallest hash of doc_id, of
each at most ``doc_chars`` code points, together ``sample_chars`` at most.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0.  Ties go to the smaller
language name.  Without any labelled row all texts are ``und``.  Every row of ``docs`` gives one row.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 100
DOC_CHARS = 1_000
SAMPLE_CHARS = 24_000
PIECE = 256
_PIECES_AT_ONCE = 16_384


def _suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton (state times alphabet); -1 where there is none."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = moves[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[state] + 1)
                while state >= 0 and moves[state].get(symbol) == target:
                    moves[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    table = np.full((len(moves), alphabet), -1, np.int32)
    for state, row in enumerate(moves):
        for symbol, target in row.items():
            table[state, symbol] = target
    return table


class LanguageModel:
    """Suffix automata of the languages in one table.

    Symbols: 0 is a blank, 1 a letter no sample has, the last one padding (it changes nothing).
    """

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(name for name, text in samples.items() if any(map(str.isalpha, text)))
        texts = {name: _letters(samples[name]) for name in self.names}
        known = sorted({code for text in texts.values() for code in text.tolist()} - {32})
        self.known = np.array(known, np.uint32)
        self.alphabet = len(known) + 3
        self.bits, self.roots, tables, base = [], [], [], 0
        for name in self.names:
            symbols = self._symbols(texts[name])
            moves = _suffix_automaton(symbols.tolist(), self.alphabet)
            moves = np.where(moves >= 0, (moves + base) * self.alphabet, -1)
            moves[:, -1] = (np.arange(len(moves)) + base) * self.alphabet
            tables.append(moves)
            self.roots.append(base * self.alphabet)
            self.bits.append(math.log2(max(2, len(symbols))))
            base += len(moves)
        self.moves = np.concatenate(tables).ravel().astype(np.int32) if tables else np.empty(0, np.int32)

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.known, codes)
        place[place == len(self.known)] = 0
        found = self.known[place] == codes if len(self.known) else np.zeros(len(codes), bool)
        return np.where(codes == 32, 0, np.where(found, place + 2, 1)).astype(np.int32)

    def phrases(self, pieces: np.ndarray) -> np.ndarray:
        """Phrases of each piece (row of symbols) in each language."""
        counts = np.zeros((len(self.names), len(pieces)), np.int32)
        steps = np.ascontiguousarray(pieces.T)
        for number, root in enumerate(self.roots):
            state = np.full(len(pieces), root, np.int32)
            count = counts[number]
            first = self.moves[root : root + self.alphabet]
            first = np.where(first < 0, root, first)
            for symbols in steps:
                after = self.moves.take(state + symbols)
                ended = after < 0
                count += ended
                state = np.where(ended, first.take(symbols), after)
            count += state != root
        return counts

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is how far the second best language lies behind."""
        codes = [_letters("" if text is None else text.decode("utf-8", "replace")) for text in texts]
        costs = np.zeros((len(self.names), len(texts)))
        work: list[tuple[int, np.ndarray]] = [(i, c) for i, c in enumerate(codes) if len(c) and self.names]
        batch: list[np.ndarray] = []
        owners: list[int] = []

        def flush():
            if batch:
                counts = self.phrases(np.concatenate(batch))
                for number in range(len(self.names)):
                    costs[number] += np.bincount(owners, counts[number], len(texts))
            batch.clear()
            owners.clear()

        for i, each in work:
            symbols = self._symbols(each)
            filled = np.full(-(-len(symbols) // PIECE) * PIECE, self.alphabet - 1, np.int32)
            filled[: len(symbols)] = symbols
            for start in range(0, len(filled), PIECE * _PIECES_AT_ONCE):
                rows = filled[start : start + PIECE * _PIECES_AT_ONCE].reshape(-1, PIECE)
                batch.append(rows)
                owners.extend([i] * len(rows))
                if len(owners) >= _PIECES_AT_ONCE:
                    flush()
        flush()
        results = [("und", 0.0)] * len(texts)
        for i, each in work:
            bits = [costs[n, i] * self.bits[n] / len(each) for n in range(len(self.names))]
            order = sorted(range(len(bits)), key=lambda n: (bits[n], n))
            behind = 1.0 if len(order) == 1 else (bits[order[1]] - bits[order[0]]) / max(bits[order[1]], 1e-12)
            results[i] = (self.names[order[0]], float(min(1.0, max(0.0, behind))))
        return results


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one blank for each run of other characters; empty
    without a letter."""
    text = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return codes
    kinds, inverse = np.unique(codes, return_inverse=True)
    letter = np.fromiter((chr(code).isalpha() for code in kinds.tolist()), bool, len(kinds))[inverse]
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters stays, as a blank
    return np.where(letter, codes, np.uint32(32))[keep]


def train(
    docs: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    doc_chars: int = DOC_CHARS,
    sample_chars: int = SAMPLE_CHARS,
) -> LanguageModel:
    """A model from the rows of ``docs`` (doc_id, text, lang) that have a language."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    cut = rows.select("doc_id", "lang", F.substring("text", 1, doc_chars).alias("text"))
    chosen = cut.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_docs)
    samples: dict[str, str] = {}
    for row in sorted(chosen.collect(), key=lambda row: (row.lang, row.place)):
        text = samples.get(row.lang, "")
        samples[row.lang] = text + " " + row.text[: max(0, sample_chars - len(text))]
    return LanguageModel(samples)


def language_column(model: LanguageModel, text: str = "text") -> Column:
    """Struct of lang_pred and score of each text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict(list(texts)), columns=["lang_pred", "score"])

    return predict(F.col(text).cast("binary"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs``."""
    return docs.select("doc_id", language_column(model).alias("p")).select("doc_id", "p.*")
