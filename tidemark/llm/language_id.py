"""Language identification by unigram models over the pieces of a fixed public vocabulary.

A language gives each piece a probability. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of theirs; a forward
recursion over the word's characters adds them up. The sums are scaled as they go, per word and
language, so a word may have any length. Training is expectation
maximisation with the matching backward recursion, over a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .text import with_columns

_LETTERS = regex.compile(r"\p{L}+")
#: Words of the training sample are cut at this many letters; words that are scored are never cut.
_LONGEST = 48
#: Sums are scaled anew after so many places, well before they leave the range of floating point.
_RESCALE = 16
#: Places of words in one table of forward sums; words beyond it are summed place by place, with the last few sums alone.
_TABLE_PLACES = 1 << 16
_CACHE_ENTRIES, _CACHE_LETTERS = 1 << 19, 1 << 23
#: Bits of an edge's piece, letters and word, and where its word and end start.
_PIECE_BITS, _LETTER_BITS, _WORD_BITS = 22, 10, 13
_WORD_AT = _PIECE_BITS + _LETTER_BITS
_END_AT = _WORD_AT + _WORD_BITS
#: Probability of a letter that is no piece of the vocabulary, the same in every language.
_UNKNOWN = 1e-5


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def training_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, cut at 48."""
    return [w[k : k + _LONGEST] for w in letter_words(text) for k in range(0, len(w), _LONGEST)]


class Lattice:
    """All ways to cut words into the pieces of a vocabulary."""

    def __init__(self, pieces: list[str]):
        self.ids = {piece: k for k, piece in enumerate(pieces)}
        self.unknown = len(pieces)
        self.prefixes = {piece[:k] for piece in pieces for k in range(1, len(piece) + 1)}
        self.reach = max(map(len, pieces), default=1)  # letters of the longest piece

    @classmethod
    def from_sentencepiece(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
        return cls([model.id_to_piece(k) for k in range(model.get_piece_size()) if not special(k)])

    def edges(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Columns end, word, start and piece of all edges, by end and word, and the greatest end; a word starts with the space mark."""
        rows: list[int] = []  # an edge as one number: end, word, letters and piece
        ids, prefixes, unknown = self.ids, self.prefixes, self.unknown + (1 << _PIECE_BITS)
        longest = 0
        for number, word in enumerate(words):
            marked = "▁" + word
            n = len(marked)
            longest = max(longest, n)
            own = number << _WORD_AT
            for start in range(n):
                single = False
                for end in range(start + 1, n + 1):
                    part = marked[start:end]
                    if part not in prefixes:
                        break
                    piece = ids.get(part)
                    if piece is not None:
                        rows.append((end << _END_AT) + own + (end - start << _PIECE_BITS) + piece)
                        single = single or end == start + 1
                if not single:
                    rows.append((start + 1 << _END_AT) + own + unknown)
        packed = np.sort(np.array(rows, dtype=np.int64))
        end = packed >> _END_AT
        start = end - ((packed >> _PIECE_BITS) & ((1 << _LETTER_BITS) - 1))
        return np.stack([end, (packed >> _WORD_AT) & ((1 << _WORD_BITS) - 1), start, packed & ((1 << _PIECE_BITS) - 1)]), longest

    def forward(self, words: list[str], probability: np.ndarray, scaled: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
        """Forward sums (word, place, language), the edges, the stretch of edges that end at each place, and logarithms to add to the last sums."""
        edges, longest = self.edges(words)
        alpha = np.zeros((len(words), longest + 1, probability.shape[1]))
        alpha[:, 0] = 1
        logs = np.zeros((len(words), probability.shape[1]))
        ends = np.array([len(word) + 1 for word in words])
        cuts = np.searchsorted(edges[0], np.arange(1, longest + 2))
        steps = [(cuts[k], cuts[k + 1]) for k in range(longest)]
        for end, (low, high) in enumerate(steps, 1):
            _, number, start, piece = edges[:, low:high]
            first = np.flatnonzero(np.diff(number, prepend=-1))
            if len(first):
                alpha[number[first], end] = np.add.reduceat(alpha[number, start] * probability[piece], first)
            if scaled and end % _RESCALE == 0:
                on = np.flatnonzero(ends > end)  # words that go on
                factor = alpha[on, end]
                alpha[on, max(0, end - self.reach) : end + 1] /= factor[:, None]
                logs[on] += np.log(factor)
        return alpha, edges, steps, logs

    def _long_log_probability(self, word: str, probability: np.ndarray) -> np.ndarray:
        """The same sum for one word of any length, keeping only as many sums as the longest piece reaches back."""
        marked = "▁" + word
        size = self.reach + 1
        sums, log = np.zeros((size, probability.shape[1])), np.zeros(probability.shape[1])
        sums[0] = 1
        for start in range(len(marked)):
            here = sums[start % size].copy()
            sums[start % size] = 0  # the place that it now stands for lies ahead
            if start % _RESCALE == 0:
                sums /= here
                log += np.log(here)
                here = np.ones_like(here)
            single = False
            for end in range(start + 1, min(len(marked), start + self.reach) + 1):
                part = marked[start:end]
                if part not in self.prefixes:
                    break
                piece = self.ids.get(part)
                if piece is not None:
                    sums[end % size] += here * probability[piece]
                    single = single or end == start + 1
            if not single:
                sums[(start + 1) % size] += here * probability[self.unknown]
        return np.log(sums[len(marked) % size]) + log

    def log_probability(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, summed over all segmentations of the whole word."""
        out = np.empty((len(words), probability.shape[1]))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order:
            longest = len(words[order[-1]]) + 2
            if longest > _TABLE_PLACES:
                last = order.pop()
                out[last] = self._long_log_probability(words[last], probability)
                continue
            part = order[-max(1, min(4096, _TABLE_PLACES // longest)) :]
            del order[-len(part) :]
            alpha, _, _, logs = self.forward([words[k] for k in part], probability, scaled=True)
            ends = np.array([len(words[k]) + 1 for k in part])
            out[part] = np.log(alpha[np.arange(len(part)), ends]) + logs
        return out

    def expected_counts(self, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, by the forward and backward recursions, for one language."""
        counts = np.zeros(len(self.ids) + 1)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for low in range(0, len(order), 4096):
            part = order[low : low + 4096]
            alpha, edges, steps, _ = self.forward([words[k] for k in part], probability[:, None])
            alpha = alpha[:, :, 0]
            ends = np.array([len(words[k]) + 1 for k in part])
            rows = np.arange(len(part))
            beta = np.zeros_like(alpha)
            beta[rows, ends] = weights[part] / np.maximum(alpha[rows, ends], 1e-300)
            for low_edge, high_edge in reversed(steps):
                end, number, start, piece = edges[:, low_edge:high_edge]
                flow = probability[piece] * beta[number, end]
                np.add.at(beta, (number, start), flow)
                np.add.at(counts, piece, alpha[number, start] * flow)
        return counts


@dataclass
class LanguageModel:
    languages: list[str]
    lattice: Lattice
    probability: np.ndarray  # (pieces and one for unknown letters, languages)

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], lattice: Lattice, rounds: int = 3, smoothing: float = 0.05) -> LanguageModel:
        languages = sorted({lang for lang, _ in labelled})
        size = len(lattice.ids)
        tables = []
        for lang in languages:
            found: dict[str, int] = {}
            for label, text in labelled:
                if label == lang:
                    for word in training_words(text):
                        found[word] = found.get(word, 0) + 1
            words, weights = list(found), np.array(list(found.values()), dtype=float)
            probability = np.append(np.full(size, 1 / size), _UNKNOWN)
            for _ in range(rounds if words else 0):
                counts = lattice.expected_counts(words, weights, probability)[:size]
                probability = np.append((counts + smoothing) / (counts.sum() + smoothing * size), _UNKNOWN)
            tables.append(probability)
        return cls(languages, lattice, np.array(tables).T if tables else np.zeros((size + 1, 0)))


def _predictor(model: Broadcast):
    fitted: LanguageModel = model.value
    rows: dict[str, int] = {}
    scores, letters = np.empty((0, len(fitted.languages))), 0

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        nonlocal scores, letters
        if len(rows) > _CACHE_ENTRIES or letters > _CACHE_LETTERS:
            rows.clear()
            scores, letters = scores[:0], 0
        of_docs = [letter_words(text) for text in batch.column("text").to_pylist()]
        new = list({word for words in of_docs for word in words if word not in rows})
        letters += sum(map(len, new))
        if new and fitted.languages:
            rows.update((word, len(scores) + k) for k, word in enumerate(new))
            scores = np.concatenate([scores, fitted.lattice.log_probability(new, fitted.probability)])
        langs, certainty = [], []
        for words in of_docs:
            if not words or not fitted.languages:
                langs.append("und")
                certainty.append(0.0)
                continue
            total = scores[np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            best = int(total.argmax())
            langs.append(fitted.languages[best])
            certainty.append(float(1 / np.exp(total - total[best]).sum()))
        return [pa.array(langs, pa.string()), pa.array(certainty, pa.float64())]

    return make


def fit_languages(labelled: DataFrame, docs: DataFrame, *, vocabulary: str, per_language: int = 300) -> LanguageModel:
    """A model of the languages in `labelled` (doc_id, label), from at most `per_language` documents of each."""
    return LanguageModel.fit(sampling.sample(labelled, docs, per_label=per_language), Lattice.from_sentencepiece(vocabulary))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred and score added (replacing columns of such names), from the whole text of each row.

    score is the posterior of the language, all languages being equally likely
    beforehand. Defined cases: a null text or one without a letter is `und` with
    score 0, as is every text if the model knows no language; ties go to the first
    language in order; other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, "lang_pred string, score double", lambda: _predictor(sent))


def identify(docs: DataFrame, *, vocabulary: str, per_language: int = 300) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 3 is not 1 and that have a lang; returns doc_id, held_out, lang_pred, score of all rows."""
    remainder = sampling.id_remainder(F.col("doc_id"), 3)
    labelled = docs.where(remainder != 1).select("doc_id", F.col("lang").alias("label"))
    model = fit_languages(labelled, docs, vocabulary=vocabulary, per_language=per_language)
    found = predict_languages(docs.select("doc_id", "text", (remainder == 1).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
