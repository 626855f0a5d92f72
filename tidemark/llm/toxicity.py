"""Toxicity scores from a small bidirectional GRU with attention pooling, in numpy.

A word enters as its own embedding (if it is in the learned vocabulary) beside
the mean embedding of its character trigrams. A word of more than 24 bytes, as in a text
without spaces, enters as overlapping pieces that take places of their own. A text is read in
overlapping windows of 64 words, 48 apart, the last one ending with the text; every window is
scored and the text's score is a calibrated function of the highest.

The input part of the gates depends on the word alone, so it is computed once per
distinct word and remembered; only the recurrent part runs at every place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .text import raw_texts, with_columns, words

WINDOW, STRIDE = 64, 48
_HIDDEN, _WORD, _CHAR, _ATTENTION = 8, 8, 8, 8
_BUCKETS, _VOCABULARY = 2048, 4096
_CACHE_ENTRIES = 1 << 17
_TRIGRAMS = 24  # bytes of a piece, which has as many trigrams
_BATCH = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def trigram_ids(word: bytes) -> list[int]:
    """Buckets of the character trigrams of a word with its ends marked, in bytes."""
    marked = b"<" + word + b">"
    return [zlib.crc32(marked[k : k + 3]) % _BUCKETS for k in range(max(1, len(marked) - 2))]


def pieces(tokens: list[bytes]) -> list[bytes]:
    """The words, those of more than 24 bytes as pieces of 24, 12 apart, the last one ending with the word."""
    if not any(len(t) > _TRIGRAMS for t in tokens):
        return tokens
    return [t[s : s + _TRIGRAMS] for t in tokens for s in [*range(0, len(t) - _TRIGRAMS, _TRIGRAMS // 2), max(0, len(t) - _TRIGRAMS)]]


def window_starts(n: int) -> list[int]:
    """Where the windows of a text of n words start; a text of up to 64 words is one window."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0]


@dataclass
class GruModel:
    vocabulary: dict[bytes, int] = field(default_factory=dict)  # places from 1; 0 is any other word
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, vocabulary: list[bytes], seed: int = 7) -> GruModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        weights = {"word": draw(len(vocabulary) + 1, _WORD, s=0.1), "char": draw(_BUCKETS, _CHAR, s=0.1)}
        for side in ("f", "b"):
            weights |= {f"W{side}": draw(_WORD + _CHAR, 3 * _HIDDEN), f"U{side}": draw(_HIDDEN, 3 * _HIDDEN), f"c{side}": np.zeros(3 * _HIDDEN, np.float32)}
        weights |= {"A": draw(2 * _HIDDEN, _ATTENTION), "a": np.zeros(_ATTENTION, np.float32), "v": draw(_ATTENTION), "o": draw(2 * _HIDDEN), "d": np.zeros(1, np.float32)}
        return cls({word: k for k, word in enumerate(vocabulary, 1)}, weights)

    def inputs(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, and what they came from: word places, trigram places (padded), their shares."""
        places = np.array([self.vocabulary.get(t, 0) for t in tokens], dtype=np.int64)
        grams = np.zeros((len(tokens), _TRIGRAMS), dtype=np.int64)
        share = np.zeros((len(tokens), _TRIGRAMS), dtype=np.float32)
        for k, token in enumerate(tokens):
            found = trigram_ids(token)
            grams[k, : len(found)], share[k, : len(found)] = found, 1 / len(found)
        chars = np.einsum("ng,ngd->nd", share, self.weights["char"][grams])
        return np.concatenate([self.weights["word"][places], chars], axis=1), places, grams, share

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.concatenate([vectors @ w["Wf"] + w["cf"], vectors @ w["Wb"] + w["cb"]], axis=1)

    def run(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows from gates (place, window, both directions); `keep` remembers what the gradient needs."""
        w, kept = self.weights, {}
        n_places, n = gates.shape[:2]
        states = np.empty((n_places, n, 2 * _HIDDEN), dtype=np.float32)
        for side, low in (("f", 0), ("b", 1)):
            recurrent = w[f"U{side}"]
            h = np.zeros((n, _HIDDEN), dtype=np.float32)
            steps = []
            for t in range(n_places) if side == "f" else range(n_places - 1, -1, -1):
                x = gates[t, :, 3 * _HIDDEN * low : 3 * _HIDDEN * (low + 1)]
                hu = h @ recurrent
                zr = _sigmoid(x[:, : 2 * _HIDDEN] + hu[:, : 2 * _HIDDEN])
                z, r = zr[:, :_HIDDEN], zr[:, _HIDDEN:]
                new = np.tanh(x[:, 2 * _HIDDEN :] + r * hu[:, 2 * _HIDDEN :])
                after = new + z * (h - new)
                if mask is not None:
                    after = np.where(mask[t][:, None], after, h)
                if keep:
                    steps.append((t, h, z, r, new, hu[:, 2 * _HIDDEN :]))
                h = after
                states[t, :, _HIDDEN * low : _HIDDEN * (low + 1)] = h
            kept[side] = steps
        tanh = np.tanh(states @ w["A"] + w["a"])
        attention = tanh @ w["v"]
        if mask is not None:
            attention = np.where(mask, attention, np.float32(-1e9))
        attention = np.exp(attention - attention.max(axis=0))
        attention /= attention.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", attention, states)
        kept |= {"states": states, "tanh": tanh, "attention": attention, "pooled": pooled}
        return pooled @ w["o"] + w["d"][0], kept

    def gradient(self, dlogit: np.ndarray, kept: dict, mask: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights above the inputs, and of the gates."""
        w = self.weights
        grads = {"o": kept["pooled"].T @ dlogit, "d": np.array([dlogit.sum()], dtype=np.float32)}
        dpooled = dlogit[:, None] * w["o"]
        states, tanh, attention = kept["states"], kept["tanh"], kept["attention"]
        dstates = attention[:, :, None] * dpooled
        dattention = np.einsum("tnd,nd->tn", states, dpooled)
        dscore = attention * (dattention - (attention * dattention).sum(axis=0))
        grads["v"] = np.einsum("tn,tna->a", dscore, tanh)
        dtanh = dscore[:, :, None] * w["v"] * (1 - tanh**2)
        grads["A"], grads["a"] = np.einsum("tnd,tna->da", states, dtanh), dtanh.sum(axis=(0, 1))
        dstates = dstates + dtanh @ w["A"].T
        dgates = np.zeros((*states.shape[:2], 6 * _HIDDEN), dtype=np.float32)
        for side, low in (("f", 0), ("b", 1)):
            recurrent = w[f"U{side}"]
            du = np.zeros_like(recurrent)
            dh = np.zeros((states.shape[1], _HIDDEN), dtype=np.float32)
            for t, h, z, r, new, hn in reversed(kept[side]):
                total = dh + dstates[t, :, _HIDDEN * low : _HIDDEN * (low + 1)]
                live = np.where(mask[t][:, None], total, np.float32(0))
                dnew = live * (1 - z) * (1 - new**2)
                dz = live * (h - new) * z * (1 - z)
                dr = dnew * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dnew * r], axis=1)
                du += h.T @ dhu
                dgates[t, :, 3 * _HIDDEN * low : 3 * _HIDDEN * (low + 1)] = np.concatenate([dz, dr, dnew], axis=1)
                dh = (total - live) + live * z + dhu @ recurrent.T
            grads[f"U{side}"] = du
        return grads, dgates

    def window_logits(self, table: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits of windows of word rows into a table of gates; windows shorter than the array are masked."""
        out = np.empty(len(rows), dtype=np.float32)
        for part in (np.flatnonzero(lengths == WINDOW), np.flatnonzero(lengths < WINDOW)):
            for low in range(0, len(part), _BATCH):
                chosen = part[low : low + _BATCH]
                full = lengths[chosen[0]] == WINDOW
                mask = None if full else np.arange(WINDOW)[:, None] < lengths[chosen]
                out[chosen] = self.run(table[rows[chosen].T], mask)[0]
        return out


class Scorer:
    """Scores texts with a model, remembering the gates of a bounded number of words."""

    def __init__(self, model: GruModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {b"": 0}  # row 0 stands for the places after a text's end, and for an empty text
        first = self.model.gates(self.model.inputs([b""])[0])
        self.table = np.empty((1 << 12, first.shape[1]), dtype=np.float32)
        self.table[:1] = first

    def _learn(self, new: list[bytes]) -> None:
        """Adds the gates of new words; the table doubles when it is full."""
        for low in range(0, len(new), 1 << 12):
            part = new[low : low + (1 << 12)]
            start = len(self.rows)
            while start + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.rows.update((t, start + k) for k, t in enumerate(part))
            self.table[start : start + len(part)] = self.model.gates(self.model.inputs(part)[0])

    def window_logits(self, tokens: list[bytes]) -> np.ndarray:
        """The logit of each window of one text."""
        return self._logits([tokens])[0]

    def highest_logits(self, raws: list[bytes | None]) -> np.ndarray:
        """The highest logit among the windows of each text."""
        logits, owners = self._logits([pieces(words(raw)) or [b""] for raw in raws])
        return np.maximum.reduceat(logits, np.concatenate([[0], np.cumsum(owners)[:-1]]))

    def _logits(self, of_docs: list[list[bytes]]) -> tuple[np.ndarray, list[int]]:
        """The logits of all windows, and how many each text has."""
        if len(self.rows) > _CACHE_ENTRIES:
            self._clear()
        self._learn(list({t for tokens in of_docs for t in tokens if t not in self.rows}))
        rows, lengths, owners = [], [], []
        for number, tokens in enumerate(of_docs):
            n = len(tokens)
            ids = np.fromiter(map(self.rows.__getitem__, tokens), dtype=np.int32, count=n)
            if n < WINDOW:
                ids = np.concatenate([ids, np.zeros(WINDOW - n, dtype=np.int32)])
            starts = np.array(window_starts(n))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts])
            lengths.append(np.full(len(starts), min(n, WINDOW)))
            owners.append(len(starts))
        return self.model.window_logits(self.table, np.concatenate(rows), np.concatenate(lengths)), owners

    def scores(self, raws: list[bytes | None]) -> np.ndarray:
        if not raws:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.model.scale * self.highest_logits(raws).astype(np.float64) + self.model.shift)))


def _document_counts(texts: list[list[bytes]], toxic: np.ndarray) -> dict[bytes, list[int]]:
    """Clean and toxic documents with each word."""
    counts: dict[bytes, list[int]] = {}
    for tokens, label in zip(texts, toxic):
        for token in set(tokens):
            counts.setdefault(token, [0, 0])[int(label)] += 1
    return counts


def _telling_words(texts: list[list[bytes]], toxic: np.ndarray) -> list[bytes]:
    """The words in three documents or more whose counts in clean and toxic ones differ most for their size."""
    share = toxic.mean()
    telling = {t: (c[1] - share * sum(c)) ** 2 / sum(c) for t, c in _document_counts(texts, toxic).items() if sum(c) >= 3}
    return sorted(telling, key=lambda t: (-telling[t], t))[:_VOCABULARY]


def _windows_to_learn(texts: list[list[bytes]], toxic: np.ndarray, rng: np.random.Generator, scorer: Scorer | None = None) -> tuple[list[list[bytes]], np.ndarray]:
    """Windows and labels: the most toxic window of each document and, of a clean one, another anywhere.

    How toxic a window is says the scorer or, at first, how much its words speak for the label.
    """
    counts = _document_counts(texts, toxic)
    total = [max(1, int((~toxic).sum())), max(1, int(toxic.sum()))]
    odds = {t: max(0.0, np.log((c[1] + 0.5) / (total[1] + 1)) - np.log((c[0] + 0.5) / (total[0] + 1))) for t, c in counts.items() if sum(c) >= 3}
    windows, labels = [], []
    for tokens, label in zip(texts, toxic):
        starts = window_starts(len(tokens))
        if scorer:
            values = scorer.window_logits(tokens or [b""])
        else:
            values = [sum(odds.get(t, 0.0) ** 2 for t in tokens[s : s + WINDOW]) for s in starts]
        chosen = [starts[int(np.argmax(values))]] if label or scorer else []
        if not label:
            chosen.append(int(rng.choice(starts)))
        windows += [tokens[s : s + WINDOW] or [b""] for s in chosen]
        labels += [bool(label)] * len(chosen)
    return windows, np.array(labels)


def fit(labelled: list[tuple[int, str]], *, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> GruModel:
    """A model from (label, text) pairs; without both labels, one that scores everything far to the side of the only one (of 0 without any)."""
    rng = np.random.default_rng(seed)
    texts = [pieces(words(text.encode())) for _, text in labelled]
    toxic = np.array([label == 1 for label, _ in labelled], dtype=bool)
    if not toxic.any() or toxic.all():
        model = GruModel.fresh([], seed)
        model.scale, model.shift = 0.0, 4.0 if len(toxic) and toxic.all() else -4.0
        return model
    model = GruModel.fresh(_telling_words(texts, toxic), seed)
    windows, labels = _windows_to_learn(texts, toxic, rng)
    sides = [np.flatnonzero(labels), np.flatnonzero(~labels)]
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        if step == steps // 2:  # from here on the windows that the model itself finds most toxic
            windows, labels = _windows_to_learn(texts, toxic, rng, Scorer(model))
            sides = [np.flatnonzero(labels), np.flatnonzero(~labels)]
        pace = rate * (1 - 0.9 * step / steps)
        chosen = np.concatenate([rng.choice(side, batch // 2) for side in sides])
        lengths = np.array([len(windows[k]) for k in chosen])
        distinct = list(dict.fromkeys([b"", *(t for k in chosen for t in windows[k])]))
        place = {t: k for k, t in enumerate(distinct)}
        rows = np.zeros((WINDOW, batch), dtype=np.int64)
        for k, number in enumerate(chosen):
            rows[: lengths[k], k] = [place[t] for t in windows[number]]
        mask = np.arange(WINDOW)[:, None] < lengths
        vectors, places, grams, share = model.inputs(distinct)
        gates = model.gates(vectors)
        logit, kept = model.run(gates[rows], mask, keep=True)
        dlogit = ((1 / (1 + np.exp(-logit)) - labels[chosen]) / batch).astype(np.float32)
        grads, dgates = model.gradient(dlogit, kept, mask)
        dtable = np.zeros_like(gates)
        np.add.at(dtable, rows, dgates)
        half = 3 * _HIDDEN
        grads |= {"Wf": vectors.T @ dtable[:, :half], "Wb": vectors.T @ dtable[:, half:], "cf": dtable[:, :half].sum(0), "cb": dtable[:, half:].sum(0)}
        dvectors = dtable[:, :half] @ model.weights["Wf"].T + dtable[:, half:] @ model.weights["Wb"].T
        grads["word"], grads["char"] = np.zeros_like(model.weights["word"]), np.zeros_like(model.weights["char"])
        np.add.at(grads["word"], places, dvectors[:, :_WORD])
        np.add.at(grads["char"], grams, share[:, :, None] * dvectors[:, None, _WORD:])
        for name, g in grads.items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            model.weights[name] -= (pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    model.scale, model.shift = calibrate(Scorer(model).highest_logits([text.encode() for _, text in labelled]), toxic)
    return model


def calibrate(logits: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Scale and shift of a logistic curve through (logit, label), both labels weighing alike; Newton steps with a small ridge."""
    x = np.stack([logits.astype(np.float64), np.ones(len(logits))], axis=1)
    weight = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum()))
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 1e-3 * (beta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit_toxicity(labelled: DataFrame, docs: DataFrame, *, per_label: int = 1000) -> GruModel:
    """A model from `labelled` (doc_id, label 0 or 1), on at most `per_label` documents of each label."""
    return fit(sampling.sample(labelled.where("label IN (0, 1)"), docs, per_label=per_label))


def score_toxicity(docs: DataFrame, model: GruModel) -> DataFrame:
    """`docs` with score and predicted added (replacing columns of such names), from all windows of each whole text.

    Defined cases: a null or empty text, or one without words, is one window of a
    single empty word; repeated rows score alike; other columns pass through.
    """
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(sent.value)
        return lambda batch: [pa.array(scorer.scores(raw_texts(batch.column("text"))), pa.float64())]

    return with_columns(docs.drop("predicted"), "score double", start).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
