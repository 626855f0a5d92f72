"""Quality scores from a small convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of 1024 bytes, 896 apart, that cover all of
it. Each byte has a learned embedding; learned filters of 12 bytes run over a chunk
in steps of 2, each filter keeps its highest response, and these make the chunk's
logit. The mean, lowest and highest chunk logit and the length are combined into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .text import raw_texts, with_columns

CHUNK, OVERLAP = 1024, 128
_WIDTH, _STEP, _EMBED, _FILTERS = 12, 2, 4, 16
_PAD = 256
_BATCH = 128


def chunk_starts(n: int) -> list[int]:
    """Where the chunks of a text of n bytes start; the last one ends with the text."""
    return [*range(0, n - CHUNK, CHUNK - OVERLAP), n - CHUNK] if n > CHUNK else [0]


def chunks(raw: bytes | None) -> np.ndarray:
    """The chunks of a text as rows of byte values, a short one filled up with padding."""
    data = np.frombuffer(raw or b"", dtype=np.uint8).astype(np.int16)
    if len(data) < CHUNK:
        data = np.concatenate([data, np.full(CHUNK - len(data), _PAD, dtype=np.int16)])
        return data[None, :]
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[chunk_starts(len(data))]


@dataclass
class CnnModel:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    combine: np.ndarray = field(default_factory=lambda: np.zeros(5))

    @classmethod
    def fresh(cls, seed: int = 11) -> CnnModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        return cls({"byte": draw(257, _EMBED, s=0.5), "filter": draw(_WIDTH * _EMBED, _FILTERS, s=0.2), "bias": np.zeros(_FILTERS, np.float32), "out": draw(_FILTERS, s=0.3), "shift": np.zeros(1, np.float32)})

    def _views(self, rows: np.ndarray) -> np.ndarray:
        """Filter inputs (chunk, place, byte and embedding)."""
        embedded = self.weights["byte"][rows].reshape(len(rows), -1)
        return np.lib.stride_tricks.sliding_window_view(embedded, _WIDTH * _EMBED, axis=1)[:, :: _STEP * _EMBED]

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w = self.weights
        out = np.empty(len(rows), dtype=np.float32)
        for low in range(0, len(rows), _BATCH):
            views = self._views(rows[low : low + _BATCH])
            response = np.ascontiguousarray(views).reshape(-1, _WIDTH * _EMBED) @ w["filter"]
            pooled = np.maximum(response.reshape(*views.shape[:2], _FILTERS).max(axis=1) + w["bias"], 0)
            out[low : low + _BATCH] = pooled @ w["out"] + w["shift"][0]
        return out

    def gradient(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(rows)
        views = self._views(rows)
        response = np.ascontiguousarray(views).reshape(-1, _WIDTH * _EMBED) @ w["filter"]
        response = response.reshape(n, -1, _FILTERS)
        at = response.argmax(axis=1)
        best = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + w["bias"]
        pooled = np.maximum(best, 0)
        logit = pooled @ w["out"] + w["shift"][0]
        dlogit = ((1 / (1 + np.exp(-logit)) - labels) / n).astype(np.float32)
        dbest = dlogit[:, None] * w["out"] * (best > 0)
        chosen = views[np.arange(n)[:, None], at]  # (chunk, filter, input): only the highest place of a filter learns
        dinput = dbest[:, :, None] * w["filter"].T[None]
        dbyte = np.zeros_like(w["byte"])
        place = at[:, :, None] * _STEP + np.arange(_WIDTH)
        np.add.at(dbyte, rows[np.arange(n)[:, None, None], place], dinput.reshape(n, _FILTERS, _WIDTH, _EMBED))
        return {"out": pooled.T @ dlogit, "shift": np.array([dlogit.sum()], np.float32), "bias": dbest.sum(axis=0), "filter": np.einsum("nf,nfi->if", dbest, chosen), "byte": dbyte}

    def features(self, raws: list[bytes | None]) -> np.ndarray:
        """Mean, lowest and highest chunk logit, and the length, of each text."""
        parts = [chunks(raw) for raw in raws]
        logits = self.logits(np.concatenate(parts)).astype(np.float64)
        counts = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sums, lowest, highest = (f.reduceat(logits, starts) for f in (np.add, np.minimum, np.maximum))
        return np.stack([sums / counts, lowest, highest, np.log1p([len(raw or b"") for raw in raws])], axis=1)

    def scores(self, raws: list[bytes | None]) -> np.ndarray:
        out = np.empty(len(raws))
        for low in range(0, len(raws), 64):
            x = self.features(raws[low : low + 64])
            out[low : low + 64] = 1 / (1 + np.exp(-np.clip(x @ self.combine[:4] + self.combine[4], -30, 30)))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression, the last one the constant; Newton steps with a small ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta)), slope)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(labelled: list[tuple[int, str]], *, share_good: float = 0.5, steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 11) -> CnnModel:
    """A model from (label, text) pairs; `share_good` is the share of label 1 that scores should assume."""
    rng = np.random.default_rng(seed)
    raws, labels = [text.encode() for _, text in labelled], np.array([label == 1 for label, _ in labelled], dtype=np.float32)
    model = CnnModel.fresh(seed)
    if not labels.any() or labels.all():
        model.combine[4] = 4.0 if len(labels) and labels.all() else -4.0
        return model
    parts = [chunks(raw) for raw in raws]
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    sides = [np.flatnonzero(labels > 0), np.flatnonzero(labels == 0)]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(side, batch // 2) for side in sides])
        rows = np.stack([parts[k][rng.integers(len(parts[k]))] for k in chosen])
        pace = rate * (1 - 0.9 * step / steps)
        for name, g in model.gradient(rows, labels[chosen]).items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            model.weights[name] -= (pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    x = np.concatenate([model.features(raws[low : low + 64]) for low in range(0, len(raws), 64)])
    weight = np.where(labels > 0, share_good / labels.sum(), (1 - share_good) / (1 - labels).sum()) * len(labels)
    model.combine = _logistic(x, labels, weight)
    return model


def fit_quality(labelled: DataFrame, docs: DataFrame, *, per_label: int = 2000) -> CnnModel:
    """A model from `labelled` (doc_id, label 0 or 1), on at most `per_label` documents of each label; the labels' shares are counted over all rows."""
    known = labelled.where("label IN (0, 1)")
    share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
    return fit(sampling.sample(known, docs, per_label=per_label), share_good=min(0.99, max(0.01, share if share is not None else 0.5)))


def score_quality(docs: DataFrame, model: CnnModel, *, threshold: float = 0.3) -> DataFrame:
    """`docs` with score and predicted added (replacing columns of such names), from all chunks of each whole text.

    Defined cases: a null or empty text is one chunk of padding; repeated rows score alike; other columns pass through.
    """
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        fitted: CnnModel = sent.value
        return lambda batch: [pa.array(fitted.scores(raw_texts(batch.column("text"))), pa.float64())]

    return with_columns(docs.drop("predicted"), "score double", start).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
