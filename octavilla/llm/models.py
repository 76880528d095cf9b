"""Hashed features of whole texts and the small models fitted on bounded samples of them."""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, claim_worker, whole_text

#: Slots of byte trigrams, and bins of each of the shares that describe a text's form.
SLOTS = 2048
BINS = 8
FORM = 9
FEATURES = SLOTS + FORM * BINS
#: Bytes hashed at once, so that a very long text needs little memory.
_AT_ONCE = 1 << 20
#: Labelled rows a model is fitted on at most.
SAMPLE = 6000


def _trigram_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(SLOTS, np.int64)
    for at in range(0, max(len(data) - 2, 0), _AT_ONCE):
        b = np.frombuffer(data, np.uint8, min(_AT_ONCE + 2, len(data) - at), at).astype(np.uint32)
        code = (b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)) * np.uint32(2654435761)
        counts += np.bincount(code >> np.uint32(21), minlength=SLOTS)
    return counts


def _form(text: str, data: bytes) -> list[float]:
    """Shares between 0 and 1 that tell prose from junk, whatever the language."""
    words, lines, n = text.split(), text.split("\n"), max(len(data), 1)
    b = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    runs = sum(map(operator.eq, words, words[1:]))
    w = max(len(words), 1)
    return [len(set(words)) / w, runs / w, 1 - len(set(lines)) / len(lines), b[65:91].sum() / n, b[48:58].sum() / n,
            (b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()) / n, b[128:].sum() / n,
            min(len(text) / w / 24, 1.0), min(np.log1p(n) / 16, 1.0)]


def text_features(texts) -> np.ndarray:
    """A row per text: root shares of hashed byte trigrams, then one bin per share of its form."""
    claim_worker("models")
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts):
        data = text.encode("utf-8", "surrogatepass")
        counts = _trigram_counts(data)
        row[:SLOTS] = np.sqrt(counts / max(counts.sum(), 1))
        for i, share in enumerate(_form(text, data)):
            row[SLOTS + i * BINS + min(int(np.sqrt(share) * BINS), BINS - 1)] = 1
    return out


def labelled_sample(docs: DataFrame, labelled: DataFrame, columns: list[str], most: int = SAMPLE) -> pd.DataFrame:
    """Whole texts' features with their labels, of at most about ``most`` labelled rows.

    The labelled rows are sampled first; their bounded list is broadcast to the texts, so the
    texts are read once and not moved.
    """
    chosen = bounded_sample(labelled.filter(F.col("doc_id").isNotNull()).select("doc_id", *columns), "doc_id", most)
    texts = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(chosen), "doc_id")

    def features(frames):
        for frame in frames:
            for k in range(0, len(frame), 64):
                part = frame.iloc[k:k + 64]
                x = text_features(part["_text"].tolist()).astype("<f2")
                yield part[columns].assign(x=[r.tobytes() for r in x])

    schema = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in columns)
    return texts.select("_text", *columns).mapInPandas(features, f"{schema}, x binary").toArrow().to_pandas()


def feature_matrix(sample: pd.DataFrame) -> np.ndarray:
    if not len(sample):
        return np.zeros((0, FEATURES))
    return np.frombuffer(b"".join(sample["x"]), "<f2").reshape(len(sample), FEATURES).astype(np.float64)


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 150, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with halving steps; ``f`` gives value and gradient."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y, r in reversed(steps):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        for (s, y, r), alpha in zip(steps, reversed(alphas)):
            d = d + s * (alpha - r * (y @ d))
        slope, step = g @ d, 1.0 if steps else 1.0 / max(np.linalg.norm(g), 1e-12)
        while step > 1e-10:
            new_value, new_g = f(x + step * d)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = step * d, new_g - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        x, done = x + s, value - new_value < 1e-9 * max(abs(value), 1)
        value, g = new_value, new_g
        if done:
            return x
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
