"""Language identification with string kernels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sample import labelled_sample
from .text import pieces

#: Presence of byte n-grams of these lengths, in so many hashed places.
LENGTHS = (1, 2, 3, 4)
PLACES = 1 << 14
#: Longer texts are judged by windows of so many characters, as many as a text has that the model learns from.
WINDOW = 4000
UNDETERMINED = "und"

_letter = re.compile(r"[^\W\d_]")
#: ASCII characters other than letters count as spaces: what is left tells languages, not formats.
_plain = np.arange(256, dtype=np.uint8)
_plain[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams of the whole text there are, in small letters and with single spaces."""
    data = _plain[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    blank = data == 32
    data = data[np.append(True, ~(blank[1:] & blank[:-1]))]
    there = np.zeros(PLACES, bool)
    codes = np.zeros(len(data), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        codes = (codes[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        if n in LENGTHS and len(codes):
            # n makes a short n-gram other than a longer one that begins with zeros.
            mixed = (codes ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            there[(mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - 14)] = True
    return there


def windows(text: str) -> Iterator[str]:
    """The whole text in parts of about one length, at most ``WINDOW`` characters; those without letters tell nothing."""
    n = -(-len(text) // WINDOW)
    for k in range(n):
        part = text[len(text) * k // n : len(text) * (k + 1) // n]
        if _letter.search(part):
            yield part


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def decide(self, rows: np.ndarray) -> np.ndarray:
        """One-versus-rest values of rows of presences."""
        return kernel(rows, self.landmarks) @ self.weights

    def decide_texts(self, texts: list[str]) -> np.ndarray:
        """Means of these values over the windows of each text, which has a letter."""
        sums, n, waiting = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), []

        def add() -> None:
            owners = np.array([k for k, _ in waiting])
            np.add.at(sums, owners, self.decide(np.stack([row for _, row in waiting])))
            np.add.at(n, owners, 1)
            waiting.clear()

        for k, text in enumerate(texts):
            for part in windows(text):
                waiting.append((k, presence(part)))
                if len(waiting) == 256:
                    add()
        if waiting:
            add()
        return sums / n[:, None]


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of both numbers of n-grams, as one matrix product."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    norms = np.sqrt(np.outer(a.sum(axis=1), b.sum(axis=1)))
    return (a @ b.T) / np.maximum(norms, 1e-9)


def fit_language(
    docs: DataFrame,
    per_language: int = 400,
    landmarks: int = 128,
    most_chars: int = 4000,
    ridge: float = 1e-2,
    seed: int = 9,
) -> LanguageModel:
    """Kernel ridge regression, one language versus the rest, in the Nyström space of some texts of the sample.

    ``docs`` has ``doc_id, text, lang``. At most ``per_language`` documents of each language, with at most
    ``most_chars`` characters each, come to the driver; texts without letters teach nothing. ``landmarks`` of them,
    dealt evenly to the languages but at least one for each, span the space.
    """
    known = docs.selectExpr("doc_id", "lang AS label").filter("label IS NOT NULL")
    sample = labelled_sample(docs.select("doc_id", "text"), known, per_language, most_chars, seed)
    rows = [r for r in sample.collect() if _letter.search(r.text)]
    rows.sort(key=lambda r: (r.label, zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    languages = sorted({r.label for r in rows})
    if not rows:
        return LanguageModel([], np.zeros((0, PLACES), bool), np.zeros((0, 0), np.float32))
    marks = np.stack([presence(r.text) for r in rows])
    labels = np.array([languages.index(r.label) for r in rows])
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(labels == k)[:each] for k in range(len(languages))])
    centre = kernel(marks[chosen], marks[chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh(centre + 1e-6 * np.eye(len(chosen)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = kernel(marks, marks[chosen]).astype(np.float64) @ root
    targets = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    weight = (1 / np.bincount(labels))[labels][:, None]
    normal = features.T @ (weight * features) + ridge * np.eye(len(chosen)) * len(languages) / len(chosen)
    solved = np.linalg.solve(normal, features.T @ (weight * targets))
    return LanguageModel(languages, marks[chosen], (root @ solved).astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of the whole text of each row of ``doc_id, text``.

    A long text is judged by the mean over its windows, so its length fills no more places than what was learnt from.
    The score is the winner's value, from -1 and 1, moved to 0 and 1. A null text, or one without a letter, is
    ``und`` with score 0; so is every text if there was nothing to learn from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", most_rows=256):
                texts = part.column("text").to_pylist()
                told = np.array([bool(model.languages and t and _letter.search(t)) for t in texts])
                names = np.full(len(texts), UNDETERMINED, object)
                scores = np.zeros(len(texts))
                if told.any():
                    values = model.decide_texts([t for t, x in zip(texts, told) if x])
                    best = values.argmax(axis=1)
                    names[told] = np.array(model.languages, object)[best]
                    scores[told] = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
                columns = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
