"""Document quality by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .sample import labelled_sample
from .text import pieces, string_bytes

#: A text is compressed in cuts of so many bytes, each with the whole dictionary before it, so that what a long text
#: says of itself does not hide what the dictionary says of it.
CUT_BYTES = 2048
LEVEL = 3


@dataclass
class QualityModel:
    """Two dictionaries, and the logistic curve from size difference to the probability of label 1."""

    good: bytes
    bad: bytes
    slope: float
    level: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for data in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    dict_data=words, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )
        return made

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.level, -500, 500)))


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """How much smaller the good dictionary makes the text than the bad one, as a share of both sizes; empty: 0."""
    sizes = [0, 0]
    for at in range(0, len(text), CUT_BYTES):
        cut = text[at : at + CUT_BYTES]
        sizes[0] += len(good.compress(cut))
        sizes[1] += len(bad.compress(cut))
    return (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]) if text else 0.0


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the text itself where there is too little of it to train on."""
    cuts = [t[at : at + CUT_BYTES] for t in texts for at in range(0, len(t), CUT_BYTES)]
    try:
        return zstandard.train_dictionary(size, cuts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cuts)[-size:] or b"\n"


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve by Newton's steps, with a slight pull of the slope to 0."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    weights, pull = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - pull @ weights
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + pull + 1e-9 * np.eye(2), slope)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0] / scale), float(weights[1])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = 3000,
    most_chars: int = 20_000,
    dictionary_bytes: int = 112_640,
    seed: int = 4,
) -> QualityModel:
    """Dictionaries from one half of a bounded sample, the curve from the other half, at the labels' own shares.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, label`` (0 or 1; other rows are ignored). At most
    ``per_label`` documents of each label, with at most ``most_chars`` characters each, come to the driver. Without
    documents of both labels the score is the same for all texts: the share of label 1, or 0.5 without any.
    """
    labels = labels.filter("label IN (0, 1)")
    shares = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = labelled_sample(docs, labels, per_label, most_chars, seed).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    texts = {k: [r.text.encode() for r in rows if r.label == k] for k in (0, 1)}
    if not texts[0] or not texts[1]:
        share = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
        return QualityModel(b"\n", b"\n", 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    halves = {k: (v[::2], v[1::2] or v) for k, v in texts.items()}
    model = QualityModel(dictionary(halves[1][0], dictionary_bytes), dictionary(halves[0][0], dictionary_bytes), 0.0, 0.0)
    good, bad = model.compressors()
    x = [np.array([difference(t, good, bad) for t in halves[k][1]]) for k in (0, 1)]
    slope, level = logistic(np.concatenate(x), np.repeat([0.0, 1.0], [len(x[0]), len(x[1])]))
    # The sample's shares of the labels are not those of all labelled rows.
    level += float(np.log(shares[1] / shares[0]) - np.log(len(x[1]) / len(x[0])))
    return QualityModel(model.good, model.bad, slope, level)


def score_quality(docs: DataFrame, model: QualityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """Add each whole text's probability of label 1. A null or empty text gets that of no difference at all.

    A column of the new name is replaced, all others stay; repeated rows are scored each; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() != score_column.lower()]
    with_text = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = string_bytes(part.column("text"))
                data = data.tobytes()
                found = np.array([difference(data[a:b], good, bad) for a, b in zip(offsets[:-1], offsets[1:])])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.score(found))], ["row", "score"])

    kind = with_text.schema["row"].dataType.simpleString()
    scored = with_text.mapInArrow(run, f"row {kind}, score double")
    return scored.select("row.*", F.col("score").alias(score_column))
