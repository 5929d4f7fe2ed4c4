"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. Every whole text is compressed with
each; the difference of the two sizes, by the length of the text and by their sum, is what the text tells. A logistic
calibration, fitted on labelled documents that trained no dictionary, turns it into the probability of label 1; its
intercept is moved to the base rate over all labels that may be used.

Defined cases: a null or empty text has differences of 0 and a score like any other; texts of any length are compressed
whole; repeated rows get equal scores; without labels of both classes all scores are the base rate; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import held_out, slices
from codeloom.llm.sampling import labelled

#: Bounds of the fit: documents of each class, bytes of each document that may go into a dictionary, bytes of a dictionary.
PER_CLASS = 2000
PIECE = 4096
DICT_BYTES = 112 << 10
LEVEL = 3
THRESHOLD = 0.3


class Model:
    """Two dictionaries and a calibration; small enough to be sent with each task."""

    def __init__(self, dicts: tuple[bytes, bytes] | None, rate: float):
        self.dicts, self.rate, self.w, self.mean, self.scale = dicts, rate, None, None, None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def _compressors(self):
        if "made" not in self.__dict__:
            self.made = []
            for d in self.dicts:
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=LEVEL)
                self.made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_checksum=False))
            self.made.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False))
        return self.made

    def features(self, texts: list[bytes]) -> np.ndarray:
        bad, good, plain = self._compressors()
        sizes = np.array([(len(t), len(bad.compress(t)), len(good.compress(t)), len(plain.compress(t))) if t else (0, 0, 0, 0) for t in texts], dtype=np.float64).reshape(-1, 4)
        n, b, g, p = sizes.T
        d = (b - g) / np.maximum(n, 1)
        length = np.log1p(n)
        return np.column_stack([d, (b - g) / np.maximum(b + g, 1), d * length, g / np.maximum(n, 1), p / np.maximum(n, 1), length])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.rate)
        x = np.clip((self.features(texts) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weights * (p - y)) + keep * w
        step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p) + 1e-9)[:, None]) + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], rate: float) -> Model:
    """rows: (text, label). Every second document of a class trains its dictionary, the others the calibration."""
    by = [[t.encode() for t, y in rows if y == k] for k in (0, 1)]
    if min(map(len, by)) < 4:
        return Model(None, rate)
    dicts = []
    for texts in by:
        # A stretch from the middle: the ends of documents are alike more often.
        pieces = [t[max(0, (len(t) - PIECE) // 2) :][:PIECE] for t in texts[::2] if len(t) >= 8]
        size = min(DICT_BYTES, max(2048, sum(map(len, pieces)) // 4))
        try:
            dicts.append(zstandard.train_dictionary(size, pieces, k=64, d=8, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text
            dicts.append(b"".join(pieces)[:size] or b"-" * 8)
    model = Model(tuple(dicts), rate)
    x = model.features([t for texts in by for t in texts[1::2]])
    y = np.repeat([0.0, 1.0], [len(texts[1::2]) for texts in by])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    share = y.mean()
    w = logistic(np.clip((x - model.mean) / model.scale, -8, 8), y, np.where(y == 1, rate / share, (1 - rate) / (1 - share)))
    model.w = w
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", PER_CLASS))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
