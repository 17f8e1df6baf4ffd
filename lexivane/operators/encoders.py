"""Encoders of texts into vectors: hashed words, given vectors, or a model file."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions.vectors import normalized
from lexivane.operators.wordpiece import WordPiece, padded


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Words and pairs of Han characters hashed to signed places; needs no model and gives the same vectors anywhere."""

    def __init__(self, dim: int = 64, seed: int = 7):
        self.dim, self.seed = dim, seed

    def encode(self, texts: list[str]) -> np.ndarray:
        import re

        import xxhash

        word = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            words = word.findall((text or "").lower())
            for w in [*words, *(a + b for a, b in zip(words, words[1:], strict=False))]:
                h = xxhash.xxh3_64_intdigest(w, seed=self.seed)
                out[k, (h >> 1) % self.dim] += 1 if h & 1 else -1
        return unit(out)


class OnnxEncoder:
    """A sentence model: token ids, mean of the vectors of real tokens, length one. The file is loaded once in each worker."""

    def __init__(self, path: str, tokenizer: WordPiece, dim: int = 768, length: int = 512, batch: int = 32):
        self.path, self.tokenizer, self.dim, self.length, self.batch = path, tokenizer, dim, length, batch
        self._session = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.intra_op_num_threads = 1  # one thread for each task
            self._session = ort.InferenceSession(self.path, options)
        every = [self.tokenizer.ids(t, self.length) for t in texts]
        out = np.empty((len(texts), self.dim))
        # Texts of like length share a batch, padded to its longest.
        order = sorted(range(len(every)), key=lambda k: len(every[k]))
        for start in range(0, len(order), self.batch):
            part = order[start : start + self.batch]
            longest = max(len(every[k]) for k in part)
            ids, mask, kinds = (np.array(x, np.int64) for x in zip(*(padded(every[k], longest) for k in part), strict=True))
            hidden = self._session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds})[0]
            for k, h, m in zip(part, hidden, mask, strict=True):
                out[k] = pooled(h, int(m.sum()))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(n > 1e-12, x / np.where(n > 1e-12, n, 1), x)


def pooled(tokens: np.ndarray, real: int) -> np.ndarray:
    """The mean of the first ``real`` rows, of length one."""
    return unit(tokens[:real].mean(0)) if real else np.zeros(tokens.shape[-1])


def encoded(texts: DataFrame, encoder: Encoder, column: str, to: str) -> DataFrame:
    """With the vectors of a column in another, null where the text is null or empty."""
    shared = texts.sparkSession.sparkContext.broadcast(encoder)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            have = batch.notna() & (batch != "")
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            vectors = model.encode(batch[have].tolist())
            for k, v in zip(batch.index[have], vectors, strict=True):
                out[k] = v.astype(np.float32)
            yield out

    return texts.withColumn(to, run(column))


def mean_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the mean of each key's vectors, of length one, by built-in operators alone."""
    each = vectors.select(key, F.posexplode(vector).alias("p", "x"))
    mean = each.groupBy(key, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("v"))
    return rows.select(key, normalized(F.col("v.x")).alias(vector))


def normalized_column(vector: str) -> Column:
    return normalized(F.col(vector))
