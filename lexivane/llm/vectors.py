"""Dense vectors as matrices, and bounded samples of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.sampling import least_hashed


def usable(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that have ``dim`` finite values, not all zero, and those vectors as a matrix of float64."""
    sizes = np.fromiter((-1 if v is None else len(v) for v in vectors), np.int64, len(vectors))
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.empty((0, dim))
    x = np.concatenate([np.asarray(vectors.iloc[k], np.float64) for k in at]).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large or small values neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def as_bytes(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def from_bytes(values: pd.Series, dim: int) -> np.ndarray:
    """The vectors kept by ``unit_rows``, brought to length one."""
    return unit(np.frombuffer(b"".join(values), np.float32).reshape(-1, dim).astype(np.float64)) if len(values) else np.empty((0, dim))


def _as_float32(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    return np.where((top > 1e30) | (top < 1e-30), x / top, x).astype(np.float32)


def unit_rows(rows: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """id, v: the usable vectors as bytes of float32; other rows are left out. A vector beyond float32 is scaled first."""

    def run(batches):
        for batch in batches:
            at, x = usable(batch["v"], dim)
            if len(at):
                yield pd.DataFrame({"id": batch["id"].to_numpy()[at].astype(np.int64), "v": as_bytes(_as_float32(x))})

    picked = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    return picked.where("id is not null and v is not null").mapInPandas(run, "id long, v binary")


def sampled(rows: DataFrame, most: int, dim: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` rows of (id, v), those with the least hash of the id: a sample any run repeats."""
    got = least_hashed(rows.select("id", "v"), "id", most, seed).toPandas()
    return got["id"].to_numpy(np.int64), from_bytes(got["v"], dim)
