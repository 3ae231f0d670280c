"""Integer vectors shared by the vector operators: filtering, scaling and matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this count as it: the squared distance and the inner product of two vectors of 64 of them fit a long.
LARGEST = 1 << 27


def whole(vector: str, dimensions: int | None = None) -> Column:
    """A vector without null or non-finite components (of exactly ``dimensions`` of them, if given)."""
    x = F.col(vector)
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return ok & (F.size(x) == dimensions) if dimensions is not None else ok


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as an int, held within ``LARGEST``."""
    far = float(LARGEST)
    return F.transform(F.col(vector), lambda v: F.greatest(F.lit(-far), F.least(F.lit(far), F.floor(F.least(F.lit(far), F.greatest(F.lit(-far), v.cast("double"))) * scale).cast("double"))).cast("int"))


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Rows as a dense matrix; short rows are filled with zeros."""
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=kind)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of integer matrices: by floating point where no partial sum can leave its 53 bits, else by integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def kept(rows: DataFrame, dimensions: int | None = None, vector: str = "embedding", scale: int = 256, also: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, ``also`` and integer components ``q`` of the whole vectors of ``rows``."""
    return rows.filter(whole(vector, dimensions)).select(F.col("vec_id").cast("long").alias("vec_id"), *also, integers(vector, scale).alias("q"))
