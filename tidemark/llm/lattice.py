"""Vectors as whole numbers: every component c becomes floor(64 * c)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
#: With a squared length below this every inner product fits a long.
PRODUCTS_FIT = 2.0**62
#: With a squared length below this every component is a whole number that a double holds.
COMPONENTS_FIT = 2.0**104


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, below: float = PRODUCTS_FIT) -> DataFrame:
    """(node, x, width): x holds floor(64 * c) of every component as 8-byte integers.

    x is null where a vector is null, holds a null or non-finite component, or has a
    squared length that is not ``below`` the bound. An empty vector has an x without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            size = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            flat = column.flatten().cast(pa.float64(), safe=False)
            value = flat.to_numpy(zero_copy_only=False)
            value = np.floor(SCALE * np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, value))
            end = size.cumsum()
            with np.errstate(over="ignore", invalid="ignore"):
                if not np.isfinite(total := float(value @ value)) or total >= below:
                    there = there & np.array([bool(value[e - n : e] @ value[e - n : e] < below) for e, n in zip(end, size, strict=True)], bool)
            found = [value[e - n : e].astype(np.int64).tobytes() if ok else None for e, n, ok in zip(end, size, there, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()), pa.array(size, pa.int32())], ["node", "x", "width"])

    source = vectors.select(F.col(id_col).cast("long").alias("node"), F.col(vector_col).alias("vector"))
    return source.mapInArrow(run, "node long, x binary, width int")


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """The rows as one integer matrix; shorter ones are filled up with zeros."""
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, np.int64)
        out[i, : len(v)] = v
    return out
