"""What the operators on vectors share: whole-numbered vectors as packed bytes, exact means merged from partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerege.llm._common import written
from kerege.shipping import ship_package

#: Scaled components stay below this, so that the squared distance of 256 of them fits 64 bits.
LIMIT = 1 << 27


def finite(vector: Column) -> Column:
    """Is the vector there, without null, NaN and infinite components?"""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _packing(scale: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(at)
            scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(scaled) and np.abs(scaled).max() >= LIMIT:
                raise ValueError(f"components of {LIMIT // scale} or more have distances that don't fit a long")
            whole = scaled.astype("<i4").tobytes()
            ends = np.concatenate(([0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False) * 4))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), packed], names=[*(n for k, n in enumerate(batch.schema.names) if k != at), "packed"])

    return run


def packed(rows: DataFrame, scale: int, name: str) -> DataFrame:
    """rows with an array `vector` of finite components: in its place `packed`, the 32-bit integers floor(scale * x); written, as it is read in every round.

    Components of LIMIT / scale or more in magnitude raise ValueError.
    """
    ship_package(rows.sparkSession)
    others = [f for f in rows.schema.fields if f.name != "vector"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "packed binary"])
    return written(rows.withColumn("vector", F.col("vector").cast("array<double>")).mapInArrow(_packing(scale, rows.columns.index("vector")), schema), name)


def unpacked(column: pd.Series, components: int) -> np.ndarray:
    """Rows of packed vectors as a matrix of 64-bit integers."""
    return np.frombuffer(b"".join(column), "<i4").reshape(-1, components).astype(np.int64)


def means(sums: DataFrame, keys: list[str], components: int) -> list:
    """Rows (keys, means list) of sums (keys, n, totals array<long>), one of each partition: floor(total / n) in whole numbers, exact for any number of rows."""
    totals = [F.sum(F.col("totals")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(components)]
    found = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *totals).collect()
    return [(tuple(r[k] for k in keys), [int(r[f"t{k}"]) // r.n for k in range(components)]) for r in found]
