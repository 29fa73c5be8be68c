"""Comparing all rows of a table of vectors with all others, in bounded memory.

The table is handed out in parts of at most about ``PART`` rows, each a broadcast of its own that the driver
holds only while it makes it.  A task has at most about ``OWN`` rows and reads one part after the other, so
neither the driver nor a task ever holds the whole table, and the rows of a task are finished where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part, and of a task.
PART, OWN = 32_768, 4_096
#: Rows whose distances to a part are held at once.
BLOCK = 256


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow column of lists, one a row."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``q`` to those of ``x``."""
    return np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :], 0)


class Parts:
    """Parts of a table, as whatever ``held`` makes of the Arrow table of each; a worker has one of them at a time."""

    def __init__(self, df: DataFrame, id_col: str, held: Callable, rows: int):
        n = -(-rows // PART) or 1
        sc = df.sparkSession.sparkContext
        part = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(n))
        self.parts = [sc.broadcast(held((df.where(part == i) if n > 1 else df).toArrow())) for i in range(n)]

    def __iter__(self) -> Iterator:
        for b in self.parts:
            yield b.value
            b.__dict__.pop("_value", None)  # what a worker has loaded stays with its broadcast otherwise


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions of about ``OWN`` rows."""
    return df.repartition(-(-rows // OWN) or 1)


def whole(batches) -> pa.RecordBatch | None:
    """The rows of a task as one batch; None if it has none."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks().to_batches()[0] if got else None
