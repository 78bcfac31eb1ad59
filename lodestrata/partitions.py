"""Parallelism of small inputs, and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Characters (bytes) or list items that a slice of an Arrow batch holds, about: what Python makes of them at once takes some hundred times as many bytes.
SLICE = 1 << 17


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, dealt over the cores; a larger scan as it is.

    A file with one row group is one task however it is split, which leaves all
    other cores idle before a costly step. Inputs of any size have more splits
    than cores and are not shuffled. Only plans; runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text or items of each list; null has none."""
    of = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return of(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterable[pa.RecordBatch], *columns: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices (views) of whole rows, each of about `most` characters or items of `columns` together; a longer row is a slice of its own.

    What a task makes of a slice is freed before the next, so that its memory depends neither on
    the rows of a batch nor on the size of the input.
    """
    for batch in batches:
        ends = np.cumsum(sum(lengths(batch.column(c)) for c in columns)) if batch.num_rows else np.empty(0, np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
