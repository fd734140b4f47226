"""Batches of sequences as flat arrays, for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Slice = tuple[pa.Array, np.ndarray, np.ndarray]


def flat(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[Slice]:
    """Keys, all bytes and offsets of runs of (key, seq) rows with about `limit` bytes, one row at least. Null is empty; a sequence is never divided."""
    for batch in batches:
        col = pc.fill_null(batch.column("seq"), "").cast(pa.large_string())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = min(len(col), max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
            yield batch.column("key").slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def mapped(sequences: DataFrame, key: str, seq: str, kernel: Callable[[Slice], Iterator[dict]], columns: str, limit: int = 1 << 19) -> DataFrame:
    """key and columns (`name type, …`). kernel turns a slice into columns by name; `of` says which of the slice's keys a row has."""
    kind = sequences.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat(batches, limit):
            for found in kernel(part):
                of = found["of"]
                for at in range(0, len(of), 1 << 18):
                    here = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays([part[0].take(pa.array(of[here])), *[pa.array(found[c][here]) for c in names]], ["key", *names])

    rows = sequences.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq"))
    return rows.mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


def owners(off: np.ndarray) -> np.ndarray:
    """The sequence that each place belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
