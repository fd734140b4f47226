"""What the operators share: the shared folder, cut lineage, Arrow batches as flat byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import Scratch, cut, shared_dir, ship

__all__ = ["Scratch", "cut", "in_slices", "mix", "parts_for", "ragged", "read", "shared_dir", "ship", "slice_hashes", "text_or_empty"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def parts_for(spark: SparkSession, size: int, each: int = 128 << 20) -> int:
    """Into how many partitions so many bytes are dealt: the session's number, and enough that each holds about 128 MB."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def in_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts have about `limit` bytes (one row at least): the rows, all bytes, offsets. Null is empty.

    A batch of Spark has a set number of rows, so its bytes are unbounded; numpy work needs many times
    the bytes, so it goes by slices. A text is never divided."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(text), "").cast(pa.large_string())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            to = min(to, len(col))
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd base and of its inverse."""
    if len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15 | 1
        size = max(n, 1 << 19)
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from one running sum over data."""
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * GOLD)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0]+1, … of all runs, one run after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - first, length)
