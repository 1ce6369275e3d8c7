"""A columnar shuffle for array code: rows of packed numpy columns, keyed by a bucket.

A task splits its entries by bucket and sends one row a bucket, whose binary columns hold the entries' values. The receiver gets
the rows of each bucket together, sorted by Spark (which spills), and sees one bucket at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy


def schema(columns: dict[str, str], key: str = "bucket int") -> str:
    return ", ".join([key, *[f"{c} binary" for c in columns]])


def split(bucket: np.ndarray, columns: dict[str, np.ndarray], kinds: dict[str, str]) -> pa.RecordBatch | None:
    """One row a bucket of the entries' columns (each an array with one item an entry)."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    ends = np.r_[first[1:], len(order)]
    out = [pa.array(keys.astype(np.int32))]
    for name, kind in kinds.items():
        x = np.ascontiguousarray(columns[name].astype(kind, copy=False)[order])
        raw, wide = x.tobytes(), x.dtype.itemsize
        out.append(pa.array([raw[a * wide : b * wide] for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *kinds])


def joined(rows: list[tuple], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(r[i] for r in rows), dtype=kind) for i, (c, kind) in enumerate(kinds.items())}


def rows_of(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> Iterator[tuple]:
    for batch in batches:
        cols = [batch.column(c) for c in kinds]
        for i, key in enumerate(batch.column("bucket").to_pylist()):
            yield key, *(c[i].as_py() for c in cols)


def in_parts(rows: Iterator[tuple], kinds: dict[str, str], part: int | None) -> Iterator[dict[str, np.ndarray]]:
    """The columns of (bucket, ...) rows, about ``part`` entries at a time (None: all at once)."""
    held, size = [], 0
    wide = np.dtype(next(iter(kinds.values()))).itemsize
    for row in rows:
        held.append(row[1:])
        size += len(row[1]) // wide
        if part is not None and size >= part:
            yield joined(held, kinds)
            held, size = [], 0
    if held:
        yield joined(held, kinds)


def exchange(df: DataFrame, n: int, kinds: dict[str, str], run: Callable[[int, Iterator[dict[str, np.ndarray]]], Iterator[pa.RecordBatch]], out: str, part: int | None = None) -> DataFrame:
    """``run`` on each bucket of ``df``, dealt by bucket over n partitions; it gets a bucket's entries in parts, and must take them all."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in itertools.groupby(rows_of(batches, kinds), key=lambda r: r[0]):
            for batch in run(bucket, in_parts(rows, kinds, part)):
                if batch is not None and batch.num_rows:
                    yield batch

    return df.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(all_of), out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of_ids(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
