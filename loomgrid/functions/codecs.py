"""Integer codecs: sizes as expressions, bytes as Arrow functions. Every decoder is the exact inverse of its encoder."""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def vbyte_size(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Control bits, 1 to 4 bytes a value, and 8; 8 for none."""
    b = F.when(F.col(v) < 1 << 8, 1).when(F.col(v) < 1 << 16, 2).when(F.col(v) < 1 << 24, 3).otherwise(4)
    return df.groupBy(*keys).agg((F.ceil(F.count("*") / 4) + F.sum(b) + 8).cast("long").alias("size"))


def elias_fano_size(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """4 bytes of low part a value, the high parts' bit vector in words, and 17."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(v).alias("m"))
    low = F.least(F.lit(31), F.floor(F.log2(F.greatest(F.lit(1), F.floor((F.col("m") + 1) / F.col("n"))))).cast("int"))
    high = F.floor(F.col("m") / F.pow(F.lit(2.0), low)).cast("long")
    return s.select(*keys, (4 * F.col("n") + 8 * F.ceil((high + F.col("n") + 1) / 64) + 17).cast("long").alias("size"))


def delta_encode(x: list[int]) -> list[int]:
    if any(b < a for a, b in zip(x, x[1:], strict=False)):
        raise ValueError("not sorted")
    return [b - a for a, b in zip([0, *x], x, strict=False)]


def delta_decode(x: list[int]) -> list[int]:
    return np.cumsum(np.array(x, dtype=np.int64)).tolist()


def vbyte_encode(x: list[int]) -> bytes:
    sizes = [max(1, (v.bit_length() + 7) // 8) for v in x]
    control = bytearray(-(-len(x) // 4))
    for i, n in enumerate(sizes):
        control[i // 4] |= (n - 1) << 2 * (i % 4)
    return struct.pack("<I", len(x)) + bytes(control) + b"".join(v.to_bytes(n, "little") for v, n in zip(x, sizes, strict=True))


def vbyte_decode(raw: bytes) -> list[int]:
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + -(-n // 4), []
    for i in range(n):
        size = (raw[4 + i // 4] >> 2 * (i % 4) & 3) + 1
        out.append(int.from_bytes(raw[at : at + size], "little"))
        at += size
    return out


def elias_fano_encode(x: list[int]) -> tuple[int, list[int], int, int]:
    """(count, low parts, high bits as an integer, low bits)."""
    if not x:
        return 0, [], 0, 0
    low = min(31, max(1, (max(x) + 1) // len(x)).bit_length() - 1)
    high = 0
    for i, v in enumerate(x):
        high |= 1 << ((v >> low) + i)
    return len(x), [v & ((1 << low) - 1) for v in x], high, low


def elias_fano_decode(code: tuple[int, list[int], int, int]) -> list[int]:
    n, lows, high, low = code
    out, at = [], 0
    while len(out) < n:
        if high >> at & 1:
            out.append((at - len(out)) << low | lows[len(out)])
        at += 1
    return out


def sorted_encode(x: list[int], codec: str = "delta"):
    """Delta or Elias-Fano for sorted lists, the raw list otherwise."""
    if any(b < a for a, b in zip(x, x[1:], strict=False)):
        return "raw", list(x)
    return (codec, delta_encode(x)) if codec == "delta" else (codec, elias_fano_encode(x))


def sorted_decode(code) -> list[int]:
    kind, x = code
    return list(x) if kind == "raw" else delta_decode(x) if kind == "delta" else elias_fano_decode(x)


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of a static prefix code."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, (s,)) for s, n in sorted(counts.items())]
    heapq.heapify(heap)
    out = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (*a[2], *b[2])))
    return out


def _codes(lengths: dict[int, int]) -> dict[int, str]:
    code, last, out = 0, 0, {}
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], code, last = format(code, f"0{n}b"), code + 1, n
    return out


def entropy_encode(x: list[int]) -> bytes:
    """A static-model prefix code: count, table of (symbol, length), then bits."""
    lengths = _lengths({int(s): int(n) for s, n in zip(*np.unique(x, return_counts=True), strict=True)}) if x else {}
    codes = _codes(lengths)
    bits = "".join(codes[v] for v in x)
    body = int(bits, 2).to_bytes(-(-len(bits) // 8), "big") if bits else b""
    return struct.pack("<III", len(x), len(lengths), len(bits)) + b"".join(struct.pack("<QB", s, n) for s, n in lengths.items()) + body


def entropy_decode(raw: bytes) -> list[int]:
    n, k, size = struct.unpack_from("<III", raw)
    back = {c: s for s, c in _codes(dict(struct.unpack_from("<QB", raw, 12 + 9 * i) for i in range(k))).items()}
    bits = format(int.from_bytes(raw[12 + 9 * k :], "big"), f"0{size}b") if size else ""
    out, at, end = [], 0, 1
    while len(out) < n:
        while bits[at:end] not in back:
            end += 1
        out.append(back[bits[at:end]])
        at, end = end, end + 1
    return out


def encode_stream(c: Column, codec: str = "arithmetic") -> Column:
    """Bytes of an array of non-negative integers."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: (entropy_encode if codec == "arithmetic" else vbyte_encode)([int(i) for i in v]))

    return run(c)


def decode_stream(c: Column, codec: str = "arithmetic") -> Column:
    @F.pandas_udf("array<long>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: (entropy_decode if codec == "arithmetic" else vbyte_decode)(bytes(v)))

    return run(c)


def element(raw: bytes, i: int, codec: str = "arithmetic") -> int:
    """The i-th value of a coded stream: all are decoded."""
    return (entropy_decode if codec == "arithmetic" else vbyte_decode)(raw)[i]


def arithmetic_size(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Bytes of a static arithmetic code with a dense table: 4 for each symbol from 0 to the largest, the entropy of the counts plus one in
    words of 32 bits (an estimate of the coder's own words), and 8."""
    counts = df.groupBy(*keys, v).agg(F.count("*").alias("c"))
    t = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.max(v).alias("m"), F.sum(F.col("c") * F.log2(F.col("c") + 1)).alias("s"))
    bits = F.round(F.col("n") * F.log2(F.col("n") + F.col("m") + 1) - F.col("s"), 6)
    return t.select(*keys, (4 * F.ceil(bits / 32) + 4 * (F.col("m") + 1) + 8).cast("long").alias("size"))


def delta_size(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """A sorted list as its first value and gaps, arithmetic coded, and 16."""
    w = Window.partitionBy(*keys).orderBy(v)
    gaps = df.select(*keys, (F.col(v) - F.coalesce(F.lag(v).over(w), F.lit(0))).alias("_gap"))
    return arithmetic_size(gaps, keys, "_gap").withColumn("size", F.col("size") + 16)


def log2_factorials(spark: SparkSession, most: int, run: int = 4096) -> DataFrame:
    """(n, log2 n!) for 1 to ``most``: running sums inside runs, then offsets of the runs before."""
    x = spark.range(1, most + 1).select(F.col("id").alias("n"), F.floor(F.col("id") / run).alias("_r"), F.log2("id").alias("_l"))
    inside = x.withColumn("_s", F.sum("_l").over(Window.partitionBy("_r").orderBy("n")))
    totals = x.groupBy("_r").agg(F.sum("_l").alias("_t"))  # a row for each run
    before = totals.select("_r", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_b"))
    return inside.join(before, "_r").select("n", (F.col("_s") + F.col("_b")).alias("lf"))
