"""Seriation, clusters and column blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import equal_shares, numbered

# The mixing constants of the 64-bit hash and the seeds of the projections that use it.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
COLUMN_SEEDS = (0xA5A5A5A5A5A5A5A5, 0xC3C3C3C3C3C3C3C3, 0x5A5A5A5A5A5A5A5A, 0x3C3C3C3C3C3C3C3C)
ROW_SEEDS = (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C)
SUPPORT_SEEDS = (0x916AD5EFC3A97B21, 0x2F7B9A1084DE63C5)
TEMPLATE_SEEDS = (0x41A836D5C20F9871, 0xD37E6CB49A51204F)


def mix64(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def projection_weight(c: Column, seed: int) -> Column:
    """A weight in [-1, 1] for each id; unsigned 64-bit arithmetic has no Spark type, hence an Arrow function."""

    @F.pandas_udf("double")
    def weigh(x: pd.Series) -> pd.Series:
        z = mix64(x.to_numpy(dtype=np.int64).astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(seed))
        return pd.Series(z.astype(np.float64) / float(2**64 - 1) * 2.0 - 1.0)

    return weigh(c)


def weights_sql(x: str, seed: int) -> str:
    """The same weight in DuckDB."""
    m = "CAST(18446744073709551616 AS UHUGEINT)"
    z = f"((CAST({x} AS UHUGEINT) * {GOLDEN} + {seed}) % {m})"
    step = lambda v, s, k: f"((xor({v}, {v} >> {s}) * {k}) % {m})"
    return f"(SELECT CAST(xor(z3, z3 >> 31) AS DOUBLE) / 18446744073709551615.0 * 2.0 - 1.0 FROM (SELECT {step('z2', 27, MIX_2)} AS z3 FROM (SELECT {step('z1', 30, MIX_1)} AS z2 FROM (SELECT {z} AS z1))))"


def equal_cuts(rows: DataFrame, k: int, order: list[str]) -> DataFrame:
    """k clusters of consecutive rows, the first ones larger by one where sizes differ."""
    return equal_shares(rows, order, k, "cluster_id")


def round_robin(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("cluster_id", F.pmod("row_id", F.lit(k)).cast("long"))


def split_clusters(assign: DataFrame, most: int) -> DataFrame:
    """Clusters of at most ``most`` rows, numbered by their first row."""
    return _split(assign, F.floor((F.row_number().over(Window.partitionBy("cluster_id").orderBy("row_id")) - 1) / max(1, most)))


def split_by_entries(assign: DataFrame, coo: DataFrame, most: int) -> DataFrame:
    """Clusters cut where a running count of their rows' entries passes a multiple of ``most``, numbered by their first row: each has at most
    ``most`` entries and those of one row."""
    sizes = assign.join(coo.groupBy("row_id").agg(F.count("*").alias("_n")), "row_id")
    before = F.sum("_n").over(Window.partitionBy("cluster_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1))
    return _split(sizes, F.floor(F.coalesce(before, F.lit(0)) / most))


def _split(assign: DataFrame, part: Column) -> DataFrame:
    parts = assign.withColumn("_p", part)
    first = F.min("row_id").over(Window.partitionBy("cluster_id", "_p"))
    parts = parts.withColumn("_f", first)
    heads = numbered(parts.select("_f").distinct(), ["_f"])
    return parts.join(heads, "_f").select("row_id", F.col("idx").alias("cluster_id"))


def positions_in(assign: DataFrame) -> DataFrame:
    """Place of each row inside its cluster, by row id."""
    return assign.withColumn("pos", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("row_id")) - 1).cast("long"))


def column_blocks(columns: DataFrame, blocks: int, order: list[str], most: int | None = None) -> DataFrame:
    return equal_shares(columns, order, max(1, blocks), "block_id", most)


def row_stream(assign: DataFrame) -> DataFrame:
    """(row_id, pos): clusters one after the other, rows by id inside them."""
    return numbered(assign.select("cluster_id", "row_id"), ["cluster_id", "row_id"]).select("row_id", F.col("idx").alias("pos"))


def covered(assign: DataFrame, rows: DataFrame) -> DataFrame:
    """``assign``, or an error if a row of ``rows`` has no cluster, two of them, or isn't known."""
    n = assign.groupBy("row_id").agg(F.count("cluster_id").alias("n")).join(rows.select("row_id").distinct().withColumn("known", F.lit(True)), "row_id", "full")
    bad = n.where("n IS NULL OR n <> 1 OR known IS NULL").orderBy("row_id").first()
    if bad is not None:
        raise ValueError(f"row {bad.row_id} is in {bad.n or 0} clusters, known: {bool(bad.known)}")
    return assign


def column_order(coo: DataFrame, stream: DataFrame) -> DataFrame:
    """Columns by four hash projections of the places of their rows in ``stream`` (row_id, pos); ties by mean place, count, id."""
    weighed = stream.select("row_id", "pos", *[projection_weight(F.col("pos"), s).alias(f"w{i}") for i, s in enumerate(COLUMN_SEEDS)])
    score = coo.join(weighed, "row_id").groupBy("col_id").agg(*[F.round(F.avg(f"w{i}"), 9).alias(f"s{i}") for i in range(4)], F.avg("pos").alias("mean_pos"), F.count("*").alias("n"))
    return numbered(score, ["s0", "s1", "s2", "s3", "mean_pos", F.desc("n"), "col_id"]).select("col_id", F.col("idx").alias("new_id"))


def row_order(coo: DataFrame) -> DataFrame:
    """Rows by two projections weighted with ln(1 + value); ties by entries, id."""
    w = coo.select("row_id", "value", *[projection_weight(F.col("col_id"), s).alias(f"w{i}") for i, s in enumerate(ROW_SEEDS)])
    s = w.groupBy("row_id").agg(*[F.round(F.sum(F.log1p("value") * F.col(f"w{i}")), 6).alias(f"s{i}") for i in range(2)], F.count("*").alias("n"))
    return numbered(s, ["s0", "s1", "n", "row_id"]).select("row_id", F.col("idx").alias("pos"))


def dense_sample(coo: DataFrame, rows: list[int], cols: list[int], weight: Column) -> np.ndarray:
    """The entries of a few rows and columns (their product is bounded), summed by place on the executors."""
    spark = coo.sparkSession
    few = lambda ids, key, at: F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{key} long, {at} long"))
    sample = coo.join(few(rows, "row_id", "_i"), "row_id").join(few(cols, "col_id", "_j"), "col_id").select("_i", "_j", weight.cast("double").alias("v")).toArrow()
    m = np.zeros((len(rows), len(cols)))
    m[sample["_i"].to_numpy(), sample["_j"].to_numpy()] = sample["v"].to_numpy()
    return m


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive."""
    return v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])


def thin_svd(m: np.ndarray, fast: bool, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(singular values, right vectors), by a random sketch with one power step if ``fast``; exact if that isn't finite, none if it fails."""
    try:
        if fast:
            y = m @ np.random.default_rng(seed).uniform(-1, 1, (m.shape[1], min(6, *m.shape)))
            q, _ = np.linalg.qr(m @ (m.T @ y))
            _, s, vt = np.linalg.svd(q.T @ m, full_matrices=False)
            if np.isfinite(vt).all():
                return s, vt
        _, s, vt = np.linalg.svd(m, full_matrices=False)
        return s, vt
    except np.linalg.LinAlgError:
        return None


def stride(n: int, most: int) -> list[int]:
    """``most`` places of n at even steps, or all."""
    return list(range(n)) if n <= most else [i * n // most for i in range(most)]


def strided(rows: DataFrame, most: int) -> list[int]:
    n = rows.count()
    places = rows.sparkSession.createDataFrame([(i,) for i in stride(n, most)], "idx long")  # ``most`` at most
    return sorted(r[0] for r in numbered(rows, ["row_id"]).join(F.broadcast(places), "idx").select("row_id").collect())


def svd_order(coo: DataFrame, k: int, seed: int | None = 42, rows: int = 2000, columns: int = 2000, fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clusters of rows and order of columns by the leading singular vectors of a bounded sample (largest component positive). Rows are sampled by
    hash, or at even steps without a ``seed``. With two columns or fewer, or if the SVD fails, rows are dealt in turn and columns keep their order."""
    spark = coo.sparkSession
    active = coo.groupBy("col_id").agg(F.count("*").alias("n"))
    cols = [r[0] for r in active.orderBy(F.desc("n"), "col_id").limit(columns).collect()]
    all_rows = coo.select("row_id").distinct()

    @F.pandas_udf("string")
    def rank(x: pd.Series) -> pd.Series:
        z = mix64(x.to_numpy(dtype=np.int64).astype(np.uint64) ^ np.uint64(seed) ^ np.uint64(GOLDEN))
        return pd.Series([f"{v:020d}" for v in z])

    plain = round_robin(all_rows, k), active.select("col_id", F.col("col_id").alias("new_id"))
    if len(cols) <= 2:
        return plain
    picked = strided(all_rows, rows) if seed is None else sorted(r[0] for r in all_rows.orderBy(rank("row_id"), "row_id").limit(rows).collect())
    found = thin_svd(dense_sample(coo, picked, cols, F.col("value")), fast, seed or 0)
    if found is None:
        return plain
    s, vt = found
    n = max(1, min(2, k, len(s)))
    v = signed(vt[:n].T)
    loadings = spark.createDataFrame([(c, *map(float, v[i]), *([0.0] * (2 - n))) for i, c in enumerate(cols)], "col_id long, v0 double, v1 double")
    inv = [1 / x if x > 1e-12 else 0.0 for x in [*s[:n], 0.0][:2]]
    emb = coo.join(F.broadcast(loadings), "col_id").groupBy("row_id").agg(*[F.round(F.sum(F.col("value") * F.col(f"v{i}")) * inv[i], 9).alias(f"e{i}") for i in range(2)])
    placed = all_rows.join(emb, "row_id", "left").fillna(0.0)
    return equal_cuts(placed, k, ["e0", "e1", "row_id"]).select("row_id", "cluster_id"), by_loadings(active, loadings)


def by_loadings(active: DataFrame, loadings: DataFrame) -> DataFrame:
    """(col_id, new_id): columns by their loadings, those without at the end by id."""
    x = active.select("col_id").join(F.broadcast(loadings), "col_id", "left")
    x = x.select("col_id", F.col("v0").isNull().alias("last"), F.round(F.col("v0") + 0.0, 9).alias("v0"), F.round(F.col("v1") + 0.0, 9).alias("v1"))
    return numbered(x, ["last", "v0", "v1", "col_id"]).select("col_id", F.col("idx").alias("new_id"))


def support_svd_order(coo: DataFrame, rows: int = 4000, columns: int = 2000) -> DataFrame:
    """(col_id, new_id): columns by the two leading right singular vectors of the binary support, each column divided by the root of its count.
    Rows are taken at even steps, columns by frequency; with two columns or fewer, or if the SVD fails, columns keep their order."""
    active = coo.groupBy("col_id").agg(F.count("*").alias("n"))
    top = active.orderBy(F.desc("n"), "col_id").limit(columns).collect()
    cols = sorted(r.col_id for r in top)
    if len(cols) <= 2:
        return active.select("col_id", F.col("col_id").alias("new_id"))
    n = dict(top)
    m = dense_sample(coo, strided(coo.select("row_id").distinct(), rows), cols, F.lit(1)) / np.sqrt([n[c] for c in cols])
    found = thin_svd(m, False, 0)
    if found is None:
        return active.select("col_id", F.col("col_id").alias("new_id"))
    v = signed(found[1][:2].T)
    v = np.c_[v, np.zeros((len(cols), 2 - v.shape[1]))]
    return by_loadings(active, coo.sparkSession.createDataFrame([(c, float(a), float(b)) for c, (a, b) in zip(cols, v, strict=True)], "col_id long, v0 double, v1 double"))
