"""Distances of sparse rows (from shared columns only) and of dense rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_squares(coo: DataFrame, keys: list[str]) -> DataFrame:
    return coo.groupBy(*keys).agg(F.count("*").alias("nnz"), F.sum(F.col("value") * F.col("value")).alias("ss"))


def pair_metrics(pairs: DataFrame, coo: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """l0, l2 (squared), hamming and jaccard (scaled by 1e6) of pairs (on..., a, b) of rows ``keys[-1]`` inside ``on``.

    One equi-join finds the shared columns; what isn't shared follows from the rows' own counts."""
    row = keys[-1]
    side = lambda n: coo.select(*on, F.col(row).alias(n), "col_id", F.col("value").alias(f"v{n}"))
    both = pairs.join(side("a"), [*on, "a"]).join(side("b"), [*on, "b", "col_id"])
    shared = both.groupBy(*on, "a", "b").agg(F.count("*").alias("i"), F.sum(F.col("va") * F.col("vb")).alias("dot"), F.count_if(F.col("va") == F.col("vb")).alias("eq"))
    own = row_squares(coo, [*on, row])
    has = lambda n: own.select(*on, F.col(row).alias(n), F.col("nnz").alias(f"n{n}"), F.col("ss").alias(f"s{n}"))
    full = pairs.join(shared, [*on, "a", "b"], "left").join(has("a"), [*on, "a"], "left").join(has("b"), [*on, "b"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select(
        *on, "a", "b", (z("na") + z("nb") - 2 * z("i")).cast("long").alias("l0"), (z("sa") + z("sb") - 2 * z("dot")).cast("long").alias("l2"),
        (z("na") + z("nb") - z("i") - z("eq")).cast("long").alias("hamming"), scaled_jaccard(z("i"), z("na") + z("nb") - z("i")).alias("jaccard"))


def scaled_jaccard(i: Column, u: Column) -> Column:
    """Single-precision 1 - i / u at every step, times 1e6, rounded; 0 for two empty rows."""
    ratio = (i.cast("float") / u.cast("float")).cast("float")
    return F.when(u == 0, F.lit(0)).otherwise(F.round(((F.lit(1).cast("float") - ratio).cast("float") * F.lit(1000000).cast("float")).cast("float")).cast("long")).cast("long")


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 if either norm is 0."""
    dot, na, nb = (_sum(x, y, lambda p, q: p * q) for x, y in ((a, b), (a, a), (b, b)))
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, F.sqrt(na) * F.sqrt(nb)))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda p, q: (p - q) * (p - q)))


def l0(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: ((p > 0) != (q > 0)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
