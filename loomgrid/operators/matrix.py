"""Count matrices as triples (row_id, col_id, value): reorient, limit, project, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, row, col) -> DataFrame:
    """Triples that count the rows of ``df`` by two keys."""
    return df.groupBy(row.cast("long").alias("row_id"), col.cast("long").alias("col_id")).agg(F.count("*").alias("value"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def limit_cells(coo: DataFrame, n: int) -> DataFrame:
    return coo.where(F.col("row_id") < n)


def drop_zeros(coo: DataFrame) -> DataFrame:
    return coo.where("value > 0")


def project(coo: DataFrame, block: DataFrame) -> DataFrame:
    """Columns of a block (col_id, new_id), renumbered; others go. Further columns of ``block`` stay, so many blocks can be projected at once."""
    return coo.join(block, "col_id").select(*[c for c in block.columns if c not in ("col_id", "new_id")], "row_id", F.col("new_id").alias("col_id"), "value")


def row_form(coo: DataFrame, row: str = "row_id", col: str = "col_id") -> DataFrame:
    return coo.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("c"), F.col("value").alias("v")))).alias("entries"))


def stats(coo: DataFrame, key: str) -> DataFrame:
    """Entries and sum of each row or column."""
    return coo.groupBy(key).agg(F.count("*").alias("nnz"), F.sum("value").cast("long").alias("total"))


def summary(coo: DataFrame) -> DataFrame:
    return coo.agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("col_id").alias("n_cols"), F.count("*").alias("nnz"), F.sum("value").cast("long").alias("total"), F.max("value").alias("max_value"))


def histogram(coo: DataFrame) -> DataFrame:
    return coo.groupBy(F.col("value").alias("symbol")).agg(F.count("*").alias("n"))


def entropy_bits(hist: DataFrame) -> DataFrame:
    """Zero-order entropy of a histogram (symbol, n): bits = -sum n log2(n / N)."""
    total = hist.agg(F.sum("n").alias("total"))
    return hist.join(F.broadcast(total)).agg(F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("total"))), 4).alias("bits"), F.sum("n").cast("long").alias("total"), F.count("*").alias("symbols"))


def laplace(hist: DataFrame) -> DataFrame:
    """Counts plus one over every symbol from 0 to the largest."""
    most = hist.agg(F.max("symbol")).first()[0]
    alphabet = hist.sparkSession.range(0 if most is None else most + 1).select(F.col("id").alias("symbol"))
    return alphabet.join(hist, "symbol", "left").select("symbol", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("n"))


def top_columns(coo: DataFrame, n: int) -> DataFrame:
    return stats(coo, "col_id").orderBy(F.desc("nnz"), "col_id").limit(n).select("col_id", "nnz")


def stride_sample(values: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row in ``order``, k = ceil(n / most), the first included. Rows are numbered by range, not in one task."""
    n = values.count()
    return numbered(values, order).where((F.col("idx") % max(1, -(-n // most))) == 0)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over the shuffles of one run: whatever reads it finds the same rows in the same partitions. Ranges that are planned again, as
    for a reader of fewer columns, are sampled anew and fall elsewhere."""
    spark = df.sparkSession
    return type(df)(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def numbered(df: DataFrame, order: list, total: str | None = None) -> DataFrame:
    """``df`` with idx, the place of each row in ``order`` from 0 (and, if named, the ``total``): counted per range, then offset by the ranges before."""
    ranged = dealt(df.repartitionByRange(*order))
    parts = ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.count("*").alias("_n"))
    offsets = parts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_t", F.sum("_n").over(Window.partitionBy())).select("_p", "_o", "_t")
    placed = ranged.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())  # the partition, then 33 bits of the place in it
    at = placed.withColumn("_p", F.shiftright("_m", 33).cast("int")).join(F.broadcast(offsets), "_p")
    return at.withColumn("idx", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).withColumn(total or "_t", F.col("_t")).drop("_p", "_o", "_m", *([] if total == "_t" else ["_t"]))


def equal_shares(df: DataFrame, order: list, k: int, name: str, most: int | None = None) -> DataFrame:
    """``df`` with ``name``: the number of each row's share of k shares of consecutive rows, the first ones larger by one where sizes differ.
    Where shares would have more than ``most`` rows, there are the least multiple of k that keeps to it."""
    parts = F.lit(k) if most is None else F.greatest(F.lit(1), F.ceil(F.col("_total") / (k * most))) * k
    size = F.floor(F.col("_total") / parts)
    larger = (size + 1) * (F.col("_total") % parts)  # rows in shares that are larger by one
    share = F.when(F.col("idx") < larger, F.floor(F.col("idx") / (size + 1))).otherwise(F.floor(F.try_divide(F.col("idx") - larger, size)) + F.col("_total") % parts)
    return numbered(df, order, "_total").withColumn(name, share.cast("long")).drop("idx", "_total")


def log_moments(coo: DataFrame, n_rows: int) -> DataFrame:
    """Mean and unbiased variance of ln(1 + value) by column, implicit zeros included."""
    s = F.sum(F.log1p("value"))
    q = F.sum(F.pow(F.log1p("value"), 2.0))
    return coo.groupBy("col_id").agg(F.round(s / n_rows, 6).alias("mean"), F.round((q - s * s / n_rows) / (n_rows - 1), 6).alias("var"))


def top_zscores(coo: DataFrame, n_rows: int, most: int = 2000) -> DataFrame:
    """(row_id, col_id, z, zero_z) of the ``most`` columns whose ln(1 + value) varies most; ties by id, constant columns go.

    Stored entries alone have rows: every other entry of a column is its ``zero_z``, so the result stays sparse."""
    s, q = F.sum(F.log1p("value")), F.sum(F.pow(F.log1p("value"), 2.0))
    m = coo.groupBy("col_id").agg((s / n_rows).alias("mean"), F.round((q - s * s / n_rows) / max(n_rows - 1, 1), 9).alias("var"))
    top = m.where("var > 1e-12").orderBy(F.desc("var"), "col_id").limit(most)
    z = lambda x: F.round((x - F.col("mean")) / F.sqrt("var"), 4)
    return coo.join(top, "col_id").select("row_id", "col_id", z(F.log1p("value")).alias("z"), z(F.lit(0.0)).alias("zero_z"))
