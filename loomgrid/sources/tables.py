"""Sources and sinks: triple tables, positions, dense tables, summaries, payload folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ordinals of x and y in a position table.
POSITION_COLUMNS = {"visium": (4, 5), "xenium": (1, 2), "single-cell": (0, 1)}
#: Compression of payload folders by name.
CODECS = {"gzip": "gzip", "zstd": "zstd", "none": "none"}


def position_columns(platform: str | None, x: int | None = None, y: int | None = None) -> tuple[int, int]:
    """Fixed for visium and xenium; x and y or 0 and 1 for single-cell; 1 and 2 without a platform."""
    if platform in ("visium", "xenium"):
        return POSITION_COLUMNS[platform]
    default = (1, 2) if platform is None else POSITION_COLUMNS["single-cell"]
    return (default[0] if x is None else x, default[1] if y is None else y)


def clean_text(c: Column) -> Column:
    """A stored string: UTF-8, without NULs at either end."""
    return F.regexp_replace(c.cast("string"), "^\x00+|\x00+$", "")


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, col_id, value) from a Parquet triple table."""
    return spark.read.parquet(path).select(F.col("row_id").cast("long"), F.col("col_id").cast("long"), F.col("value").cast("long"))


def from_compressed(rows: DataFrame) -> DataFrame:
    """Triples from compressed rows (row_id, indices, data)."""
    return rows.select("row_id", F.explode(F.arrays_zip("indices", "data")).alias("e")).select(F.col("row_id").cast("long"), F.col("e.indices").cast("long").alias("col_id"), F.col("e.data").cast("long").alias("value"))


def write_matrix(coo: DataFrame, path: str, n_rows: int, n_cols: int, barcodes: DataFrame | None = None, features: DataFrame | None = None, codec: str = "zstd") -> None:
    """A matrix folder: triples, shape, barcodes (row_id, barcode) and features (col_id, id, name, feature_type, genome); placeholders where names aren't given."""
    spark = coo.sparkSession
    if barcodes is None:
        barcodes = spark.range(n_rows).select(F.col("id").alias("row_id"), F.concat(F.lit("cell_"), "id").alias("barcode"))
    if features is None:
        name = F.concat(F.lit("gene_"), "id")
        features = spark.range(n_cols).select(F.col("id").alias("col_id"), name.alias("name"), F.lit("Gene Expression").alias("feature_type"), F.lit("decoded").alias("genome")).withColumn("id", F.col("name"))
    shape = spark.createDataFrame([(n_cols, n_rows)], "features long, cells long")
    save_payload({"triples": coo, "shape": shape, "barcodes": barcodes, "features": features}, path, codec)


def load_matrix(spark: SparkSession, path: str, positions: DataFrame | None = None, orientation: str = "cell-gene", max_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples, points) of a matrix folder: its first ``max_cells`` cells, then cells or genes as rows. Every cell must have a position (barcode, x, y) if
    positions are given; points are (0, 0) otherwise, and for genes. Entries outside of the shape fail."""
    shape = spark.read.parquet(f"{path}/shape").collect()
    if len(shape) != 1:
        raise ValueError(f"{len(shape)} shapes in {path}")
    genes, cells = shape[0].features, shape[0].cells
    inside = (F.col("row_id") >= 0) & (F.col("row_id") < cells) & (F.col("col_id") >= 0) & (F.col("col_id") < genes)
    checked = F.when(~inside, F.raise_error(F.lit("an entry lies outside of the matrix")).cast("long")).otherwise(F.col("value"))
    coo = triples(spark, f"{path}/triples").withColumn("value", checked)
    rows = spark.read.parquet(f"{path}/barcodes").withColumn("barcode", clean_text(F.col("barcode")))
    if max_cells is not None:
        coo, rows = coo.where(F.col("row_id") < max_cells), rows.where(F.col("row_id") < max_cells)
    zero = lambda df: df.select("row_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    if orientation == "gene-cell":
        return coo.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value"), zero(spark.range(genes).withColumnRenamed("id", "row_id"))
    return coo, zero(rows) if positions is None else join_positions(rows, positions).select("row_id", "x", "y")


def load_dense(spark: SparkSession, path: str, positions: DataFrame | None = None) -> DataFrame:
    """(id, x, y, expr) of a matrix folder's cells, those without entries included."""
    coo, points = load_matrix(spark, path, positions)
    n = spark.read.parquet(f"{path}/shape").first().features
    none = F.array_repeat(F.lit(0.0), int(n))
    return points.join(to_dense(coo, n), "row_id", "left").select(F.col("row_id").alias("id"), "x", "y", F.coalesce("expr", none).alias("expr"))


def clean_positions(lines: DataFrame, x: int, y: int, order: str | None = None) -> DataFrame:
    """(barcode, x, y) from rows of a ``fields`` array of strings: bad numbers and empty keys drop the row, the last duplicate wins."""
    at = lambda i: F.try_element_at("fields", F.lit(i + 1))
    key = F.trim(F.regexp_replace(F.trim(at(0)), '^"+|"+$', ""))
    rows = lines.select(key.alias("barcode"), at(x).try_cast("double").alias("x"), at(y).try_cast("double").alias("y"), F.col(order) if order else F.monotonically_increasing_id().alias("_at"))
    rows = rows.where("barcode <> '' AND x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("barcode").agg(F.max_by(F.struct("x", "y"), order or "_at").alias("p")).select("barcode", "p.x", "p.y")


def positions_csv(spark: SparkSession, path: str, platform: str | None = "visium", x: int | None = None, y: int | None = None) -> DataFrame:
    return clean_positions(spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r'(?:^|,)((?:"(?:[^"]|"")*"|[^,])*)'), F.lit(1)).alias("fields")), *position_columns(platform, x, y))


def positions_parquet(df: DataFrame, platform: str | None = "xenium", x: int | None = None, y: int | None = None) -> DataFrame:
    """By ordinal; any numeric type is taken as a double."""
    i, j = position_columns(platform, x, y)
    return df.select(clean_text(F.col(df.columns[0])).alias("barcode"), F.col(df.columns[i]).cast("double").alias("x"), F.col(df.columns[j]).cast("double").alias("y"))


def dense_csv(spark: SparkSession, path: str, x: int = 1, y: int = 2, first: int = 3) -> DataFrame:
    """(id, x, y, expr): a bad value counts as 0, a bad coordinate fails."""
    df = spark.read.option("header", True).csv(path)
    c = df.columns
    return df.select(F.col(c[0]).alias("id"), F.col(c[x]).cast("double").alias("x"), F.col(c[y]).cast("double").alias("y"), F.array(*[F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) for n in c[first:]]).alias("expr"))


def to_dense(coo: DataFrame, columns: int) -> DataFrame:
    """(row_id, expr) with implicit zeros."""
    m = F.map_from_entries(F.collect_list(F.struct("col_id", "value")))
    return coo.groupBy("row_id").agg(m.alias("m")).select("row_id", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0)).cast("double")).alias("expr"))


def subset_rows(coo: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows in the order of ``picks`` (pos, row_id), duplicates kept; ``pos`` is the new row."""
    return picks.join(coo, "row_id").select(F.col("pos").cast("long").alias("row_id"), "col_id", "value")


def join_positions(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Every barcode of ``rows`` must have a position; others are ignored."""
    joined = rows.join(positions, "barcode", "left")
    return joined.withColumn("x", F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("no position for "), "barcode")).cast("double")).otherwise(F.col("x")))


def save_payload(members: dict[str, DataFrame], path: str, codec: str = "zstd") -> None:
    for name, df in members.items():
        df.write.mode("overwrite").option("compression", CODECS[codec]).parquet(f"{path}/{name}")


def load_payload(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_stats(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def summary_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, kind, p) of the p_l0 columns of CSV files whose names hold _l0 and _spatial or _exprs; bad numbers are NaN."""
    df = spark.read.option("header", True).csv(f"{folder}/*_l0*.csv").withColumn("_f", F.lower(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)))
    kind = F.when(F.col("_f").contains("_spatial"), "spatial").when(F.col("_f").contains("_exprs"), "exprs")
    return df.select(F.regexp_extract("_f", "^(.*?)(?:_spatial|_exprs)", 1).alias("dataset"), kind.alias("kind"), F.coalesce(F.col("p_l0").try_cast("double"), F.lit(float("nan"))).alias("p")).where("kind IS NOT NULL")


def summary_table(significant: DataFrame) -> DataFrame:
    """(filename, spatial_l0, spatial_l0 rate, exprs_l0) by name from (dataset, kind, significant, total); blank where a kind is missing."""
    hits = F.format_string("%d/%d", "significant", "total")
    of = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, c)), F.lit(""))
    rate = F.format_string("%.2f", F.try_divide(F.col("significant").cast("double"), F.col("total")))
    t = significant.groupBy(F.col("dataset").alias("filename")).agg(of("spatial", hits).alias("spatial_l0"), of("spatial", rate).alias("spatial_l0 rate"), of("exprs", hits).alias("exprs_l0"))
    return t.orderBy("filename")


def permutation_wide(results: dict[str, DataFrame], neighbour_label: str, perms: int) -> DataFrame:
    """One row a cell from (anchor, observed, p, draws) of each metric: mean_obs_L, L_val_j and L_p; draws that weren't made stay empty."""
    out = None
    for name, df in results.items():
        draws = [F.get("draws", F.lit(j)).alias(f"{name}_val_{j}") for j in range(perms)]
        one = df.select(F.col("anchor").alias("cell"), F.col("observed").alias(f"mean_obs_{name}"), *draws, F.col("p").alias(f"{name}_p"))
        out = one if out is None else out.join(one, "cell", "full")
    return out.select("cell", F.lit(neighbour_label).alias("neighbor_by"), *out.columns[1:])


def rank_sum_wide(results: dict[str, DataFrame], neighbour_label: str) -> DataFrame:
    """One row a cell from (anchor, u, p, obs, rand) of each metric: ustat_L, p_L (NaN without a test), L_obs_j and L_rand_j, shorter lists padded with nulls."""
    out = None
    for name, df in results.items():
        obs, rand = df.agg(F.max(F.size("obs")), F.max(F.size("rand"))).first()
        wide = [F.get(c, F.lit(j)).alias(f"{name}_{c}_{j}") for c, n in (("obs", obs), ("rand", rand)) for j in range(n or 0)]
        nan = F.lit(float("nan"))
        one = df.select(F.col("anchor").alias("cell"), F.coalesce("u", nan).alias(f"ustat_{name}"), F.coalesce("p", nan).alias(f"p_{name}"), *wide)
        out = one if out is None else out.join(one, "cell", "full")
    return out.select("cell", F.lit(neighbour_label).alias("neighbor_by"), *out.columns[1:])


def write_wide(wide: DataFrame, path: str) -> None:
    """A wide result as CSV files with headers, empty where a value is missing."""
    wide.write.mode("overwrite").option("header", True).csv(path)
