"""The whole job: cluster, tile, encode, decode, verify, quantise, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import decode_stream, encode_stream, log2_factorials
from ..operators import edits, graph, matrix, metrics, order
from .tile import CATEGORIES, MODES, TILE, EncodeConfig, decode_tile, encode_tile


def tiles(coo: DataFrame, cfg: EncodeConfig = EncodeConfig()) -> DataFrame:
    """Triples with cluster_id, pos, block_id, the block's local column, and the tile's height and width; values are quantised by cluster if ``lossy_bins`` is set.
    Clusters and blocks too large for a task are tiled in parts."""
    rows = coo.select("row_id").distinct()
    assign = order.equal_cuts(rows, cfg.cell_blocks, ["row_id"])
    if cfg.max_cluster:
        assign = order.split_clusters(assign, cfg.max_cluster)
    cut = order.split_by_entries(assign, coo, cfg.tile_entries)  # for the tiles alone: values are quantised by whole clusters
    placed = order.positions_in(cut).withColumn("height", F.count("*").over(Window.partitionBy("cluster_id")))
    blocks = order.column_blocks(coo.select("col_id").distinct(), cfg.gene_blocks, ["col_id"], cfg.tile_columns)
    by = Window.partitionBy("block_id")
    local = blocks.select("col_id", "block_id", (F.row_number().over(by.orderBy("col_id")) - 1).cast("long").alias("local"), F.count("*").over(by).alias("width"))
    if cfg.lossy_bins:
        coo = quantize(coo.join(assign, "row_id"), cfg.lossy_bins).select("row_id", "col_id", F.col("quantized").alias("value"))
    return coo.join(placed, "row_id").join(local, "col_id")


def encode(tiled: DataFrame, cfg: EncodeConfig = EncodeConfig()) -> DataFrame:
    return tiled.drop("row_id", "col_id").groupBy("cluster_id", "block_id").applyInPandas(lambda df: encode_tile(df, cfg), TILE)


def encode_maps(tiled: DataFrame) -> DataFrame:
    """(side, group_id, ids): the coded row ids of each cluster and column ids of each block, in their places' order."""
    one = lambda side, group, at, key: tiled.select(F.lit(side).alias("side"), F.col(group).alias("group_id"), F.col(at).alias("at"), F.col(key).alias("id")).distinct()
    places = one("row", "cluster_id", "pos", "row_id").unionByName(one("column", "block_id", "local", "col_id"))
    ids = places.groupBy("side", "group_id").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("x"))
    # a place without entries is left out of the map, so places are coded beside ids
    coded = lambda f: encode_stream(F.transform("x", lambda e, i: edits.zigzag(e[f] - F.when(i > 0, F.get(F.col("x"), i - 1)[f]).otherwise(0))), "stream-vbyte")
    return ids.select("side", "group_id", coded("at").alias("places"), coded("id").alias("ids"))


def decode_maps(maps: DataFrame, side: str, group: str, at: str, key: str) -> DataFrame:
    total = lambda c: F.transform(decode_stream(F.col(c), "stream-vbyte"), edits.unzigzag)
    zipped = maps.where(F.col("side") == side).select(F.col("group_id").alias(group), F.posexplode(F.arrays_zip(total("places").alias("p"), total("ids").alias("i"))).alias("_m", "e"))
    run = lambda c: F.sum(f"e.{c}").over(Window.partitionBy(group).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return zipped.select(group, run("p").alias(at), run("i").alias(key))


def decode(encoded: DataFrame, maps: DataFrame, cfg: EncodeConfig = EncodeConfig()) -> DataFrame:
    """Triples again, from coded tiles and ``encode_maps``; an entry whose place no map holds is an error."""
    flat = encoded.groupBy("cluster_id", "block_id").applyInPandas(lambda df: decode_tile(df, cfg), "cluster_id long, block_id long, pos long, local long, value long")
    rows, cols = decode_maps(maps, "row", "cluster_id", "pos", "row_id"), decode_maps(maps, "column", "block_id", "local", "col_id")
    both = flat.join(rows, ["cluster_id", "pos"], "left").join(cols, ["block_id", "local"], "left")
    held = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a tile's entry has no {c}")).cast("long")).otherwise(F.col(c)).alias(c)
    return both.select(held("row_id"), held("col_id"), "value")


def same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fingerprints(coo: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """How often each sorted list of values occurs among rows and among columns: equal for permuted matrices. ``rows`` (row_id) and ``cols``
    (col_id) bring in those without entries."""

    def one(k: str, side: str, every: DataFrame | None) -> DataFrame:
        held = coo if every is None else every.select(k).distinct().join(coo, k, "left")
        lists = held.groupBy(k).agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("vals"))
        return lists.groupBy("vals").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), F.md5("vals").alias("vals"), "n")

    return one("row_id", "row", rows).unionByName(one("col_id", "column", cols))


def centers(assigned: DataFrame, bins: int) -> DataFrame:
    """(cluster_id, center): all distinct values if they are no more than ``bins``, else values at even ranks."""
    by = Window.partitionBy("cluster_id")
    counted = assigned.groupBy("cluster_id", "value").agg(F.count("*").alias("c"))
    run = counted.withColumn("hi", F.sum("c").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by)).withColumn("d", F.count("*").over(by))
    few = run.where(F.col("d") <= bins).select("cluster_id", F.col("value").alias("center"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (bins - 1)) if bins > 1 else F.floor(F.col("n") / 2)))
    places = run.where(F.col("d") > bins).select("cluster_id", "n").distinct().select("cluster_id", at.alias("at"))
    many = places.join(run.withColumn("lo", F.col("hi") - F.col("c")), "cluster_id").where("at >= lo AND at < hi").select("cluster_id", F.col("value").alias("center"))
    return few.unionByName(many).distinct()


def quantize(assigned: DataFrame, bins: int) -> DataFrame:
    """``assigned`` (row_id, col_id, value, cluster_id) with ``quantized``: the nearest center, the lower on ties."""
    values = assigned.select("cluster_id", "value").distinct().join(centers(assigned, bins), "cluster_id")
    best = values.groupBy("cluster_id", "value").agg(F.min_by("center", F.struct(F.abs(F.col("value") - F.col("center")), "center")).alias("quantized"))
    return assigned.join(best, ["cluster_id", "value"])


def distortion(quantized: DataFrame, cells: int) -> DataFrame:
    """Squared error over stored values; its mean counts implicit zeros too."""
    sse = F.sum(F.pow((F.col("value") - F.col("quantized")).cast("double"), F.lit(2.0)))
    return quantized.agg(F.round(sse, 4).alias("sse"), F.round(sse / cells, 9).alias("mse"), F.round(F.sqrt(sse / cells), 9).alias("rmse"))


def rate(encoded: DataFrame, quantized: DataFrame, cells: int) -> DataFrame:
    """``distortion`` with the coded bits for each of the matrix's ``cells``."""
    bits = encoded.agg(F.round(8 * F.sum("bytes") / cells, 9).alias("bits_per_value"))
    return distortion(quantized, cells).join(bits)


def sweep(counts: list[int], selected: int) -> list[int]:
    """Each at least 1, in order, once, the selected one last if new."""
    return list(dict.fromkeys([max(1, c) for c in counts] + [max(1, selected)]))


def support_bound(rows: DataFrame, universe: int) -> DataFrame:
    """(row_id, nnz, bits): log2 of the ways to choose a row's columns."""
    lf = log2_factorials(rows.sparkSession, universe)
    pick = lambda c, name: lf.select(F.col("n").alias(c), F.col("lf").alias(name))
    x = rows.withColumn("rest", F.lit(universe) - F.col("nnz")).join(pick("nnz", "a"), "nnz", "left").join(pick("rest", "b"), "rest", "left")
    top = lf.where(F.col("n") == universe).select(F.col("lf").alias("t"))  # one row
    return x.join(F.broadcast(top)).select("row_id", "nnz", F.round(F.col("t") - F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 4).alias("bits"))


def report(encoded: DataFrame, coo: DataFrame) -> DataFrame:
    """One row: tiles, modes, bytes by category, index bits against the support bound and the zero-order entropy of index symbols, and all by entry."""
    sums = [F.sum(c).cast("long").alias(c) for c in (*CATEGORIES, "bytes", *MODES, "fallbacks")]
    many = (F.col("col_raw") > 0).cast("int") + (F.col("col_ref") > 0).cast("int") + (F.col("col_template") > 0).cast("int")
    kinds = [F.count_if(F.col(c) > 0).alias(f"tiles_with_{c}") for c in MODES[3:]] + [F.count_if((F.col(c) > 0) & (many == 1)).alias(f"tiles_only_{c}") for c in MODES[3:]] + [F.count_if(many > 1).alias("tiles_mixed")]
    split = [F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)).alias(f"{k}_{n}") for k in ("row", "column") for c, n in (("ops", "index_bytes"), ("bound_bits", "bound_bits"))]
    t = encoded.agg(F.count("*").alias("tiles"), F.count_if(F.col("kind") == "row").alias("row_tiles"), *sums, *kinds, *split, F.sum("bound_bits").alias("bound_bits"))
    entropy = matrix.entropy_bits(encoded.select(F.explode("symbols").alias("symbol", "c")).groupBy("symbol").agg(F.sum("c").alias("n")))
    e = entropy.select(F.coalesce("bits", F.lit(0.0)).alias("entropy_bits"), F.coalesce("total", F.lit(0)).alias("index_symbols"), F.col("symbols").alias("distinct_symbols"))
    r = t.join(e).join(coo.agg(F.count("*").alias("nnz"))).withColumn("index_bits", 8 * F.col("ops"))
    over = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return r.withColumns({
        "bits_per_entry": over(8 * F.col("bytes"), F.col("nnz")), "index_bits_per_entry": over(F.col("index_bits"), F.col("nnz")), "index_bits_per_symbol": over(F.col("index_bits"), F.col("index_symbols")),
        "index_over_bound": over(F.col("index_bits"), F.col("bound_bits")), "index_over_entropy": over(F.col("index_bits"), F.col("entropy_bits"))})


def stats_label(path: str) -> str:
    """The folder two above a file, else the file's name."""
    parts = [p for p in path.split("/") if p]
    return parts[-3] if len(parts) > 2 else parts[-1] if parts else path


def build_stats(encoded: DataFrame, coo: DataFrame, cells: int, label: str, cluster_method: str = "equal_cuts", order_method: str = "none", matrix_bytes: int = 0, position_bytes: int = 0, stored_bytes: int = 0) -> DataFrame:
    """The 20 columns of a build's statistics. ``cells``: rows times columns; ``stored_bytes``: the payload as compressed."""
    r = report(encoded, coo)
    total = matrix_bytes + position_bytes
    return r.select(
        F.lit(label).alias("stats_csv"), F.lit(cluster_method).alias("cell_cluster_method"), F.lit(order_method).alias("gene_reorder_method"), F.lit(matrix_bytes).cast("long").alias("input_matrix_bytes"),
        F.lit(position_bytes).cast("long").alias("input_positions_bytes"), F.lit(total).cast("long").alias("input_bytes_sum"), F.col("bytes").alias("mst_uncompressed_bytes"), F.lit(stored_bytes).cast("long").alias("gzip_actual_bytes"),
        F.lit(stored_bytes / total if total else 0.0).alias("gzip_to_input_sum_ratio"), F.lit(cells).cast("long").alias("rows_times_cols"), "nnz", F.lit(8.0 * stored_bytes / cells if cells else 0.0).alias("actual_rate_bits_per_value"),
        F.col("topology").alias("topology_parent_offset_bytes"), (F.col("roots") + F.col("keys") + F.col("ops") + F.col("vals")).alias("values_root_plus_ops_bytes"), F.col("meta").alias("metadata_num_genes_bytes"), F.lit(0).cast("long").alias("column_order_bytes"),
        F.col("keys").alias("values_root_indices_bytes"), F.col("roots").alias("values_root_vals_bytes"), F.col("ops").alias("values_op_indices_bytes"), F.col("vals").alias("values_op_vals_bytes"))


def weighed_pairs(placed: DataFrame, coo: DataFrame, w: int, metric: str = "l0") -> DataFrame:
    """Windowed pairs with the metric, or ``encoding`` cost, as ``weight``."""
    pairs = graph.window_pairs(placed, w)
    if metric == "encoding":
        return edits.encoding_weights(pairs, coo)
    inside = coo.join(placed.select("row_id", "cluster_id"), "row_id")
    return metrics.pair_metrics(pairs, inside, ["row_id"], ["cluster_id"]).select("cluster_id", "a", "b", F.col(metric).alias("weight"))


def column_references(blocks: DataFrame, coo: DataFrame, w: int, metric: str = "l0") -> DataFrame:
    """(col_id, parent, offset): each column's parent in the spanning tree of its block; roots have none. ``blocks``: (col_id, block_id)."""
    turned = matrix.transpose(coo)
    placed = order.positions_in(blocks.select(F.col("col_id").alias("row_id"), F.col("block_id").alias("cluster_id")))
    found = graph.parents(graph.spanning_tree(weighed_pairs(placed, turned, w, metric)), placed).where("row_id <> parent")
    at = placed.select("row_id", "pos")
    both = found.join(at, "row_id").join(at.select(F.col("row_id").alias("parent"), F.col("pos").alias("there")), "parent")
    return both.select(F.col("row_id").alias("col_id"), "parent", (F.col("there") - F.col("pos")).alias("offset"))


def parent_modes(coo: DataFrame, rows: DataFrame, parent: DataFrame) -> DataFrame:
    e = parent.select("parent", F.col("row_id").alias("child")).where("parent < child")
    return edits.row_modes(edits.delta_cost(e, edits.row_edits(e, coo)), edits.full_cost(rows, coo), coo.groupBy("row_id").agg(F.count("*").alias("nnz")))
