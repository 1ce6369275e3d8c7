"""Edits between rows, what they cost to write, and the choice of the cheapest form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import projection_weight


def row_edits(edges: DataFrame, coo: DataFrame) -> DataFrame:
    """(parent, child, col_id, op, value): what turns the parent's entries into the child's. ``edges``: (parent, child)."""
    p = edges.join(coo.withColumnRenamed("row_id", "parent"), "parent").select("parent", "child", "col_id", F.col("value").alias("pv"))
    c = edges.join(coo.withColumnRenamed("row_id", "child"), "child").select("parent", "child", "col_id", F.col("value").alias("cv"))
    both = p.join(c, ["parent", "child", "col_id"], "full")
    op = F.when(F.col("cv").isNull(), "remove").when(F.col("pv").isNull(), "add").when(F.col("pv") != F.col("cv"), "update")
    return both.select("parent", "child", "col_id", op.alias("op"), F.col("cv").alias("value")).where("op IS NOT NULL")


def apply_edits(edges: DataFrame, coo: DataFrame, edits: DataFrame) -> DataFrame:
    """The children's entries (child, col_id, value), from the parents' and the edits; zeros go."""
    base = edges.join(coo.withColumnRenamed("row_id", "parent"), "parent").select("parent", "child", "col_id", "value")
    e = edits.select("parent", "child", "col_id", "op", F.col("value").alias("nv"))
    return base.join(e, ["parent", "child", "col_id"], "full").where("op IS NULL OR op <> 'remove'").select("child", "col_id", F.coalesce("nv", "value").alias("value")).where("value > 0")


def apply_set_edits(edges: DataFrame, coo: DataFrame, edits: DataFrame) -> DataFrame:
    """The children's members (child, col_id): the parents' without those removed, and those added."""
    base = edges.join(coo.withColumnRenamed("row_id", "parent"), "parent").select("parent", "child", "col_id")
    e = edits.where("op <> 'update'").select("parent", "child", "col_id", "op")
    return base.join(e, ["parent", "child", "col_id"], "full").where("op IS NULL OR op = 'add'").select("child", "col_id")


def symbol_cost(v: Column, codec: str = "arithmetic") -> Column:
    """Bytes of a symbol: 1 for 0, else a sixth of its bits; or 1 to 4 by magnitude."""
    if codec == "stream-vbyte":
        return F.when(v <= 0xFF, 1).when(v <= 0xFFFF, 2).when(v <= 0xFFFFFF, 3).otherwise(4)
    return F.when(v == 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 6).cast("int")))


def zigzag(d: Column) -> Column:
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftright(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def gaps(df: DataFrame, keys: list[str], col: str = "col_id") -> DataFrame:
    """``gap``: the first id of each list, then differences."""
    w = Window.partitionBy(*keys).orderBy(col)
    return df.withColumn("gap", F.col(col) - F.coalesce(F.lag(col).over(w), F.lit(0)))


def list_cost(df: DataFrame, keys: list[str], values: bool, name: str = "cost", codec: str = "arithmetic") -> DataFrame:
    cost = symbol_cost(F.col("gap"), codec) + (symbol_cost(F.col("value"), codec) if values else F.lit(0))
    return gaps(df, keys).groupBy(*keys).agg(F.sum(cost).cast("long").alias(name))


def full_cost(rows: DataFrame, coo: DataFrame, codec: str = "arithmetic") -> DataFrame:
    """(row_id, full_cost): entries plus 2; an empty row costs 2."""
    return rows.select("row_id").join(list_cost(coo, ["row_id"], True, "_c", codec), "row_id", "left").select("row_id", (F.coalesce("_c", F.lit(0)) + 2).cast("long").alias("full_cost"))


def delta_cost(edges: DataFrame, edits: DataFrame, codec: str = "arithmetic") -> DataFrame:
    """(parent, child, edits, delta_cost): the three lists plus 4."""
    e = gaps(edits, ["parent", "child", "op"])
    cost = symbol_cost(F.col("gap"), codec) + F.when(F.col("op") == "remove", 0).otherwise(symbol_cost(F.col("value"), codec))
    s = e.groupBy("parent", "child").agg(F.count("*").alias("n"), F.sum(cost).alias("c"))
    return edges.join(s, ["parent", "child"], "left").select("parent", "child", F.coalesce("n", F.lit(0)).cast("long").alias("edits"), (F.coalesce("c", F.lit(0)) + 4).cast("long").alias("delta_cost"))


def falls_back(edits: Column, nnz: Column, ratio: float | None) -> Column:
    """Whether there are more edits than ``ratio`` times the child's entries (any, if it has none); never without a ratio."""
    return F.lit(False) if ratio is None else F.when(nnz == 0, edits > 0).otherwise(edits > nnz * F.lit(ratio))


def encoding_weights(pairs: DataFrame, coo: DataFrame, ratio: float | None = 1.0, codec: str = "arithmetic") -> DataFrame:
    """``pairs`` (cluster_id, a, b) with ``weight``: what the cheaper direction costs, as edits or as a whole row. One join finds the
    differences; removed and added entries change places in the other direction, so their gaps are the same."""
    side = lambda n: pairs.join(coo.select(F.col("row_id").alias(n), "col_id", F.col("value").alias(f"v{n}")), n)
    both = side("a").join(side("b"), ["cluster_id", "a", "b", "col_id"], "full")
    op = F.when(F.col("vb").isNull(), "a").when(F.col("va").isNull(), "b").when(F.col("va") != F.col("vb"), "u")
    e = gaps(both.withColumn("op", op).where("op IS NOT NULL"), ["cluster_id", "a", "b", "op"])
    gap = symbol_cost(F.col("gap"), codec)
    to = lambda n, gone: gap + F.when(F.col("op") == gone, 0).otherwise(symbol_cost(F.col(f"v{n}"), codec))
    s = e.groupBy("cluster_id", "a", "b").agg(F.count("*").alias("n"), F.sum(to("b", "a")).alias("ab"), F.sum(to("a", "b")).alias("ba"))
    own = list_cost(coo, ["row_id"], True, "full", codec).join(coo.groupBy("row_id").agg(F.count("*").alias("nnz")), "row_id")
    has = lambda n: own.select(F.col("row_id").alias(n), F.col("full").alias(f"f{n}"), F.col("nnz").alias(f"n{n}"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = lambda c, n: F.when(falls_back(z("n"), z(f"n{n}"), ratio), z(f"f{n}") + 2).otherwise(z(c) + 4)
    full = pairs.join(s, ["cluster_id", "a", "b"], "left").join(has("a"), "a", "left").join(has("b"), "b", "left")
    return full.select("cluster_id", "a", "b", F.least(cost("ab", "b"), cost("ba", "a")).cast("long").alias("weight"))


def row_modes(delta: DataFrame, full: DataFrame, nnz: DataFrame, ratio: float | None = 1.0) -> DataFrame:
    """mode 0 (edits of an earlier parent) unless there are more edits than ``ratio`` times the child's entries, else 1 (whole)."""
    rows = full.join(nnz, "row_id", "left").join(delta.withColumnRenamed("child", "row_id"), "row_id", "left")
    n = F.coalesce("nnz", F.lit(0))
    mode = F.when(F.col("parent").isNull() | falls_back(F.col("edits"), n, ratio), 1).otherwise(0).cast("long")
    return rows.select("row_id", mode.alias("mode")).join(rows, "row_id").select("row_id", "mode", F.when(F.col("mode") == 0, F.col("delta_cost")).otherwise(F.col("full_cost")).alias("cost"))


def column_modes(coo: DataFrame, refs: DataFrame, codec: str = "arithmetic") -> DataFrame:
    """(col_id, mode, cost): 1 (a reference: its zigzag distance, removed and added rows, plus 2) if that is strictly cheaper than 0, the
    postings themselves. ``refs``: (col_id, parent, offset), offset the parent's place minus the column's own."""
    rows = coo.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), F.lit(1).alias("value"))
    pairs = refs.select("parent", F.col("col_id").alias("child"))
    lists = list_cost(row_edits(pairs, rows), ["parent", "child", "op"], False, "c", codec).groupBy("child").agg(F.sum("c").alias("c"))
    ref = refs.join(lists, refs.col_id == lists.child, "left").select("col_id", (symbol_cost(zigzag(F.col("offset")), codec) + F.coalesce("c", F.lit(0)) + 2).alias("ref"))
    raw = list_cost(rows, ["row_id"], False, "raw", codec).withColumnRenamed("row_id", "col_id")
    cheaper = F.coalesce(F.col("ref") < F.col("raw"), F.lit(False))
    return raw.join(ref, "col_id", "left").select("col_id", cheaper.cast("long").alias("mode"), F.when(cheaper, F.col("ref")).otherwise(F.col("raw")).cast("long").alias("cost"))


def dyadic_positions(n: int, most: int, depth: int = 20) -> list[int]:
    """Up to ``most`` places of n sorted items: halves, quarters, eighths..., then the rest from the start."""
    out: list[int] = []
    for d in range(1, depth + 1):
        for i in range(1, 2**d, 2):
            if len(out) >= min(most, n):
                return out
            at = int((n - 1) * i / 2**d + 0.5)
            if at not in out:
                out.append(at)
        if 2**d > 4 * n:
            break
    return (out + [i for i in range(n) if i not in out])[: min(most, n)]


def template_candidates(coo: DataFrame, group: str, item: str, member: str, seeds: tuple[int, int], most: int, weighted: bool) -> DataFrame:
    """(group, template_id, item): items of each group sorted by two projections of their members, taken at dyadic places."""
    w = F.log1p("value") if weighted else F.lit(1.0)
    scored = coo.select(group, item, w.alias("w"), *[projection_weight(F.col(member), s).alias(f"p{i}") for i, s in enumerate(seeds)])
    s = scored.groupBy(group, item).agg(*[F.round(F.sum(F.col("w") * F.col(f"p{i}")), 6).alias(f"s{i}") for i in range(2)], F.count("*").alias("n"))
    by = Window.partitionBy(group)
    ranked = s.withColumn("at", F.row_number().over(by.orderBy("s0", "s1", "n", item)) - 1).withColumn("size", F.count("*").over(by))
    sizes = [r[0] for r in ranked.select("size").distinct().collect()]  # one number a group size
    picks = [(n, at, i) for n in sizes for i, at in enumerate(dyadic_positions(n, most))]
    return ranked.join(F.broadcast(coo.sparkSession.createDataFrame(picks, "size long, at int, template_id long")), ["size", "at"]).select(group, "template_id", item)


def adaptive_templates(costs: DataFrame, base: DataFrame, dictionary: DataFrame, group: str) -> DataFrame:
    """(group, k, total): the number of templates of least total cost, none included, fewer on ties. ``costs``: (group, item,
    template_id, cost), ``base``: (group, item, cost) without templates, ``dictionary``: (group, template_id, cost)."""
    w = Window.partitionBy(group, "item").orderBy("template_id").rowsBetween(Window.unboundedPreceding, 0)
    best = costs.join(base.select(group, "item", F.col("cost").alias("own")), [group, "item"]).withColumn("m", F.least(F.min("cost").over(w), F.col("own")))
    per_k = best.groupBy(group, (F.col("template_id") + 1).alias("k")).agg(F.sum("m").alias("items"))
    d = dictionary.select(group, (F.col("template_id") + 1).alias("k"), F.sum("cost").over(Window.partitionBy(group).orderBy("template_id")).alias("dict"))
    none = base.groupBy(group).agg(F.lit(0).cast("long").alias("k"), F.sum("cost").alias("total"))
    total = per_k.join(d, [group, "k"]).select(group, F.col("k").cast("long").alias("k"), (F.col("items") + F.col("dict")).alias("total")).unionByName(none)
    r = Window.partitionBy(group).orderBy("total", "k")
    return total.withColumn("_r", F.row_number().over(r)).where("_r = 1").select(group, "k", F.col("total").cast("long").alias("total"))


def row_template_costs(templates: DataFrame, rows: DataFrame, coo: DataFrame, group: str, codec: str = "arithmetic") -> tuple[DataFrame, DataFrame]:
    """What each row costs as edits of each template of its group (group, item, template_id, cost), and each template's own cost (group, template_id,
    cost). ``templates``: (group, template_id, row_id), ``rows``: (group, row_id)."""
    words = templates.select(group, "template_id", F.col("row_id").alias("parent"))
    edges = words.join(rows.select(group, F.col("row_id").alias("child")), group)
    pairs = edges.select("parent", "child").distinct()
    delta = delta_cost(pairs, row_edits(pairs, coo), codec)
    cost = (F.col("delta_cost") + symbol_cost(F.col("template_id"), codec)).cast("long")
    costs = edges.join(delta, ["parent", "child"]).select(group, F.col("child").alias("item"), "template_id", cost.alias("cost"))
    own = words.join(list_cost(coo, ["row_id"], True, "_c", codec).withColumnRenamed("row_id", "parent"), "parent")
    return costs, own.select(group, "template_id", (F.col("_c") + 1).alias("cost"))


def template_modes(base: DataFrame, costs: DataFrame, dictionary: DataFrame, group: str) -> DataFrame:
    """(group, item, mode, template_id, cost): mode 2 where one of the adaptively many templates is strictly cheaper than ``base``
    (group, item, mode, cost), the first of the cheapest."""
    k = adaptive_templates(costs, base, dictionary, group).select(group, "k")
    best = costs.join(k, group).where("template_id < k").groupBy(group, "item").agg(F.min(F.struct(F.col("cost").alias("c"), F.col("template_id").alias("t"))).alias("b"))
    x = base.join(best, [group, "item"], "left")
    better = F.coalesce(F.col("b.c") < F.col("cost"), F.lit(False))
    return x.select(group, "item", F.when(better, 2).otherwise(F.col("mode")).cast("long").alias("mode"), F.when(better, F.col("b.t")).cast("long").alias("template_id"), F.when(better, F.col("b.c")).otherwise(F.col("cost")).cast("long").alias("cost"))
