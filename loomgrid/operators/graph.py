"""Windowed neighbour graphs inside clusters, their spanning trees and parents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_pairs(placed: DataFrame, w: int) -> DataFrame:
    """(cluster_id, a, b): rows at most w places apart, a first. Offsets are spelled out, so this is an equi-join."""
    left = placed.select("cluster_id", F.col("row_id").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(1, w))), lambda o: F.col("pos") + o)).alias("pos"))
    return left.join(placed.select("cluster_id", "pos", F.col("row_id").alias("b")), ["cluster_id", "pos"]).select("cluster_id", "a", "b")


def cheapest_parent(weighed: DataFrame) -> DataFrame:
    """The earlier neighbour of least weight of each row; ties by id."""
    w = Window.partitionBy("cluster_id", "b").orderBy("weight", "a")
    return weighed.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cluster_id", F.col("b").alias("row_id"), F.col("a").alias("parent"), "weight")


def spanning_tree(weighed: DataFrame, cut: float = 0.0) -> DataFrame:
    """Minimum spanning forest of each cluster (cluster_id, a, b, weight); ties by (weight, a, b). With ``cut``, edges above
    ceil(upper median * cut) go. ``root`` is the least row of each component."""

    def kruskal(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["weight", "a", "b"])
        up = {x: x for x in (*df.a, *df.b)}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        keep = []
        for i, a, b in zip(df.index, df.a, df.b, strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                keep.append(i)
        return df.loc[keep, ["cluster_id", "a", "b", "weight"]]

    tree = weighed.select("cluster_id", "a", "b", "weight").groupBy("cluster_id").applyInPandas(kruskal, "cluster_id long, a long, b long, weight long")
    if cut <= 0:
        return tree
    by = Window.partitionBy("cluster_id")
    ranked = tree.withColumn("_r", F.row_number().over(by.orderBy("weight", "a", "b"))).withColumn("_n", F.count("*").over(by))
    median = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("weight"))).over(by)
    return ranked.withColumn("_m", F.ceil(median * cut)).where("weight <= _m").drop("_r", "_n", "_m")


def parents(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """(cluster_id, row_id, parent): each component rooted at its least row, whose parent is itself."""

    def walk(key, edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {r: [] for r in sorted(rows.row_id)}
        for a, b in zip(edges.a, edges.b, strict=True):
            near[a].append(b)
            near[b].append(a)
        parent: dict = {}
        for root in near:
            stack = [] if root in parent else [(root, root)]
            while stack:
                x, p = stack.pop()
                if x not in parent:
                    parent[x] = p
                    stack += [(y, x) for y in sorted(near[x], reverse=True) if y not in parent]
        return pd.DataFrame({"cluster_id": key[0], "row_id": list(parent), "parent": list(parent.values())})

    return tree.groupBy("cluster_id").cogroup(rows.select("cluster_id", "row_id").groupBy("cluster_id")).applyInPandas(walk, "cluster_id long, row_id long, parent long")


def parent_offsets(found: DataFrame, placed: DataFrame) -> DataFrame:
    """(cluster_id, row_id, offset): how many places before a row its parent is; 0 for roots and where the parent comes later."""
    at = placed.select("row_id", "pos")
    both = found.join(at, "row_id").join(at.select(F.col("row_id").alias("parent"), F.col("pos").alias("there")), "parent")
    return both.select("cluster_id", "row_id", F.greatest(F.col("pos") - F.col("there"), F.lit(0)).cast("long").alias("offset"))
