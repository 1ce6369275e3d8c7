"""Connected components by min-label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b), label the least node reachable. Each round's labels are written, so that
    lineage stays short, and the round before is dropped; it ends when none changes, which it always comes to, as labels only fall."""
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(spark, both, f"{name}-edges")
    held = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}-0")
    for i in itertools.count(1):
        labels = held.select("node", "label")
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = written(spark, step, f"{name}-{i}")
        drop(held)
        if not step.where("was <> label").limit(1).count():
            drop(both)
            return step.select("node", "label")
        held = step
    raise AssertionError
