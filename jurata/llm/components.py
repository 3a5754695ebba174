"""Connected components of a distributed edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so a chain of n
    edges needs about log n rounds. Rounds are written to the shared folder. Null ends and loops are left out; no
    edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = step.join(label.select(F.col("node").alias("low"), F.col("label").alias("far")), "low")
        out = written(jump.select("node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("was")).alias("moved")), "label")
        if out.where("moved").isEmpty():
            return out.select("node", F.col("label").alias("component"))
        label = out.select("node", "label")
