"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of all nodes in ``edges`` (a, b), by least labels and pointer jumping.

    Nothing is broadcast: packed files are far smaller than their rows in the driver's memory.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    held = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        label = held.select("node", "root")
        near = both.join(label.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near.hint("merge"), label["node"] == near["a"]).select("node", F.least("root", "m").alias("up"), F.col("root").alias("old"))
        jump = label.select(F.col("node").alias("up"), F.col("root").alias("far"))
        new = materialise(step.join(jump.hint("merge"), "up", "left").select("node", F.least("up", "far").alias("root"), "old"))
        done = new.where("root <> old").limit(1).count() == 0
        discard(held)
        held = new
        if done:
            discard(both)
            return held.select("node", "root")
