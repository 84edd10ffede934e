"""Density topics: fewer dimensions by principal components, then dense grid cells that touch each other.

A stand-in for manifold reduction and hierarchical density clustering, which
Spark lacks: cells are counted, so no pairs of points are formed and a dense
region of any size costs a row per cell.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import components


def reduced(rows: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """key, point: the vectors at length one, on their first ``k`` principal components; null vectors are left out."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from millrace.operators.vectors import unit

    held = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(unit(F.col(vector))).alias("__v"))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(held).transform(held).select(key, vector_to_array("__p").alias("point"))


def _named(cell: Column) -> Column:
    return F.array_join(cell, ",")


def clusters(points: DataFrame, key: str, point: str, side: float, least: int = 5, least_size: int = 15) -> DataFrame:
    """key, topic: number of the cluster, largest first, or -1.

    Cells of edge ``side`` with ``least`` points or more are dense; dense cells
    that touch, corners included, are one cluster. Points of other cells join
    the fullest dense cell that touches theirs (ties: the first by name).
    Clusters of fewer than ``least_size`` points, and all other points, are -1.
    """
    placed = points.select(key, F.transform(point, lambda x: F.floor(x / side).cast("long")).alias("cell"))
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
    dense = counts.where(F.col("n") >= least).select("cell", _named(F.col("cell")).alias("name"), "n")
    first = points.select(F.size(point)).first()
    if first is None:
        return points.select(key, F.lit(-1).alias("topic"))
    moves = list(product((-1, 0, 1), repeat=first[0]))

    def near(steps: list) -> Column:
        held = F.array(*[F.array(*[F.lit(x).cast("long") for x in m]) for m in steps])
        return F.explode(F.transform(held, lambda m: _named(F.zip_with("cell", m, lambda a, b: a + b))))

    half = [m for m in moves if m >= tuple(0 for _ in m)]
    links = dense.select(F.col("name").alias("a"), near(half).alias("b")).join(dense.select(F.col("name").alias("b")), "b")
    roots = components(links.select("a", "b"))
    of = dense.join(roots.withColumnRenamed("node", "name"), "name").select("name", "n", "root")
    touching = counts.where(F.col("n") < least).select(_named(F.col("cell")).alias("own"), near(moves).alias("name")).join(of, "name")
    best = touching.groupBy("own").agg(F.min_by("root", F.struct(-F.col("n"), "name")).alias("root"))
    cells = of.select(F.col("name").alias("own"), "root").unionByName(best)
    marked = placed.select(key, _named(F.col("cell")).alias("own")).join(cells, "own", "left")
    sizes = marked.where("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    numbers = sizes.select("root", (F.row_number().over(Window.orderBy(F.desc("size"), "root")) - 1).alias("topic"))  # a row per cluster
    return marked.join(numbers, "root", "left").select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))


def sizes(labelled: DataFrame) -> DataFrame:
    """topic, n; outliers are topic -1."""
    return labelled.groupBy("topic").agg(F.count("*").alias("n")).orderBy("topic")
