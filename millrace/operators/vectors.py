"""Vector operators: cosine, best topic, hybrid assignment, centroids, medoids, agglomerative clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Topics that an assignment or a clustering takes; both hold them in memory.
MOST_TOPICS = 2000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def assign_best(rows: DataFrame, vector: str, topics: list[tuple[str, list[float]]], label: str = "topic", score: str = "score") -> DataFrame:
    """All columns with the most similar topic (the first on ties) and its cosine; no topics: nulls."""
    if len(topics) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    if not topics:
        return rows.withColumn(label, F.lit(None).cast("string")).withColumn(score, F.lit(None).cast("double"))
    spark = rows.sparkSession
    held = [(i, str(t), [float(x) for x in v]) for i, (t, v) in enumerate(topics)]
    one = spark.createDataFrame([(held,)], "__topics array<struct<i:int,t:string,v:array<double>>>")  # one row, bounded
    best = F.array_max(F.transform("__topics", lambda t: F.struct(F.round(cosine(F.col(vector), t["v"]), 12).alias("s"), (-t["i"]).alias("i"), t["t"].alias("t"))))
    return rows.join(F.broadcast(one), F.lit(True)).withColumn("__best", best).withColumn(label, F.col("__best.t")).withColumn(score, F.col("__best.s")).drop("__topics", "__best")


def hybrid(embedded: Column, by_embedding: Column, counted: Column, by_terms: Column, least_embedding: float = 0.40, least_terms: float = 0.08) -> Column:
    """Struct assigned_topic, score, method: the embedding's topic if near enough, else that of the terms, else none."""
    def made(topic, score, method):
        return F.struct(topic.alias("assigned_topic"), F.bround(score, 3).alias("score"), F.lit(method).alias("method"))

    return F.when(embedded >= least_embedding, made(by_embedding, embedded, "embedding")).when(
        counted >= least_terms, made(by_terms, counted, "tfidf")
    ).otherwise(made(F.lit("No dominant need"), F.greatest(embedded, counted), "none"))


def _mean_units(rows: DataFrame, group: str, vector: Column) -> DataFrame:
    """group, mean: element-wise mean, summed in parts before the shuffle."""
    parts = rows.select(group, F.posexplode(vector).alias("p", "x")).groupBy(group, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("mean"))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, mean of its vectors."""
    return _mean_units(rows, group, F.col(vector))


def medoids(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, key, similarity: the member with the highest mean cosine to all members, itself included (ties: least key).

    The mean cosine to a group is the dot product with the mean of its unit
    vectors, so no pairs are formed.
    """
    scaled = rows.select(group, key, unit(F.col(vector)).alias("__u"))
    scored = scaled.join(_mean_units(scaled, group, F.col("__u")), group).select(group, key, F.round(dot(F.col("__u"), F.col("mean")), 9).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col(key)).alias("k")))
    return scored.groupBy(group).agg(best.alias("b")).select(group, (-F.col("b.k")).alias(key), F.col("b.similarity").alias("similarity"))


def agglomerative(vectors: list[list[float]], least_similarity: float = 0.5) -> list[int]:
    """Cluster numbers by complete linkage on cosine distance, merging while the distance is below 1 - similarity."""
    n = len(vectors)
    if n > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    if not n:
        return []
    v = np.array(vectors, float).reshape(n, -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    of = np.arange(n)
    while n > 1:
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        if not d[i, j] < 1 - least_similarity:
            break
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = d[j, :] = d[:, j] = np.inf
        of[of == j] = i
    return [int(x) for x in np.unique(of, return_inverse=True)[1]]


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
