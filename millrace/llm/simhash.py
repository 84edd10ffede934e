"""SimHash near-duplicates: segment popcounts as a grid, then exact verification.

A fingerprint's 64 bits fall into 16 segments; the vector of their bit counts
has a Manhattan distance that never exceeds the Hamming distance. Two vectors
within distance 2 have a lattice point within 1 of both, so each distinct
fingerprint enters the 33 grid cells of its ball of radius 1 and every linked
pair meets in a cell. Cells with few members verify their pairs; in the others
each member emits its 65 variants of at most one flipped bit, since two
fingerprints within 2 bits share one. That is exact as well, and linear.

Copies collapse to one fingerprint before anything is joined.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import components

from .common import materialise, small_slices, texts_of, unused

SEED, SHINGLE, BITS = 42, 3, 2
SEGMENTS, WIDTH = 16, 4
#: Members up to which a cell compares its pairs.
SMALL_CELL = 24


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text, zero if it has no word."""
    import xxhash

    w = text.lower().split()  # bytes: ASCII only, in case and in white space
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(*[w[i:] for i in range(SHINGLE)]))
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    n, ones = len(h), np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(h[i : i + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row, and its key in column ``row`` if one is named."""
    keys = ["doc_id", *([row] if row else [])]

    def run(batches):
        for batch in batches:
            for part in small_slices(batch, "text"):
                fps = [fingerprint(t) for t in texts_of(part, "text")]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), pa.array(fps, pa.int64())], [*keys, "fp"])

    read = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "fp"]))


def _cells(fp: Column) -> Column:
    """Numbers of the grid cells within Manhattan distance 1 of the segment popcounts; five-bit digits, hashed."""
    counts = [
        F.bit_count(F.shiftrightunsigned(fp, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1))).cast("int") for s in range(SEGMENTS)
    ]
    # digits base 7, shifted by one so that -1 and WIDTH + 1 have a digit; 7**16 stays under 2**63
    code = F.lit(0).cast("long")
    for s, c in enumerate(counts):
        code = code + (c + 1).cast("long") * F.lit(7**s)
    moves = F.array(F.lit(0).cast("long"), *[F.lit(sign * 7**s).cast("long") for s in range(SEGMENTS) for sign in (1, -1)])
    return F.explode(F.transform(moves, lambda m: code + m))


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def links(fps: DataFrame, small: int = SMALL_CELL) -> DataFrame:
    """a, b: linked pairs of different fingerprints, enough of them to connect every linked pair."""
    # the fingerprints lie in a few small files; each becomes 33 rows
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = fps.select("fp", _cells(F.col("fp")).alias("cell"))
    # Spark sizes what follows an explode by the files before it, so no side of these joins may be chosen for a broadcast by size
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(cells.join(counts.hint("merge"), "cell"))
    few = (
        met.where(F.col("n") <= small)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select("fps", F.explode("fps").alias("a"))
        .select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & _close(F.col("a"), b))).alias("b"))
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    many = (
        met.where(F.col("n") > small)
        .select("fp").distinct()
        .select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    )
    first = many.groupBy("variant").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    # a star per variant: members are within 2 bits of each other by way of it
    star = many.join(first.hint("merge"), "variant").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return few.unionByName(star).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Repeated rows stay rows of the same component. A component of null
    doc_ids only has a null id. Extra columns are ignored; an empty table gives
    no rows.
    """
    held = materialise(fingerprints(docs))
    classes = materialise(held.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp")))
    named = classes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(ids.hint("merge"), "root").select("fp", "component_id"))
    return held.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its columns: that of the smallest doc_id (null last), then fingerprint.

    Rows are told apart by a key of their own, so rows of null or repeated
    doc_ids in other components stay.
    """
    key = unused(docs)
    rows = materialise(docs.withColumn(key, F.monotonically_increasing_id()))
    held = materialise(fingerprints(rows, key))
    roots = components(links(materialise(held.select("fp").distinct()))).withColumnRenamed("node", "fp")
    first = held.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", key)).alias("first"))
    keep = first.join(roots.hint("merge"), "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first")).select(F.col(f"first.{key}").alias(key))
    # the texts are shuffled once and not sorted, at every size
    return rows.join(keep.hint("shuffle_hash"), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
