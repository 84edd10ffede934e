"""Shared helpers of the corpus operators: reading, materialising, digests, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import discard, materialise  # noqa: F401  for the operators

#: ASCII white space, the only separators between words in these operators.
SPACES = r"[\x20\x09-\x0D]+"


def unused(df: DataFrame, name: str = "row") -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside one expression; it is evaluated once, and only when needed."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _bytes_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column as UTF-8 bytes; nothing is copied."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty."""
    return [x or b"" for x in _bytes_of(batch, name).to_pylist()]


def map_rows(docs: DataFrame, make: Callable[[str], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``docs`` through ``make(name)``, where ``name`` is that of the text's column in the batches.

    Columns go by plain names meanwhile, as Arrow maps can't take names with dots.
    """
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(make(f"c{at}"), plain.schema).toDF(*docs.columns)


def small_slices(batch: pa.RecordBatch, name: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes in column ``name`` (one row at least), so that memory doesn't follow the batch."""
    sizes = pc.fill_null(pc.binary_length(_bytes_of(batch, name)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
