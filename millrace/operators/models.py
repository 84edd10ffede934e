"""Pluggable models over batches of rows: multi-label inference, translation, need extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(
    rows: DataFrame, text: str, labels: list[str], load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16, threshold: float = 0.5,
    column: str = "prediction",
) -> DataFrame:
    """All columns with ``column``, a struct of yes or no per label.

    ``load()`` runs once per worker and returns texts -> logits in the order of
    ``labels``; a label is yes if its sigmoid reaches ``threshold``.
    """
    logits = F.pandas_udf(_batched(load, batch), "array<double>")
    yes = lambda i: F.when(1 / (1 + F.exp(-F.col("__z")[i])) >= threshold, "yes").otherwise("no")
    return rows.withColumn("__z", logits(F.coalesce(F.col(text), F.lit("")))).withColumn(column, F.struct(*[yes(i).alias(k) for i, k in enumerate(labels)])).drop("__z")


def _batched(load, batch):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            held = texts.tolist()
            out = [list(map(float, z)) for i in range(0, len(held), batch) for z in model(held[i : i + batch])]
            yield pd.Series(out, dtype=object)

    return run


def translate(rows: DataFrame, text: str, language: Column, load: Callable[[], Callable[[str, str], str]], keep: tuple[str, ...] = ("en", "unknown"), threads: int = 1) -> DataFrame:
    """All columns with language; texts of languages not in ``keep`` go through ``load()``'s (text, language) -> text, where it fails they stay.

    Blank and null texts stay. ``threads`` calls of a partition wait at once,
    for models behind a network. The rows pass through an operator of their
    own, so that no filter on the result moves into it.
    """
    marked = rows.withColumn("language", language)
    at, kind = marked.columns.index(text), marked.columns.index("language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()

        def one(pair):
            try:
                return model(*pair)
            except Exception:  # a failed translation leaves the text, by definition
                return pair[0]

        with ThreadPoolExecutor(max(threads, 1)) as pool:
            for batch in batches:
                texts, kinds = batch.column(at).to_pylist(), batch.column(kind).to_pylist()
                other = [i for i, (t, k) in enumerate(zip(texts, kinds)) if t is not None and t.strip() and k not in keep]
                pairs = [(texts[i], kinds[i]) for i in other]
                for i, new in zip(other, pool.map(one, pairs) if threads > 1 else map(one, pairs)):
                    texts[i] = new
                columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return marked.mapInArrow(run, marked.schema)


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds batch: number of the run of ``size`` rows in the group."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size))


def answer_topics(answer: Column) -> Column:
    """Topics of a model's answer: the outermost braces as JSON; strings stay, objects become 'topic : justification', all else is dropped."""
    block = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    items = F.from_json(F.get_json_object(block, "$.topics"), "array<string>")
    topic, why = (lambda x: F.get_json_object(x, "$.topic")), (lambda x: F.get_json_object(x, "$.justification"))
    named = F.transform(items, lambda x: F.when(x.startswith("{"), F.when(topic(x).isNotNull(), F.concat_ws(" : ", topic(x), F.coalesce(why(x), F.lit(""))))).when(~x.startswith("["), x))
    return F.coalesce(F.filter(named, lambda x: x.isNotNull()), F.array().cast("array<string>"))
