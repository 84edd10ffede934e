"""The review funnel as one run: clean, translate, extract, chunk, classify, compare, export."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import english
from millrace.operators import chunks, models, reviews
from millrace.sources import files


def prepared(rows: DataFrame, key: str, text: str, translator: Callable[[], Callable[[str, str], str]] | None = None) -> DataFrame:
    """Different non-null texts with number words, cleaned characters, translated if there is a translator, and <text>_cleaned."""
    clean = reviews.distinct_texts(rows, key, text).withColumn(text, english.clean_review(F.col(text)))
    if translator is not None:
        clean = models.translate(clean, text, english.language(F.col(text)), translator, keep=("en",))
    return reviews.with_cleaned(clean, text)


@dataclass
class Results:
    """Frames of a run; all are lazy."""

    prepared: DataFrame
    chunks: DataFrame
    exported: DataFrame
    complements: DataFrame
    statistics: DataFrame


def run(
    rows: DataFrame, key: str, text: str, lexicon: dict, exclusions: dict, load: Callable, translator: Callable | None = None,
    length: int = 128, batch: int = 16, threshold: float = 0.5,
) -> Results:
    """The whole funnel over ``rows``.

    ``load()`` gives the classifier, ``translator()`` the translation. Keywords
    are matched against texts without stop words, as prepared by
    ``reviews.prepared_lexicon``; chunks and exports take them as they are.
    Both texts pass through the same expressions row by row, so nothing but the
    different texts and the complements' ids is shuffled.
    """
    clean = prepared(rows, key, text, translator)
    found = reviews.extract(clean, reviews.prepared_lexicon(lexicon), reviews.prepared_lexicon(exclusions), f"{text}_cleaned")
    cut = chunks.chunked(found, text, lexicon, exclusions, length, category="category")
    labels = [c for c, ks in lexicon.items() if ks]
    judged = models.classify(cut, "chunk", labels, load, batch, threshold, "bert_prediction")
    made = reviews.with_status(judged, "kw_category", "bert_prediction").select(
        F.col(key).alias("original_id"), F.col(text).alias("review"), F.col(f"{text}_cleaned").alias("review_cleaned"), "chunk", "keywords_found",
        "kw_category", "bert_prediction", "status",
    )
    exported = reviews.category_export(made, lexicon)
    return Results(clean, made, exported, reviews.category_complements(clean, exported, key, text, labels), reviews.histogram(made, "status"))


def write(results: Results, folder: str) -> dict[str, int]:
    """results.json, <category> and no_<category> folders of CSV under ``folder``; returns the status counts.

    The classified chunks are written first and read back, so that the model
    runs once.
    """
    spark = results.chunks.sparkSession
    results.chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    made = spark.read.parquet(f"{folder}/chunks")
    files.write_json(made, f"{folder}/results.json")
    return {r["status"]: r["n"] for r in reviews.histogram(made, "status").collect()}


def main(arguments: list[str] | None = None) -> None:
    """Command line: ``python -m millrace.operators.funnel --input reviews.csv --model package.module:load``."""
    p = argparse.ArgumentParser(description="The review funnel from a CSV to results by category")
    p.add_argument("--input", "-i", required=True)
    p.add_argument("--column", "-c", default="review")
    p.add_argument("--id_col", default="id")
    p.add_argument("--categories", required=True)
    p.add_argument("--exclusions", required=True)
    p.add_argument("--model", required=True, help="module:function that returns the classifier")
    p.add_argument("--translator", help="module:function that returns the translation")
    p.add_argument("--output", default="results/pipeline")
    p.add_argument("--window", type=int, default=128)
    p.add_argument("--batch_size", type=int, default=16)
    p.add_argument("--threshold", type=float, default=0.5)
    a = p.parse_args(arguments)

    def named(path: str) -> Callable:
        module, _, name = path.partition(":")
        return getattr(importlib.import_module(module), name)

    log = files.logger("funnel")
    spark = SparkSession.builder.getOrCreate()
    folder = files.output_folder(a.input, a.output)
    rows = files.read_reviews(spark, a.input)
    log.info("rows: %s", reviews.counters(rows, a.column).first().asDict())
    lexicon, exclusions = files.read_config(a.categories), files.read_config(a.exclusions)
    results = run(rows, a.id_col, a.column, lexicon, exclusions, named(a.model), named(a.translator) if a.translator else None, a.window, a.batch_size, a.threshold)
    log.info("status: %s", write(results, folder))
    made = spark.read.parquet(f"{folder}/chunks")
    exported = reviews.category_export(made, lexicon)
    files.write_csv(exported, f"{folder}/categories", by="category")
    labels = [c for c, ks in lexicon.items() if ks]
    files.write_csv(reviews.category_complements(results.prepared, exported, a.id_col, a.column, labels).withColumn("category", F.concat(F.lit("no_"), "category")), f"{folder}/complements", by="category")
    log.info("written to %s", folder)


if __name__ == "__main__":
    main()
