"""Files of the funnel: review CSV, lexicons, category and summary sinks, feed pages."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources import feeds


def read_reviews(spark: SparkSession, path: str, schema: StructType | str | None = None, missing: str | list[str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes.

    Types are inferred unless given; ``overrides`` gives those of single
    columns. ``missing`` names the strings that are null in string columns.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is None:
        found = reader.option("inferSchema", True).csv(path).schema
        schema = ", ".join(f"`{f.name}` {(overrides or {}).get(f.name, f.dataType.simpleString())}" for f in found)
    rows = reader.schema(schema).csv(path)
    named = [missing] if isinstance(missing, str) else list(missing or [])
    if named:
        gone = lambda c: F.when(~F.col(f"`{c}`").isin(named), F.col(f"`{c}`")).alias(c)
        rows = rows.select(*[gone(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema])
    return rows


def logger(name: str, folder: str | None = None) -> logging.Logger:
    """A logger to the console and, if a folder is named, to <folder>/<name>.log; asking again adds no handler."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not log.handlers:
        made: list[logging.Handler] = [logging.StreamHandler()]
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            made.append(logging.FileHandler(Path(folder) / f"{name}.log", encoding="utf-8"))
        for h in made:
            h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            log.addHandler(h)
    return log


def read_config(path: str) -> dict:
    """A JSON object such as a lexicon; FileNotFoundError if there is none."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_csv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header; ``by`` names a column whose values become folders, such as category."""
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line."""
    rows.write.mode("overwrite").json(path)


def count_matches(spark: SparkSession, path: str, expected: int) -> bool:
    """Whether a written CSV reads back with as many rows."""
    return read_reviews(spark, path).count() == expected


def output_folder(path: str, root: str = "results/pipeline") -> str:
    """Folder of a run: the root and the input's stem."""
    return f"{root}/{Path(path).stem}"


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """Lines of a short report as text, in order."""
    spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def write_array(rows: DataFrame, path: str) -> None:
    """One JSON array of a bounded summary, indented, in a local file; use ``write_json`` for anything that grows."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    held = [json.loads(x) for x in rows.toJSON().collect()]
    Path(path).write_text(json.dumps(held, indent=4, ensure_ascii=False), encoding="utf-8")


def write_terms(table: DataFrame, chosen: DataFrame, name: str, folder: str) -> None:
    """<name>_tfidf, <name>_ratio and <name>_discriminant of ``terms.discriminative`` and ``terms.discriminants``, best inside score first."""
    first = table.orderBy(F.desc("score_in"), "term")
    write_csv(first.select(F.lit(name).alias("group"), F.col("term").alias("word"), F.col("score_in").alias("tfidf_category")), f"{folder}/{name}_tfidf")
    write_csv(first.select(F.col("term").alias("word"), F.col("score_in").alias("tfidf_category"), F.col("score_out").alias("tfidf_rest"), "ratio"), f"{folder}/{name}_ratio")
    write_csv(chosen.orderBy("rank").select(F.lit(name).alias("group"), F.col("term").alias("word")), f"{folder}/{name}_discriminant")


def feed_posts(pages: DataFrame, page: str = "page", post: str = feeds.POST) -> DataFrame:
    """Rows of the records in feed pages (JSON strings) as they are; pages that don't parse give none."""
    parsed = F.from_json(page, f"struct<records:array<{post}>,has_next_page:boolean>")
    return pages.select(F.explode_outer(parsed["records"]).alias("post")).where("post IS NOT NULL").select("post.*")


def feed_from(fetch, start: int = 1, most: int | None = None) -> list[str]:
    """``feeds.pages`` as a list, for short feeds."""
    return list(feeds.pages(fetch, start, most))
