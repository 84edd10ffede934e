"""Operators of the review funnel: cleaning, keyword extraction, status, export by category, complement, term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import english
from millrace.functions.text import keyword_pattern

AGREE, DISPUTED, UNKNOWN = "kw_bert_agree", "kw_bert_disputed", "unknown"
#: Columns of a category's export.
EXPORTED = ("original_id", "review", "review_cleaned", "chunk", "keywords_found", "status")


def distinct_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The row with the smallest key of each non-null text.

    Texts are grouped by digest, so that the shuffle carries no text.
    """
    marked = rows.where(F.col(text).isNotNull())
    first = marked.groupBy(F.sha2(F.col(text), 256).alias("__h")).agg(F.min(key).alias(key)).select(key)
    return marked.join(first, key, "left_semi")


def counters(rows: DataFrame, text: str) -> DataFrame:
    """One row: all rows, those without a text, and those whose text stands in another row that stays."""
    # counted by digest first, so that no text is shuffled and no task holds all of them
    by = rows.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(F.count("*").alias("n"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


def with_cleaned(rows: DataFrame, text: str) -> DataFrame:
    """All columns with <text>_cleaned, the text without stop words."""
    return rows.withColumn(f"{text}_cleaned", english.without_stop_words(F.col(text)))


def prepared_lexicon(lexicon: dict) -> dict:
    """The lexicon with stop words taken out of its keywords, as out of the texts; keywords of stop words alone go.

    Entries that aren't lists stay as they are.
    """
    plain = lambda ks: [p for k in ks if (p := english.plain_keyword(k))]
    return {c: plain(ks) if isinstance(ks, (list, tuple)) else ks for c, ks in lexicon.items()}


def extract(rows: DataFrame, lexicon: dict[str, list[str]], exclusions: dict[str, list[str]], text: str) -> DataFrame:
    """All columns with category and keywords_found, a row per category that has a keyword once exclusions are blanked."""
    lexicon = {c: ks for c, ks in lexicon.items() if ks}
    found = []
    for category, keywords in lexicon.items():
        masked = F.col(text)
        for e in exclusions.get(category, []):
            masked = F.regexp_replace(masked, "(?i)" + keyword_pattern(e), " ")
        hits = F.array_compact(F.array(*[F.when(masked.rlike("(?i)" + keyword_pattern(k)), F.lit(k)) for k in keywords]))
        found.append(F.struct(F.lit(category).alias("category"), F.array_join(hits, ", ").alias("keywords_found")))
    if not found:
        return rows.select("*", F.lit("").alias("category"), F.lit("").alias("keywords_found")).where("false")
    # one cheap pattern passes over the texts without any keyword or exclusion; a blanked exclusion may leave a keyword that wasn't there before
    held = [k for c, ks in lexicon.items() for k in [*ks, *exclusions.get(c, [])]]
    anything = "(?i)" + "|".join(f"(?:{keyword_pattern(k)})" for k in held)
    return (
        rows.where(F.col(text).rlike(anything))
        .select("*", F.inline(F.array(*found)))
        .where("keywords_found <> ''")
    )


def keyword_presence(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Struct of yes or no per category: whether any of its keywords stands in the text."""
    def yes(ks: list[str]) -> Column:
        pattern = "(?i)" + "|".join(f"(?:{keyword_pattern(k)})" for k in ks)
        return F.when(text.rlike(pattern) if ks else F.lit(False), "yes").otherwise("no")

    return F.struct(*[yes(ks).alias(c) for c, ks in lexicon.items()])


def complement(reference: DataFrame, category: DataFrame, key: str) -> DataFrame:
    """Rows of ``reference`` whose non-null key isn't in ``category``."""
    return reference.where(F.col(key).isNotNull()).join(category.select(key).distinct(), key, "left_anti")


def with_status(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Adds status: whether both columns are equal (or both missing), be they scalars or structs."""
    return rows.withColumn("status", F.when(F.col(expected).eqNullSafe(F.col(predicted)), AGREE).otherwise(DISPUTED))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value, null as unknown; most frequent first, then by value."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(UNKNOWN)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def found_keywords(found: Column) -> Column:
    """The set of a comma-joined list's trimmed, non-blank items."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(found, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def category_export(results: DataFrame, lexicon: dict, prediction: str = "bert_prediction") -> DataFrame:
    """category and EXPORTED, a row per category predicted yes that has one of its (raw) keywords among those found.

    Categories with an empty list, or that the prediction doesn't know, export
    nothing; a missing status is unknown. One pass makes all categories.
    """
    known = results.schema[prediction].dataType.fieldNames()
    held = results if "status" in results.columns else results.withColumn("status", F.lit(None).cast("string"))
    wanted = {c: sorted(set(ks)) for c, ks in lexicon.items() if c in known and isinstance(ks, (list, tuple)) and ks}
    if not wanted:
        return held.select(F.lit("").alias("category"), *EXPORTED).where("false")
    marks = F.filter(F.array(*[
        F.when(
            (F.col(f"`{prediction}`.`{c}`") == "yes") & (F.size(F.array_intersect(found_keywords(F.col("keywords_found")), F.array(*map(F.lit, ks)))) > 0), F.lit(c)
        ) for c, ks in wanted.items()
    ]), lambda x: x.isNotNull())
    out = held.withColumn("status", F.coalesce("status", F.lit(UNKNOWN)))
    return out.select(F.explode_outer(marks).alias("category"), *EXPORTED).where("category IS NOT NULL")


def category_complements(reference: DataFrame, exported: DataFrame, key: str, text: str, categories: list[str]) -> DataFrame:
    """category, original_id, review, review_cleaned: of each category that exports a row, the reference rows that it lacks."""
    ids = exported.select("category", F.col("original_id").alias(key)).distinct()
    made = [
        complement(reference, ids.where(F.col("category") == c), key).select(
            F.lit(c).alias("category"), F.col(key).alias("original_id"), F.col(text).alias("review"), F.col(f"{text}_cleaned").alias("review_cleaned")
        ) for c in categories
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.join(F.broadcast(ids.select("category").distinct()), "category", "left_semi")  # as many rows as categories


def top_terms(rows: DataFrame, group: str, text: str, n: int) -> DataFrame:
    """The ``n`` most frequent lower-case words of each group (ties by word), with count and rank."""
    words = F.split(F.lower(english.clean_characters(F.col(text))), " ")
    # the outer form keeps the words' expression out of an inferred filter
    counts = (
        rows.select(group, F.explode_outer(words).alias("word")).where("word <> ''")
        .groupBy(group, "word").agg(F.count("*").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)
