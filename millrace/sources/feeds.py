"""Posts of paged feeds and archives: pages of JSON, rich text, the first text that is there, dates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import english
from millrace.functions.text import strip_tags

#: Fields of a post that may hold its text, in their order; the first is rich text, the last two are titles.
RICH, BODIES, TITLES = "tiptap_body", ("body_trix_content", "truncated_content", "body_for_editor", "body_text"), ("display_title", "name")
# Keys of a rich-text node that hold further nodes, in their order.
CHILDREN = ("content", "body", "children", "elements")
POST = "struct<id:string,published_at:string,space_name:string," + ",".join(f"{c}:string" for c in (RICH, *BODIES, *TITLES)) + ">"


def pages(fetch: Callable[[int], str | None], start: int = 1, most: int | None = None) -> Iterator[str]:
    """Pages (JSON strings) of ``fetch(number)``, one after the other; transport and pauses are the caller's.

    Ends after ``most`` pages (0 or None: no limit), at a page that can't be
    had, has no records or says that none follows. A caller that stores each
    page as it comes holds one at a time.
    """
    number = start
    while not most or number < start + most:
        page = fetch(number)
        held = json.loads(page) if page else {}
        if not held.get("records"):
            return
        yield page
        if not held.get("has_next_page"):
            return
        number += 1


def archive_pages(fetch: Callable[[int, int], str | None], spaces: dict[str, tuple[int, str]], names: list[str] | None = None, most: int | None = None) -> Iterator[tuple[str, str]]:
    """(category, page) of archives; ``spaces`` maps a name to its number and category, unknown names have no pages."""
    for name in spaces if names is None else names:
        if name in spaces:
            space, category = spaces[name]
            yield from ((category, page) for page in pages(lambda n, s=space: fetch(s, n), most=most))


def node_text(node) -> str:
    """Texts of a rich-text tree, depth first, joined by spaces; trees of any depth."""
    out, waiting = [], [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            if x.get("type") == "text" and "text" in x:
                out.append(str(x["text"]))
            waiting.extend(x[k] for k in reversed(CHILDREN) if k in x)
        elif isinstance(x, list):
            waiting.extend(reversed(x))
    return " ".join(" ".join(out).split())


def rich_text(tree: Column) -> Column:
    """Text of a rich-text tree in JSON; anything but an object is empty."""

    @F.pandas_udf("string")
    def texts(trees: pd.Series) -> pd.Series:
        def one(text):
            try:
                held = json.loads(text) if text else None
            except ValueError:
                return ""
            return node_text(held) if isinstance(held, dict) else ""

        return trees.map(one)

    return texts(tree)


def first_text(post: str) -> Column:
    """The first of a post's fields whose cleaned text isn't empty; titles are trimmed only and the first one that is there counts."""
    cleaned = [rich_text(F.col(f"{post}.{RICH}")), *[strip_tags(F.col(f"{post}.{c}")) for c in BODIES]]
    titles = [F.when(F.col(f"{post}.{c}") != "", F.trim(F.col(f"{post}.{c}"))) for c in TITLES]
    return F.coalesce(*[F.when(c != "", c) for c in cleaned], *titles, F.lit(""))


def posts(held: DataFrame, source: str, category: str | None = None, page: str = "page") -> DataFrame:
    """date, category, text, post_id, source of the posts in pages of JSON.

    ``category`` names a column of the pages' category; without one the post's
    space counts, or unknown. Pages and posts that can't be read, and posts
    without text, are left out.
    """
    parsed = F.from_json(page, f"struct<records:array<{POST}>,has_next_page:boolean>")
    rows = held.select(*([F.col(category).alias("__c")] if category else []), F.explode_outer(parsed["records"]).alias("post")).where("post IS NOT NULL")
    named = F.col("__c") if category else F.when(F.col("post.space_name") != "", F.col("post.space_name"))
    return rows.select(
        english.iso_date(F.col("post.published_at")).alias("date"), F.coalesce(named, F.lit("unknown")).alias("category"), first_text("post").alias("text"),
        F.coalesce("post.id", F.lit("")).alias("post_id"), F.lit(source).alias("source"),
    ).where("text <> ''")


def numbered(rows: DataFrame, order: list[str], column: str = "id") -> DataFrame:
    """All columns after a contiguous number from 0 in the given order.

    Rows are numbered within sorted partitions, whose sizes give the offsets,
    so no task holds all rows.
    """
    kind = f"{column} long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.orderBy(*order).rdd.zipWithIndex().map(lambda x: (x[1], *x[0])).toDF(kind)


def statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts per category, most frequent first, and per source by name."""
    count = F.count("*").alias("n")
    return rows.groupBy("category").agg(count).orderBy(F.desc("n"), "category"), rows.groupBy("source").agg(count).orderBy("source")
