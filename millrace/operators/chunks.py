"""Windows of tokens round keywords, reduced by overlap; native expressions on one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import keyword_pattern, overlap


def match_spans(text: Column, pattern: str) -> Column:
    """Spans (start, end) of all matches, left to right, in characters, end exclusive."""
    pattern = "(?i)" + pattern
    between = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    none = F.array().cast("array<struct<start:int,end:int>>")
    folded = F.aggregate(
        F.arrays_zip(between.alias("gap"), hits.alias("hit")),
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end"))))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(pattern), folded).otherwise(none)


def trigger_spans(text: Column, keywords: list[str], exclusions: list[str]) -> Column:
    """Keyword spans that no exclusion's span contains."""
    spans = F.flatten(F.array(*[match_spans(text, keyword_pattern(k)) for k in keywords]))
    if not exclusions:
        return spans
    barred = F.flatten(F.array(*[match_spans(text, keyword_pattern(k)) for k in exclusions]))
    return F.filter(spans, lambda s: ~F.exists(barred, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))


def window(n: Column, centre: Column, length: int) -> tuple[Column, Column]:
    """Start and end of the window of ``length`` tokens round ``centre`` among ``n``; empty where start reaches end."""
    half = length // 2
    start, end = F.greatest(centre - half, F.lit(0)), F.least(centre + half, n)
    short = end - start < length
    return (
        F.when(short & (start > 0), F.greatest(n - length, F.lit(0))).otherwise(start),
        F.when(short & (start == 0), F.least(n, F.lit(length))).otherwise(end),
    )


def reduced(chunks: Column, kind: str, threshold: float) -> Column:
    """Greedy leaders in order; each absorbs chunks that overlap it, and the one with most categories stands for them."""
    return F.transform(
        F.aggregate(
            chunks, F.array().cast(f"array<struct<lead:{kind},best:{kind}>>"),
            lambda acc, c: _placed(acc, c, threshold),
        ),
        lambda g: g["best"],
    )


def _placed(acc: Column, c: Column, threshold: float) -> Column:
    near = F.transform(acc, lambda g: overlap(g["lead"]["tokens"], c["tokens"]) >= threshold)
    at = F.array_position(near, F.lit(True)).cast("int")  # one-based, 0: none
    grown = F.transform(
        acc, lambda g, i: F.when((i + 1 == at) & (c["kw_count"] > g["best"]["kw_count"]), F.struct(g["lead"].alias("lead"), c.alias("best"))).otherwise(g)
    )
    return F.when(at == 0, F.concat(acc, F.array(F.struct(c.alias("lead"), c.alias("best"))))).otherwise(grown)


def chunked(
    rows: DataFrame, text: str, lexicon: dict[str, list[str]], exclusions: dict[str, list[str]], length: int = 128, threshold: float = 0.75,
    category: str | None = None,
) -> DataFrame:
    """All columns with chunk_no, chunk and kw_category (struct of yes or no), a row per reduced window.

    Tokens are the words between spaces. ``category`` names a column of
    categories between white space: only theirs give triggers, and rows without
    one give no chunk; with no such column all categories do. Rows without a
    trigger, null and empty texts give none.
    """
    lexicon = {c: ks for c, ks in lexicon.items() if ks}
    own = F.split(F.coalesce(F.col(category), F.lit("")), r"\s+") if category else None
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = [
        trigger_spans(F.col(text), ks, exclusions.get(c, [])) if own is None
        else F.when(F.array_contains(own, c), trigger_spans(F.col(text), ks, exclusions.get(c, []))).otherwise(none)
        for c, ks in lexicon.items()
    ]
    triggers = F.flatten(F.array(*spans))
    # tokens before a position: spaces before it
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    held = (
        rows.where(F.col(text).rlike("(?i)" + "|".join(f"(?:{keyword_pattern(k)})" for ks in lexicon.values() for k in ks)))
        .withColumn("__t", F.split(text, " "))
        .withColumn("__c", F.array_sort(F.array_distinct(F.transform(triggers, lambda s: spaces(F.substring(F.col(text), F.lit(1), s["start"]))))))
    )

    def cut(c: Column) -> Column:
        start, end = window(F.size("__t"), c, length)
        return F.slice("__t", start + 1, F.greatest(end - start, F.lit(0)))

    def described(part: Column) -> Column:
        shown = F.array_join(part, " ")
        yes = [F.when(shown.rlike("(?i)" + "|".join(f"(?:{keyword_pattern(k)})" for k in ks)), "yes").otherwise("no").alias(c) for c, ks in lexicon.items()]
        count = sum(((y == "yes").cast("int") for y in yes), F.lit(0))
        return F.struct(part.alias("tokens"), shown.alias("chunk"), F.struct(*yes).alias("kw_category"), count.alias("kw_count"))

    kind = "struct<tokens:array<string>,chunk:string,kw_category:struct<" + ",".join(f"`{c}`:string" for c in lexicon) + ">,kw_count:int>"
    made = held.withColumn("__w", F.transform(F.transform("__c", cut), described).cast(f"array<{kind}>"))
    return made.select(*[F.col(f"`{c}`") for c in rows.columns], F.posexplode(reduced(F.col("__w"), kind, threshold)).alias("chunk_no", "__x")).select(
        *[F.col(f"`{c}`") for c in rows.columns], "chunk_no", F.col("__x.chunk").alias("chunk"), F.col("__x.kw_category").alias("kw_category")
    )
