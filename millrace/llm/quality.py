"""Quality rules as a short-circuit cascade (native: DataFrame functions only).

Each rule is one self-contained expression over the text, evaluated lazily
inside a CASE WHEN. A bounded sample gives each rule's cost (seconds) and
selectivity (share of documents it rejects); rules then stand in the order of
rejection per cost, so that most rejected documents never reach the dear rules.
The order changes the work only, never the verdict: a document is kept if no
rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Rows of the sample that the order of the rules is estimated on, and the longest text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 20_000


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS))


def n_dup_lines(text: Column) -> Column:
    """Lines (split at \\n) that have a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_repeat_words(words: Column) -> Column:
    """Words that stand in a window of five words found twice or more, the first one included.

    Windows are hashed first: equal ones have equal hashes, so a text whose
    hashes all differ has none. Only others build and sort their windows.
    """
    def windows(w, made, kind):
        return F.when(
            F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: made(*[F.get(w, i + k) for k in range(WINDOW)]))
        ).otherwise(F.array().cast(f"array<{kind}>"))

    def covered(grams):
        ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s):
            hit = F.transform(
                s,
                lambda x, k: F.when(
                    x["g"].eqNullSafe(F.get(s, k - 1)["g"]) | x["g"].eqNullSafe(F.get(s, k + 1)["g"]), x["i"]
                ),
            )
            return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))

        def total(p):
            step = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0), lambda a, b: a + b)

        return let(ranked, lambda s: let(starts(s), total))

    strings = lambda w: windows(w, lambda *x: F.concat_ws(" ", *x), "string")
    return let(
        words,
        lambda w: let(
            windows(w, F.xxhash64, "bigint"), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(strings(w))).otherwise(F.lit(0))
        ),
    )


def n_adjacent(words: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(F.transform(words, lambda w, i: (i > 0) & w.eqNullSafe(F.get(words, i - 1))), lambda x: x))


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for documents that fail."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: The base rules are fixed by contract, the others are tuned on labelled quality.
BASE_RULES = (
    Rule("too_few_words", lambda t, w: F.size(w) < 10),
    Rule("repeated_windows", lambda t, w: 100 * n_repeat_words(w) > 20 * F.size(w)),
)
MORE_RULES = (
    Rule("symbols", lambda t, w: 10 * n_symbols(t) > F.size(w)),
    Rule("exclamations", lambda t, w: 5 * F.regexp_count(t, F.lit("!")) > F.size(w)),
    Rule("capitals", lambda t, w: 10 * F.regexp_count(t, F.lit(r"\p{Lu}")) > 3 * F.regexp_count(t, F.lit(r"\p{L}"))),
    Rule("stutter", lambda t, w: 5 * n_adjacent(w) > F.size(w)),
    Rule("word_length", lambda t, w: F.length(F.array_join(w, "")) > 20 * F.size(w)),
)
RULES = BASE_RULES + MORE_RULES


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __text (null: empty) and __words."""
    return docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(
        "__words", words_of(F.col("__text"))
    )


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), best rejection per cost first.

    The sample is the first SAMPLE_ROWS texts of at most SAMPLE_CHARS characters
    that the scan meets; it sets the order alone. Ties keep the given order.
    """
    spark = docs.sparkSession
    rows = (
        docs.select(F.col(text).cast("string").alias("text"))
        .where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
        .limit(SAMPLE_ROWS)
        .collect()
    )
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    sample = with_words(spark.createDataFrame(rows, "text string").coalesce(1))
    t, w = F.col("__text"), F.col("__words")
    found = []
    base = None
    for rule in (Rule("", lambda t, w: F.size(w) < 0), *rules):
        query = sample.select(F.avg(rule.rejects(t, w).cast("double")))
        query.collect()
        began = time.perf_counter()
        share = query.collect()[0][0] or 0.0
        took = time.perf_counter() - began
        if base is None:
            base = took  # what any query costs
        else:
            found.append((rule, max(took - base, 1e-4), share))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = None
    for r in rules:
        hit = r.rejects(text, words)
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return out


def verdict(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> Column:
    """The rule that rejects a row of ``docs`` (null: kept), by the cascade in the order that a sample gives.

    The sample is taken by Spark jobs while the plan is built. Null texts count
    as empty and fail the word count; repeated rows are judged one by one.
    """
    ordered = [r for r, _, _ in rule_order(docs, rules, text)]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # bound to a name: a filter on the verdict would else split the text anew inside every lambda
    return let(words_of(whole), lambda w: cascade(ordered, whole, w))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", column: str = "rejected_by") -> DataFrame:
    """All columns of ``docs`` and ``column``, the rule that rejects the row; an empty table stays empty."""
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already")
    return docs.withColumn(column, verdict(docs, rules, text))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their columns as they were."""
    return docs.where(verdict(docs).isNull())


def report(docs: DataFrame) -> DataFrame:
    """The digest of every document: counts, base rules and the cascade's verdict.

    The counts of the base rules are needed for each row here, so their
    expressions are computed once and the cascade reads them.
    """
    ordered = [r for r, _, _ in rule_order(docs)]
    counted = with_words(docs.select("doc_id", "text")).select(
        "doc_id",
        "__text",
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("__text")).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("__text")).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("__words")).cast("long").alias("n_repeat_words"),
    )
    known = {
        "too_few_words": F.col("n_words") < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": F.col("word_chars") > 20 * F.col("n_words"),
    }
    ordered = [Rule(r.name, lambda t, w, k=known[r.name]: k) if r.name in known else r for r in ordered]
    verdict = cascade(ordered, F.col("__text"), F.col("__words"))
    base_failed = known["too_few_words"] | known["repeated_windows"]
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & verdict.isNull()).alias("kept"),
    )


#: The same report as DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT *, list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) AS grams,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest(range(i, i + 5)) AS p FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c
      FROM (SELECT rid, unnest(grams) AS gram, unnest(range(0, len(grams))) AS i FROM (SELECT *, row_number() OVER () AS rid FROM g))
    ) WHERE c > 1
  ) GROUP BY rid
), f AS (
  SELECT doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM (SELECT *, row_number() OVER () AS rid FROM g) g LEFT JOIN r USING (rid)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words
            OR 5 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words
            OR 10 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 3 * length(regexp_replace(t, '[^\p{L}]', '', 'g'))
            OR 5 * len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) > n_words
            OR word_chars > 20 * n_words) AS kept
FROM b
"""
