"""The funnel's queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import english as E
from millrace.functions import text as T
from millrace.operators import funnel, models
from millrace.operators import reviews as R
from millrace.plans import topics
from millrace.sources import feeds

#: Keywords, exclusions; the last category has none and is passed over.
LEXICON = {"place": ["ther", "attion to thanedble"], "speech": ["thon", "thin-thor", "die und das"], "empty": []}
EXCLUSIONS = {"place": ["ther and thon"], "speech": []}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prepared(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text", E.clean_review(F.col("text")))
    return R.with_cleaned(docs, "text")


def _extracted(spark, sf_dir):
    return R.extract(_prepared(spark, sf_dir), R.prepared_lexicon(LEXICON), R.prepared_lexicon(EXCLUSIONS), "text_cleaned")


def _predicted(spark, sf_dir):
    """Extracted reviews as whole chunks; a stand-in for the classifier says yes by the length of the text."""
    says = lambda k: F.when(F.length("text") % 3 != k, "yes").otherwise("no")
    return R.with_status(
        _extracted(spark, sf_dir).select(
            F.col("doc_id").alias("original_id"), F.col("text").alias("review"), F.col("text_cleaned").alias("review_cleaned"), F.col("text").alias("chunk"),
            "keywords_found", R.keyword_presence(F.col("text"), {c: ks for c, ks in LEXICON.items() if ks}).alias("kw_category"),
            F.struct(says(0).alias("place"), says(1).alias("speech")).alias("bert_prediction"),
        ), "kw_category", "bert_prediction",
    )


def dedup(spark, sf_dir):
    return R.distinct_texts(_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "text")


def counters(spark, sf_dir):
    return R.counters(_table(spark, sf_dir, "documents"), "text")


def cleaned(spark, sf_dir):
    return _prepared(spark, sf_dir).select("doc_id", "text_cleaned")


def extraction(spark, sf_dir):
    return _extracted(spark, sf_dir).select("doc_id", "category", "keywords_found")


def complement(spark, sf_dir):
    found = _extracted(spark, sf_dir).where("category = 'place'")
    return R.complement(_table(spark, sf_dir, "documents").select("doc_id"), found, "doc_id")


def status_stats(spark, sf_dir):
    return R.histogram(_predicted(spark, sf_dir), "status")


def category_export(spark, sf_dir):
    return R.category_export(_predicted(spark, sf_dir), LEXICON).select("category", "original_id", "keywords_found", "status")


def category_complements(spark, sf_dir):
    exported = R.category_export(_predicted(spark, sf_dir), LEXICON)
    return R.category_complements(_prepared(spark, sf_dir), exported, "doc_id", "text", [c for c, ks in LEXICON.items() if ks]).select("category", "original_id")


def review_funnel(spark, sf_dir):
    """The funnel as one run, with a stand-in for the classifier: yes for chunks of an even number of characters."""
    load = lambda: lambda texts: [[1.0 if len(t) % 2 == 0 else -1.0] * 2 for t in texts]
    made = funnel.run(_table(spark, sf_dir, "documents"), "doc_id", "text", LEXICON, EXCLUSIONS, load, length=16)
    return made.chunks.select("original_id", "chunk", "keywords_found", F.col("kw_category.place").alias("place"), F.col("kw_category.speech").alias("speech"), "status")


def review_translated(spark, sf_dir):
    """Texts in other languages than English through a stand-in for the translation, which puts the language before the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.translate(docs, "text", E.language(F.col("text")), lambda: lambda t, k: f"{k}: {t}", keep=("en",))


def review_batches(spark, sf_dir):
    return models.batches(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 15)


def numbered_rows(spark, sf_dir):
    return feeds.numbered(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def event_dates(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _table(spark, sf_dir, "events").groupBy(E.iso_date(stamp).alias("date")).agg(F.count("*").alias("n"))


def source_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


def top_words(spark, sf_dir):
    return R.top_terms(_table(spark, sf_dir, "documents"), "lang", "text", 10).select("lang", "word", "n", "rank")


def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "review_dedup": dedup, "review_counters": counters, "review_cleaned": cleaned, "review_extraction": extraction, "review_complement": complement,
        "status_stats": status_stats, "category_export": category_export, "category_complements": category_complements, "review_funnel": review_funnel,
        "review_translated": review_translated, "review_batches": review_batches, "numbered_rows": numbered_rows, "event_dates": event_dates,
        "source_counts": source_counts, "top_words": top_words, "page_text": page_text,
    } | topics.queries()


_FOUND = topics.CLEANED + r""",
m AS (SELECT doc_id, t, w, regexp_replace(w, '(?i)ther\s+thon', ' ', 'g') AS place FROM plain),
f AS (
  SELECT doc_id, t, w, 'place' AS category, concat_ws(', ', CASE WHEN regexp_matches(place, '(?i)\bther\b') THEN 'ther' END,
    CASE WHEN regexp_matches(place, '(?i)attion\s+thanedble') THEN 'attion thanedble' END) AS keywords_found FROM m
  UNION ALL
  SELECT doc_id, t, w, 'speech', concat_ws(', ', CASE WHEN regexp_matches(w, '(?i)\bthon\b') THEN 'thon' END,
    CASE WHEN regexp_matches(w, '(?i)thin[- ]thor') THEN 'thin-thor' END, CASE WHEN regexp_matches(w, '(?i)die\s+und\s+das') THEN 'die und das' END) FROM m
), found AS (SELECT * FROM f WHERE keywords_found <> ''),
judged AS (
  SELECT *, CASE WHEN length(t) % 3 <> 0 THEN 'yes' ELSE 'no' END AS says_place, CASE WHEN length(t) % 3 <> 1 THEN 'yes' ELSE 'no' END AS says_speech,
    CASE WHEN regexp_matches(t, '(?i)\bther\b|attion\s+to\s+thanedble') THEN 'yes' ELSE 'no' END AS has_place,
    CASE WHEN regexp_matches(t, '(?i)\bthon\b|thin[- ]thor|die\s+und\s+das') THEN 'yes' ELSE 'no' END AS has_speech
  FROM found
), status AS (
  SELECT *, CASE WHEN says_place = has_place AND says_speech = has_speech THEN 'kw_bert_agree' ELSE 'kw_bert_disputed' END AS status FROM judged
), export AS (
  SELECT 'place' AS export, * FROM status WHERE says_place = 'yes' AND len(list_intersect(string_split(keywords_found, ', '), ['ther', 'attion to thanedble'])) > 0
  UNION ALL
  SELECT 'speech', * FROM status WHERE says_speech = 'yes' AND len(list_intersect(string_split(keywords_found, ', '), ['thon', 'thin-thor', 'die und das'])) > 0
)
"""
_FUNNEL = topics.chunk_sql(
    _FOUND.replace("WITH ", "WITH RECURSIVE ", 1) + r""", first AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text),
extracted AS (SELECT row_number() OVER (ORDER BY doc_id, category) AS rid, category AS own, t, doc_id, keywords_found FROM found WHERE doc_id IN (SELECT doc_id FROM first)), """,
    "SELECT rid, own, t FROM extracted",
    (("place", False, r"\bther\b"), ("place", False, r"attion\s+to\s+thanedble"), ("speech", False, r"\bthon\b"), ("speech", False, "thin[- ]thor"),
     ("speech", False, r"die\s+und\s+das"), ("place", True, r"ther\s+and\s+thon")),
    r"\bther\b|attion\s+to\s+thanedble", r"\bthon\b|thin[- ]thor|die\s+und\s+das",
) + """SELECT doc_id AS original_id, chunk, keywords_found, place, speech,
 CASE WHEN place = says AND speech = says THEN 'kw_bert_agree' ELSE 'kw_bert_disputed' END AS status
FROM (SELECT *, CASE WHEN length(chunk) % 2 = 0 THEN 'yes' ELSE 'no' END AS says FROM made) JOIN extracted USING (rid)"""
_TEXT = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '{T.EMAIL}', '', 'g'), '{T.URL}', '', 'g'), '{T.HASHTAG}', '', 'g'), '[/-]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '{T.SPACES}', ' ', 'g'))"""


def oracle_sql() -> dict[str, str]:
    return {
        "review_dedup": "SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text",
        "review_counters": "SELECT count(*) AS total, count(*) - count(text) AS missing, count(text) - count(DISTINCT text) AS duplicates FROM documents",
        "review_cleaned": topics.CLEANED + "SELECT doc_id, w AS text_cleaned FROM plain",
        "review_extraction": _FOUND + "SELECT doc_id, category, keywords_found FROM found",
        "review_complement": _FOUND + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found WHERE category = 'place')",
        "status_stats": _FOUND + "SELECT status, count(*) AS n FROM status GROUP BY 1",
        "category_export": _FOUND + "SELECT export AS category, doc_id AS original_id, keywords_found, status FROM export",
        "category_complements": _FOUND + "SELECT c AS category, doc_id AS original_id FROM documents, (SELECT DISTINCT export AS c FROM export) WHERE doc_id NOT IN (SELECT doc_id FROM export WHERE export = c)",
        "review_funnel": _FUNNEL,
        "review_translated": f"""SELECT doc_id, CASE WHEN language <> 'en' AND regexp_matches(text, '\\S') THEN language || ': ' || text ELSE text END AS text, language
FROM documents JOIN ({topics.LANGUAGE}) USING (doc_id)""",
        "review_batches": "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 15 AS batch FROM documents",
        "numbered_rows": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id FROM documents",
        "event_dates": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1",
        "source_counts": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL",
        "top_words": f"""
SELECT * FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)::INTEGER AS rank FROM (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(lower({_TEXT}), ' ')) AS word FROM documents)
  WHERE word <> '' GROUP BY ALL)) WHERE rank <= 10""",
        "page_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''),
  '\s+', ' ', 'g')) AS text FROM pages""",
    } | topics.oracle_sql()
