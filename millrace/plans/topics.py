"""Queries of the text and topic operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import english as E
from millrace.functions.text import EMAIL, HASHTAG, SPACES, URL
from millrace.operators import chunks, density, needs, terms, vectors

TERM = r"[\p{L}\p{N}_]{2,}"
LEXICON = {"place": ["there", "on the"], "speech": ["that"]}
WINDOW = 16
#: Least similarity of an embedding and of terms in the hybrid assignment.
NEED = (0.20, 0.08)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir, low=1, high=1):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    if high == 1:
        return docs.select("doc_id", "lang", found.alias("terms"))
    return docs.select("doc_id", "lang", terms.ngrams(found, low, high).alias("terms"))


def number_words(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", E.number_words(F.col("text")).alias("text"))


def clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", E.clean_review(F.col("text")).alias("text"))


def stopword_clean(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", E.without_stop_words(F.col("text")).alias("text"))


def lang_detect(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", E.language(F.col("text")).alias("language"))


def chunk_windows(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[\s\p{Z}\x{85}]+", " ")).alias("t"))
    out = chunks.chunked(docs, "t", LEXICON, {"place": ["there is"]}, WINDOW)
    return out.select("doc_id", "chunk_no", "chunk", F.col("kw_category.place").alias("place"), F.col("kw_category.speech").alias("speech"))


def tfidf(spark, sf_dir):
    return terms.tfidf(_documents(spark, sf_dir), "doc_id", "terms").groupBy("term").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))


def _ratio(spark, sf_dir):
    return terms.discriminative(_documents(spark, sf_dir), "doc_id", "terms", F.col("lang") == "en")


def tfidf_ratio(spark, sf_dir):
    out = _ratio(spark, sf_dir)
    return out.select("term", F.round("score_in", 6).alias("score_in"), F.round("score_out", 6).alias("score_out"), F.round("ratio", 4).alias("ratio"))


def discriminants(spark, sf_dir):
    return terms.discriminants(_ratio(spark, sf_dir)).select("rank", "term")


def tfidf_bigrams(spark, sf_dir):
    return terms.tfidf(_documents(spark, sf_dir, 2, 2), "doc_id", "terms").groupBy("term").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))


def collocations(spark, sf_dir):
    return terms.collocations(_documents(spark, sf_dir), "terms").select("a", "b", F.round("score", 6).alias("score"))


def class_tfidf(spark, sf_dir):
    return terms.class_tfidf(_documents(spark, sf_dir), "lang", "terms").select("lang", "term", "rank")


def nmf_topics(spark, sf_dir):
    docs = _documents(spark, sf_dir, 1, 2)
    return terms.nmf_of_vectors(*terms.vectors(docs, "doc_id", "terms", 5, 0.8, 5000), "doc_id", keys=docs)[0].select("doc_id", "dominant_topic")


def lda_topics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", E.letters_only(F.col("text")).alias("words"))
    return terms.lda(docs, "words").select("doc_id", "dominant_topic")


def nmf_words(spark, sf_dir):
    words = terms.topic_words(terms.nmf_of_vectors(*terms.vectors(_documents(spark, sf_dir, 1, 2), "doc_id", "terms", 5, 0.8, 5000), "doc_id")[1])
    return spark.createDataFrame(words, "topic int, rank int, word string, weight double")


def lemmatised(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", E.lemmas(F.lower("text")).alias("text"))


def topic_corpus(spark, sf_dir):
    """Texts without the term list's words; those of five characters or fewer are left out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", E.without_words(F.col("text"), E.STOP_WORDS + E.EXTRA_TERM_WORDS).alias("text"))
    return docs.where(F.length(F.trim("text")) > 5)


def _needs(spark, sf_dir):
    """Reviews with a vector, and a topic for each label: the mean vector, named by eight words of the label's first review."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text").join(_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    named = rows.groupBy("label").agg(F.min_by(F.array_join(F.slice(F.split("text", " "), 1, 8), " "), "doc_id").alias("topic"))
    mean = vectors.centroids(_table(spark, sf_dir, "embeddings"), "label", "embedding")
    topics = named.join(mean, "label").select(F.col("label").cast("long").alias("position"), "topic", F.col("mean").alias("vector"))
    return rows, topics


def _assigned(spark, sf_dir):
    rows, found = _needs(spark, sf_dir)
    return needs.assign(rows, "doc_id", "text", "embedding", found, *NEED)


def hybrid_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("doc_id", "assigned_topic", "score", "method")


def topic_counts(spark, sf_dir):
    return needs.topic_counts(_assigned(spark, sf_dir), 2)


def representatives(spark, sf_dir):
    return needs.representatives(_assigned(spark, sf_dir), "doc_id", 2).select("assigned_topic", "n", "rank", "review", "tfidf_score")


def topic_clusters(spark, sf_dir):
    return needs.clusters(_needs(spark, sf_dir)[1], "position", "vector", 0.5)


def reduced_topics(spark, sf_dir):
    return needs.reduced_topics(_needs(spark, sf_dir)[1], "position", "vector", 0.0, 2)


def centroids(spark, sf_dir):
    out = vectors.centroids(_table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", F.posexplode("mean").alias("p", "x")).select("label", "p", F.round("x", 6).alias("x"))


def medoids(spark, sf_dir):
    out = vectors.medoids(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "vec_id", F.round("similarity", 5).alias("similarity"))


def assign_best(spark, sf_dir):
    """Every vector to the nearest of eight topics, the vectors of the first eight ids."""
    rows = _table(spark, sf_dir, "embeddings")
    topics = [(str(r[0]), list(r[1])) for r in rows.where("vec_id < 8").orderBy("vec_id").select("vec_id", "embedding").collect()]
    return vectors.assign_best(rows.select("vec_id", "embedding"), "embedding", topics).select("vec_id", "topic", F.round("score", 5).alias("score"))


def density_topics(spark, sf_dir):
    points = density.reduced(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3)
    return density.clusters(points, "vec_id", "point", 0.2)


def queries():
    made = (number_words, clean_text, stopword_clean, lang_detect, chunk_windows, tfidf, tfidf_ratio, discriminants, tfidf_bigrams, collocations, class_tfidf, nmf_topics, nmf_words, lda_topics, lemmatised, topic_corpus, centroids, medoids, assign_best, hybrid_assignment, topic_counts, representatives, topic_clusters, reduced_topics, density_topics)
    return {f.__name__: f for f in made}


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_TOKEN = r"[\p{L}](?:[\p{L}''_-])+[\p{L}]|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def _plain(text):
    """A text's plain words without stop words, contractions kept."""
    return f"""array_to_string(list_filter(regexp_extract_all(lower(replace({text}, '’', '''')), '{_TOKEN}'),
 lambda x: regexp_full_match(x, '[a-z]+(?:[-''][a-z]+)*') AND (list_contains({_list(E.CONTRACTIONS)}, x) OR NOT list_contains({_list(E.STOP_WORDS)}, x))), ' ')"""


_SMALL, _TENS, _SCALES = _list(E.SMALL), _list(E.TENS), _list(E.SCALES)
_LOW = f"CASE WHEN g % 100 < 20 THEN {_SMALL}[g % 100 + 1] ELSE {_TENS}[g % 100 // 10 - 1] || CASE WHEN g % 10 > 0 THEN '-' || {_SMALL}[g % 10 + 1] ELSE '' END END"
_SPELLED = f"""
WITH runs AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents),
parts AS (SELECT run, k, substr(lpad(run, {E.MOST_DIGITS}, '0'), 3 * k + 1, 3)::INTEGER AS g FROM runs, range({len(E.SCALES) + 1}) r(k) WHERE length(run) <= {E.MOST_DIGITS}),
named AS (
  SELECT run, k, CASE WHEN k = {len(E.SCALES)} AND g < 100 THEN ' and ' ELSE ', ' END
    || CASE WHEN g < 100 THEN {_LOW} WHEN g % 100 = 0 THEN {_SMALL}[g // 100 + 1] || ' hundred' ELSE {_SMALL}[g // 100 + 1] || ' hundred and ' || {_LOW} END
    || CASE WHEN k < {len(E.SCALES)} THEN ' ' || {_SCALES}[{len(E.SCALES)} - k] ELSE '' END AS w FROM parts WHERE g > 0),
spelled AS (SELECT run, coalesce(regexp_replace(w, '^(, | and )', ''), CASE WHEN length(run) > {E.MOST_DIGITS} THEN run ELSE 'zero' END) AS w
  FROM runs LEFT JOIN (SELECT run, string_agg(w, '' ORDER BY k) AS w FROM named GROUP BY run) USING (run)),
held AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+') AS r, string_split_regex(text, '[0-9]+') AS p FROM documents),
pieces AS (SELECT doc_id, i, p[i] AS a, r[i] AS run FROM (SELECT doc_id, p, r, unnest(range(1, len(p) + 1)) AS i FROM held)),
numbered AS (SELECT doc_id, string_agg(a || coalesce(w, ''), '' ORDER BY i) AS text FROM pieces LEFT JOIN spelled USING (run) GROUP BY doc_id)
"""
CLEANED = _SPELLED + f""",
clean AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '{EMAIL}', '', 'g'), '{URL}', '', 'g'), '{HASHTAG}', '', 'g'), '[/-]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '{SPACES}', ' ', 'g')) AS t FROM numbered),
plain AS (SELECT doc_id, t, {_plain("t")} AS w FROM clean)
"""
_TERMS = rf"""
WITH docs AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '{TERM}') AS w FROM documents),
"""
_WEIGHTS = """
occ AS (SELECT doc_id, term, count(*) AS tf FROM {source} GROUP BY ALL),
total AS (SELECT count(*) AS n FROM docs),
idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM occ, total GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.9 * any_value(n)),
raw AS (SELECT doc_id, term, tf * idf AS x FROM occ JOIN idf USING (term)),
weights AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""
_UNI = _TERMS + _WEIGHTS.format(source="(SELECT doc_id, unnest(w) AS term FROM docs)")
_SCORES = _UNI + """, scores AS (
SELECT term, coalesce(sum(weight) FILTER (lang = 'en'), 0.0) / (SELECT count(*) FROM docs WHERE lang = 'en') AS score_in,
 coalesce(sum(weight) FILTER (lang IS DISTINCT FROM 'en'), 0.0) / (SELECT count(*) FROM docs WHERE lang IS DISTINCT FROM 'en') AS score_out
FROM weights JOIN docs USING (doc_id) GROUP BY term)
"""
_BI = _TERMS + _WEIGHTS.format(source="(SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM docs)")


def says(text, pattern):
    return f"CASE WHEN regexp_matches({text}, '(?i){pattern}') THEN 'yes' ELSE 'no' END"


def chunk_sql(head, source, patterns, place, speech):
    """CTEs after ``head`` up to made(rid, chunk_no, chunk, place, speech).

    ``source`` gives rid, own (a category, null for all) and t; ``patterns`` are
    (category, excluded, pattern).
    """
    matches = " UNION ALL ".join(
        f"SELECT rid, t, '{c}' AS category, {str(x).lower()} AS excluded, {k} AS pattern, string_split_regex(t, '(?i){p}') AS gaps, regexp_extract_all(t, '(?i){p}') AS hits"
        f" FROM docs WHERE coalesce(own, '{c}') = '{c}'"
        for k, (c, x, p) in enumerate(patterns)
    )
    return head + rf"""docs AS ({source}),
matches AS ({matches}),
places AS (SELECT rid, t, category, excluded, pattern, i, length(gaps[i]) AS gap, length(hits[i]) AS hit FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM matches)),
spans AS (SELECT *, sum(gap + hit) OVER (PARTITION BY rid, pattern ORDER BY i) - hit AS start FROM places),
triggers AS (
  SELECT DISTINCT rid, t, length(t[1:start]) - length(replace(t[1:start], ' ', '')) AS c FROM spans k
  WHERE NOT excluded AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.excluded AND x.rid = k.rid AND x.category = k.category AND x.start <= k.start AND x.start + x.hit >= k.start + k.hit)),
centres AS (SELECT rid, string_split(t, ' ') AS tok, greatest(c - {WINDOW // 2}, 0) AS a, least(c + {WINDOW // 2}, len(string_split(t, ' '))) AS b, row_number() OVER (PARTITION BY rid ORDER BY c) AS k FROM triggers),
windows AS (
  SELECT rid, k, tok[CASE WHEN b - a < {WINDOW} AND a > 0 THEN greatest(len(tok) - {WINDOW}, 0) ELSE a END + 1 : CASE WHEN b - a < {WINDOW} AND a = 0 THEN least(len(tok), {WINDOW}) ELSE b END] AS tok FROM centres),
chunks AS (
  SELECT *, (place = 'yes')::INTEGER + (speech = 'yes')::INTEGER AS n FROM (
    SELECT *, {says("chunk", place)} AS place, {says("chunk", speech)} AS speech FROM (SELECT rid, k, list_distinct(tok) AS tok, array_to_string(tok, ' ') AS chunk FROM windows))),
state(rid, k, leads) USING KEY (rid) AS (
  SELECT rid, k, [{{'tok': tok, 'best': k, 'n': n}}] FROM chunks WHERE k = 1
  UNION ALL
  SELECT rid, k, CASE WHEN coalesce(place_of, 0) = 0 THEN list_append(leads, {{'tok': tok, 'best': k, 'n': n}})
    ELSE list_transform(leads, lambda l, i: CASE WHEN i = place_of AND n > l.n THEN {{'tok': l.tok, 'best': k, 'n': n}} ELSE l END) END
  FROM (
    SELECT s.rid, c.k, s.leads, c.tok, c.n, list_position(list_transform(s.leads, lambda l: len(list_intersect(l.tok, c.tok)) >= 0.75 * least(len(l.tok), len(c.tok))), true) AS place_of
    FROM state s JOIN chunks c ON c.rid = s.rid AND c.k = s.k + 1)),
made AS (SELECT rid, chunk_no::INTEGER AS chunk_no, chunk, place, speech FROM (SELECT rid, unnest(range(0, len(leads))) AS chunk_no, unnest(leads).best AS k FROM state) JOIN chunks USING (rid, k))
"""


_CHUNKS = chunk_sql(
    "WITH RECURSIVE ", f"SELECT doc_id AS rid, NULL AS own, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS t FROM documents",
    (("place", False, r"\bthere\b"), ("place", False, r"on\s+the"), ("speech", False, r"\bthat\b"), ("place", True, r"there\s+is")), r"\bthere\b|on\s+the", r"\bthat\b",
) + "SELECT rid AS doc_id, chunk_no, chunk, place, speech FROM made"
_ASSIGNED = rf"""
WITH base AS (SELECT doc_id, text, embedding::DOUBLE[] AS v, label FROM documents JOIN embeddings ON doc_id = vec_id),
centre AS (SELECT label, list(x ORDER BY p) AS v FROM (SELECT label, p, avg(embedding[p]::DOUBLE) AS x FROM embeddings, range(1, 65) r(p) GROUP BY ALL) GROUP BY label),
topics AS (SELECT label AS position, array_to_string(string_split(t, ' ')[1:8], ' ') AS topic, v FROM (SELECT label, arg_min(text, doc_id) AS t FROM base GROUP BY label) JOIN centre USING (label)),
corpus AS (SELECT 0 AS side, doc_id AS k, text AS t FROM base UNION ALL SELECT 1, position, topic FROM topics),
words AS (SELECT side, k, list_filter(regexp_extract_all(lower(coalesce(t, '')), '{TERM}'), lambda x: NOT list_contains({_list(E.STOP_WORDS)}, x)) AS w FROM corpus),
occ AS (SELECT side, k, term, count(*) AS tf FROM (SELECT side, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words) GROUP BY ALL),
vocabulary AS (SELECT term, count(*) AS df FROM occ GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
raw AS (SELECT side, k, term, tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + df)) + 1) AS x FROM occ JOIN vocabulary USING (term)),
weights AS (SELECT side, k, term, x / sqrt(sum(x * x) OVER (PARTITION BY side, k)) AS w FROM raw),
shared AS (SELECT a.k AS doc_id, b.k AS position, round(sum(a.w * b.w), 12) AS s FROM weights a JOIN weights b USING (term) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL),
counted AS (SELECT doc_id, position AS tp, s AS ts FROM shared QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, position) = 1),
near AS (
  SELECT doc_id, text, position AS ep, s AS es FROM (SELECT doc_id, text, position, round(list_cosine_similarity(base.v, topics.v), 12) AS s FROM base, topics)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, position) = 1),
both_ways AS (SELECT doc_id, text, ep, es, coalesce(tp, (SELECT min(position) FROM topics)) AS tp, coalesce(ts, 0.0) AS ts FROM near LEFT JOIN counted USING (doc_id)),
assigned AS (
  SELECT doc_id, text AS review, CASE WHEN es >= {NEED[0]} THEN e.topic WHEN ts >= {NEED[1]} THEN c.topic ELSE '{needs.NO_NEED}' END AS assigned_topic,
    round_even(CASE WHEN es >= {NEED[0]} THEN es WHEN ts >= {NEED[1]} THEN ts ELSE greatest(es, ts) END, 3) AS score,
    CASE WHEN es >= {NEED[0]} THEN 'embedding' WHEN ts >= {NEED[1]} THEN 'tfidf' ELSE 'none' END AS method
  FROM both_ways JOIN topics e ON e.position = ep JOIN topics c ON c.position = tp),
kept AS (SELECT assigned_topic, count(*) AS n FROM assigned WHERE assigned_topic <> '{needs.NO_NEED}' GROUP BY ALL HAVING count(*) >= 2)
"""
_LIKEST = _ASSIGNED + rf""",
own AS (SELECT assigned_topic, doc_id AS k, review AS t FROM assigned JOIN kept USING (assigned_topic) UNION ALL SELECT assigned_topic, NULL, assigned_topic FROM kept),
own_words AS (SELECT assigned_topic, k, list_filter(regexp_extract_all(lower(t), '{TERM}'), lambda x: NOT list_contains({_list(E.STOP_WORDS)}, x)) AS w FROM own),
own_occ AS (SELECT assigned_topic, k, term, count(*) AS tf FROM (SELECT assigned_topic, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM own_words) GROUP BY ALL),
own_raw AS (SELECT assigned_topic, k, term, tf * (ln((2 + n) / (1 + count(*) OVER (PARTITION BY assigned_topic, term))) + 1) AS x FROM own_occ JOIN kept USING (assigned_topic)),
own_weights AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY assigned_topic, k)) AS y FROM own_raw),
likeness AS (SELECT a.assigned_topic, a.k, sum(a.y * b.y) AS s FROM own_weights a JOIN own_weights b ON a.assigned_topic = b.assigned_topic AND a.term = b.term WHERE a.k IS NOT NULL AND b.k IS NULL GROUP BY ALL)
SELECT assigned_topic, n, rank, review, round(s, 3) AS tfidf_score FROM (
  SELECT a.assigned_topic, n, review, coalesce(s, 0.0) AS s, row_number() OVER (PARTITION BY a.assigned_topic ORDER BY round(coalesce(s, 0.0), 9) DESC, doc_id)::INTEGER AS rank
  FROM assigned a JOIN kept USING (assigned_topic) LEFT JOIN likeness l ON l.assigned_topic = a.assigned_topic AND k = doc_id) WHERE rank <= 3"""


_HITS = ", ".join(f"len(list_filter(w, lambda x: list_contains({_list(ws)}, x)))" for ws in E.LANGUAGE_WORDS.values())
LANGUAGE = rf"""SELECT doc_id, CASE WHEN list_max(n) = 0 THEN 'unknown' ELSE {_list(E.LANGUAGE_WORDS)}[list_position(n, list_max(n))] END AS language
FROM (SELECT doc_id, [{_HITS}] AS n FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') AS w FROM documents))"""


def _linked(least):
    """CTEs up to linked(position, v, cluster): complete linkage of the labels' mean vectors, one merge a round."""
    return f"""
WITH RECURSIVE centre AS (SELECT label, list(x ORDER BY p) AS v FROM (SELECT label, p, avg(embedding[p]::DOUBLE) AS x FROM embeddings, range(1, 65) r(p) GROUP BY ALL) GROUP BY label),
named AS (SELECT row_number() OVER (ORDER BY label) AS a, label AS position, v FROM centre WHERE label IN (SELECT label FROM documents JOIN embeddings ON doc_id = vec_id) AND list_dot_product(v, v) > 0),
far AS (SELECT x.a, y.a AS b, 1 - list_cosine_similarity(x.v, y.v) AS d FROM named x JOIN named y ON x.a < y.a),
merged(step, root) AS (
  SELECT 0, (SELECT list(a ORDER BY a) FROM named)
  UNION ALL
  SELECT step + 1, list_transform(root, lambda x: CASE WHEN x = j THEN i ELSE x END) FROM merged, (
    SELECT i, j FROM (
      SELECT least(p, q) AS i, greatest(p, q) AS j, max(d) AS d FROM (SELECT root[a] AS p, root[b] AS q, d FROM merged, far) WHERE p <> q GROUP BY ALL)
    WHERE d < {1 - least} ORDER BY d, i, j LIMIT 1)),
linked AS (
  SELECT position, v, (dense_rank() OVER (ORDER BY root[a]) - 1)::INTEGER AS cluster FROM named, (SELECT root FROM merged ORDER BY step DESC LIMIT 1))
"""


def oracle_sql():
    rules = " ".join(f"WHEN regexp_matches(w, '{p}') THEN regexp_replace(w, '{p}', '\\1{e}')" for p, e in E.LEMMA_RULES)
    lemma = "CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in E.IRREGULAR.items()) + f" {rules} ELSE w END"
    return {
        "number_words": _SPELLED + "SELECT doc_id, text FROM numbered",
        "clean_text": CLEANED + "SELECT doc_id, t AS text FROM plain",
        "stopword_clean": f"SELECT doc_id, {_plain('text')} AS text FROM documents",
        "lemmatised": rf"""SELECT doc_id, trim(replace(array_to_string(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '{SPACES}', ' ', 'g'), ' '), lambda w: {lemma}), ' '), ' - ', '-')) AS text FROM documents""",
        "topic_corpus": rf"""SELECT * FROM (SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')), ' '),
 lambda w: NOT list_contains({_list(E.STOP_WORDS + E.EXTRA_TERM_WORDS)}, w)), ' ') AS text FROM documents) WHERE length(trim(text)) > 5""",
        "lang_detect": LANGUAGE,
        "tfidf": _UNI + "SELECT term, round(sum(weight), 6) AS weight, count(*) AS n FROM weights GROUP BY term",
        "tfidf_bigrams": _BI + "SELECT term, round(sum(weight), 6) AS weight, count(*) AS n FROM weights GROUP BY term",
        "tfidf_ratio": _SCORES + "SELECT term, round(score_in, 6) AS score_in, round(score_out, 6) AS score_out, round(score_in / greatest(score_out, 1e-6), 4) AS ratio FROM scores",
        "discriminants": _SCORES + """SELECT row_number() OVER (ORDER BY round(score_in, 12) DESC, term)::INTEGER AS rank, term FROM scores
WHERE score_in / greatest(score_out, 1e-6) >= 1.5 ORDER BY rank LIMIT 80""",
        "chunk_windows": _CHUNKS,
        "hybrid_assignment": _ASSIGNED + "SELECT doc_id, assigned_topic, score, method FROM assigned",
        "topic_clusters": _linked(0.5) + "SELECT position, cluster FROM linked",
        "reduced_topics": _linked(0.0) + """SELECT cluster, position, size FROM (
  SELECT x.cluster, x.position, count(*) AS size, row_number() OVER (PARTITION BY x.cluster ORDER BY round(avg(list_cosine_similarity(x.v, y.v)), 9) DESC, x.position) AS k
  FROM linked x JOIN linked y USING (cluster) GROUP BY x.cluster, x.position) WHERE k = 1 AND size >= 2""",
        "topic_counts": _ASSIGNED + "SELECT * FROM kept",
        "representatives": _LIKEST,
        "collocations": _TERMS + """
s AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM docs) GROUP BY term),
p AS (SELECT x[1] AS a, x[2] AS b, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS x FROM docs) GROUP BY ALL HAVING count(*) >= 5)
SELECT a, b, round(score, 6) AS score FROM (SELECT a, b, (p.n - 5) * (SELECT count(*) FROM s) / (sa.n * sb.n) AS score FROM p JOIN s sa ON sa.term = a JOIN s sb ON sb.term = b) WHERE score > 10""",
        "class_tfidf": _TERMS + """
c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(w) AS term FROM docs) GROUP BY ALL),
z AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS size, sum(n) OVER (PARTITION BY term) AS f FROM c),
y AS (SELECT lang, term, round(n / size * ln(1 + (SELECT avg(s) FROM (SELECT sum(n) AS s FROM c GROUP BY lang)) / f), 9) AS score FROM z)
SELECT lang, term, rank FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term)::INTEGER AS rank FROM y) WHERE rank <= 5""",
        "centroids": "SELECT label, p::INTEGER - 1 AS p, round(avg(embedding[p]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(p) GROUP BY ALL",
        "medoids": """SELECT label, vec_id, round(s, 5) AS similarity FROM (
 SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS k FROM (
  SELECT a.label, a.vec_id, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b USING (label) GROUP BY ALL)) WHERE k = 1""",
        "assign_best": """SELECT vec_id, topic, round(s, 5) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, t) AS k FROM (
  SELECT a.vec_id, b.vec_id AS t, b.vec_id::VARCHAR AS topic, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE b.vec_id < 8)) WHERE k = 1""",
    }
