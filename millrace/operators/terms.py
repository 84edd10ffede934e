"""Term statistics and topics: TF-IDF, discriminative terms, collocations, class TF-IDF, NMF, LDA."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.storage import clear, discard, materialise


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """Runs of ``low`` to ``high`` words, joined by spaces."""
    def runs(held: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(held) - n + 1), lambda i: F.array_join(F.slice(held, i, n), " "))
        return F.when(F.size(held) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(words, lambda held: F.concat(*[held if n == 1 else runs(held, n) for n in range(low, high + 1)]))


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every term of a column of lists, without nulls, and the terms by code."""
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    held = lists.flatten().dictionary_encode()
    code = pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return row[code >= 0], code[code >= 0], held.dictionary


def _slices(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` terms (one row at least) of a batch of keys and lists, so that memory doesn't follow the batch."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield batch.slice(start, end - start)
        start = end


def _counted(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (row, code), sorted, with their counts; codes are below ``n``."""
    found, tf = np.unique(row * max(n, 1) + code, return_counts=True)
    return found // max(n, 1), found % max(n, 1), tf


def _once(rows: DataFrame, key: str) -> bool:
    """Whether every key has one row only, so that a row's terms are counted where it lies."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0


def _gathered(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """__key, __terms: a row for each key, with the terms of all its rows."""
    held = rows.select(F.col(key).alias("__key"), F.col(terms).alias("__terms"))
    return held if _once(rows, key) else held.groupBy("__key").agg(F.flatten(F.collect_list(F.coalesce("__terms", F.array().cast("array<string>")))).alias("__terms"))


def row_counts(held: DataFrame) -> DataFrame:
    """__key, term, tf of rows of __key and __terms, whose keys are unique; nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for b in _slices(batch):
                row, code, names = _coded(b.column(1))
                at, term, tf = _counted(row, code, len(names))
                for i in range(0, len(at), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[j])), names.take(pa.array(term[j])), pa.array(tf[j], pa.int64())], ["__key", "term", "tf"])

    return held.mapInArrow(run, f"__key {held.schema['__key'].dataType.simpleString()}, term string, tf long")


def _vocabulary(held: DataFrame, total: int, min_df: int, max_df: float, max_features: int) -> tuple[list[str], np.ndarray]:
    """The terms of most occurrences (ties by term), in order, and their smooth idf."""

    def run(batches):
        for batch in batches:
            for b in _slices(batch):
                row, code, names = _coded(b.column(1))
                term = _counted(row, code, len(names))[1]
                df, cf = np.bincount(term, minlength=len(names)), np.bincount(code, minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(df, pa.int64()), pa.array(cf, pa.int64())], ["term", "df", "cf"])

    # dealt by term before they are added up: a task that adds up what it reads would hold most of its own pairs of words
    found = held.mapInArrow(run, "term string, df long, cf long").repartition(F.col("term")).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    kept = found.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * total)).orderBy(F.desc("cf"), "term").limit(max_features)
    df = {r["term"]: r["df"] for r in kept.collect()}
    names = sorted(df)
    return names, np.array([np.log((1 + total) / (1 + df[x])) + 1 for x in names])


def vectors(rows: DataFrame, key: str, terms: str, min_df: int = 5, max_df: float = 0.9, max_features: int = 10_000) -> tuple[DataFrame, list[str]]:
    """key, i, w of every key that has a term, and the terms: ``tfidf`` with bounded ``max_features``, packed.

    i holds the terms' numbers as 32-bit integers, w their weights as doubles,
    both as bytes. Where keys are unique nothing but counts by term is shuffled.
    """
    held = _gathered(rows, key, terms)
    names, idf = _vocabulary(held, rows.count(), min_df, max_df, max_features)
    known = pa.array(names, pa.string())

    def run(batches):
        for batch in batches:
            for b in _slices(batch):
                row, code, found = _coded(b.column(1))
                to = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                code = to[code]
                at, term, tf = _counted(row[code >= 0], code[code >= 0], len(known))
                x = tf * idf[term]
                x /= np.sqrt(np.bincount(at, x * x, len(b)))[at]
                here, start = np.unique(at, return_index=True)
                ends = np.append(start, len(at))
                packed = lambda v: pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(v)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(here)), packed(term.astype(np.int32)), packed(x)], ["__key", "i", "w"])

    kind = held.schema["__key"].dataType.simpleString()
    return held.mapInArrow(run, f"__key {kind}, i binary, w binary").withColumnRenamed("__key", key), names


def tfidf(rows: DataFrame, key: str, terms: str, min_df: int = 5, max_df: float = 0.9, max_features: int | None = None) -> DataFrame:
    """key, term, weight: smooth idf ln((1+N)/(1+df))+1, rows of length one.

    ``terms`` is an array column. N counts all rows. With ``max_features`` only
    the terms of most occurrences stay (ties by term).
    """
    if max_features:
        packed, names = vectors(rows, key, terms, min_df, max_df, max_features)
        return unpacked(packed, key, names)
    # counted where the rows lie; one exchange by term serves document frequencies, one by key the norms
    total = rows.agg(F.count("*").alias("total"))
    counts = row_counts(_gathered(rows, key, terms)).withColumn("df", F.count("*").over(Window.partitionBy("term")))
    kept = counts.join(F.broadcast(total), F.lit(True)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("total")))  # one row
    raw = kept.select(F.col("__key").alias(key), "term", (F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("raw") / norm).select(key, "term", "weight")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of every entry of a batch of ``vectors``."""
    def flat(name, kind):
        col = batch.column(batch.schema.get_field_index(name))
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
        size = np.dtype(kind).itemsize
        return np.diff(ends) // size, np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)

    sizes, at = flat("i", np.int32)
    return np.repeat(np.arange(len(sizes)), sizes), at, flat("w", np.float64)[1]


def unpacked(packed: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, term, weight of ``vectors``."""
    known = pa.array(names, pa.string())

    def run(batches):
        for b in batches:
            row, at, x = _entries(b)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), known.take(pa.array(at)), pa.array(x)], ["__key", "term", "weight"])

    kind = packed.schema[key].dataType.simpleString()
    return packed.mapInArrow(run, f"__key {kind}, term string, weight double").withColumnRenamed("__key", key)


def discriminative(rows: DataFrame, key: str, terms: str, inside: Column, **limits) -> DataFrame:
    """term, score_in, score_out (mean TF-IDF over either side), ratio with a floor of 1e-6."""
    sides = rows.withColumn("__in", F.coalesce(inside, F.lit(False)))
    sizes = sides.agg(F.sum(F.col("__in").cast("long")).alias("n_in"), F.sum((~F.col("__in")).cast("long")).alias("n_out"))
    sums = tfidf(sides, key, terms, **limits).join(sides.select(key, "__in"), key).groupBy("term").agg(
        F.sum(F.when(F.col("__in"), F.col("weight")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("__in"), 0.0).otherwise(F.col("weight"))).alias("b")
    )
    means = sums.join(F.broadcast(sizes), F.lit(True)).select(
        "term", (F.col("a") / F.greatest("n_in", F.lit(1))).alias("score_in"), (F.col("b") / F.greatest("n_out", F.lit(1))).alias("score_out")
    )
    return means.withColumn("ratio", F.col("score_in") / F.greatest("score_out", F.lit(1e-6)))


def discriminants(table: DataFrame, least_ratio: float = 1.5, n: int = 80) -> DataFrame:
    """The ``n`` terms of ``discriminative`` with the largest inside score among those of the ratio or more (ties by term), with rank."""
    first = table.where(F.col("ratio") >= least_ratio).orderBy(F.desc(F.round("score_in", 12)), "term").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score_in", 12)), "term")))  # n rows


def _adjacent(rows: DataFrame, words: str) -> tuple[DataFrame, DataFrame]:
    """(a, b, n_ab of adjacent words, those that end a row with a null b; w, n of each word)."""
    # one pass: each word with its successor, the last one with none, so that words are counted by summing over successors
    def run(batches):
        for batch in batches:
            for b in _slices(batch):
                lists = b.column(1)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                held = lists.flatten().dictionary_encode()
                names = pa.concat_arrays([held.dictionary, pa.nulls(1, held.dictionary.type)])
                first = pc.fill_null(held.indices, len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                second = np.append(first[1:], len(names) - 1)[: len(first)]
                second[np.cumsum(size)[size > 0] - 1] = len(names) - 1
                x, y, n = _counted(first, second, len(names))
                for i in range(0, len(n), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(x[j])), names.take(pa.array(y[j])), pa.array(n[j], pa.int64())], ["a", "b", "n"])

    counts = materialise(rows.select(F.lit(0), F.col(words)).mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n_ab")))
    single = counts.groupBy(F.col("a").alias("w")).agg(F.sum("n_ab").alias("n"))
    return counts, single


def _scored(counts: DataFrame, single: DataFrame, min_count: int, threshold: float) -> DataFrame:
    """a, b, score of ``collocations``."""
    size = single.agg(F.count("*").alias("v"))
    pairs = counts.where(F.col("b").isNotNull() & (F.col("n_ab") >= min_count))
    one = lambda x: single.select(F.col("w").alias(x), F.col("n").alias("n_" + x))
    score = (F.col("n_ab") - min_count) * F.col("v") / (F.col("n_a") * F.col("n_b"))
    return pairs.join(one("a"), "a").join(one("b"), "b").join(F.broadcast(size), F.lit(True)).select("a", "b", score.alias("score")).where(F.col("score") > threshold)


def collocations(rows: DataFrame, words: str, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """a, b, score of adjacent words with (n_ab - min_count) * vocabulary / (n_a * n_b) over the threshold."""
    return _scored(*_adjacent(rows, words), min_count, threshold)


def class_tfidf(rows: DataFrame, group: str, terms: str, n: int = 5) -> DataFrame:
    """The ``n`` terms of each group with the largest tf * ln(1 + A / f); A: words per group, f: a term's count overall."""
    counts = rows.select(group, F.explode_outer(terms).alias("term")).where("term IS NOT NULL").groupBy(group, "term").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    overall = counts.groupBy("term").agg(F.sum("n").alias("f"))
    average = sizes.agg(F.avg("size").alias("avg"))
    scored = counts.join(sizes, group).join(overall, "term").join(F.broadcast(average), F.lit(True)).select(
        group, "term", (F.col("n") / F.col("size") * F.log(1 + F.col("avg") / F.col("f"))).alias("score")
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def _solved(batch: pa.RecordBatch, h: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight of every entry; topic weights of every row) of a batch under topics ``h``, by multiplicative steps."""
    row, at, x = _entries(batch)
    n = len(batch)
    target = np.stack([np.bincount(row, x * part[at], n) for part in h], 1)
    gram = h @ h.T
    w = np.full((n, len(h)), 1.0 / len(h))
    for _ in range(inner):
        w *= target / (w @ gram + 1e-12)
    return row, at, x, w


def nmf(weights: DataFrame, key: str, k: int = 8, rounds: int = 30, inner: int = 20, seed: int = 42, keys: DataFrame | None = None) -> tuple[DataFrame, pd.DataFrame]:
    """``nmf_of_vectors`` of the long form of ``tfidf`` with bounded ``max_features``."""
    names = sorted(r[0] for r in weights.select("term").distinct().collect())
    index = weights.sparkSession.createDataFrame(pd.DataFrame({"term": names, "i": range(len(names))}), "term string, i int")
    held = weights.join(F.broadcast(index), "term").groupBy(key).agg(F.collect_list(F.struct("i", "weight")).alias("v"))  # max_features rows

    def run(batches):
        for b in batches:
            lists = b.column(1)
            pack = lambda f, t: [np.asarray([x[f] for x in v], t).tobytes() for v in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack("i", np.int32), pa.binary()), pa.array(pack("weight", np.float64), pa.binary())], ["__key", "i", "w"])

    kind = weights.schema[key].dataType.simpleString()
    packed = held.mapInArrow(run, f"__key {kind}, i binary, w binary").withColumnRenamed("__key", key)
    return nmf_of_vectors(packed, names, key, k, rounds, inner, seed, keys)


def nmf_of_vectors(
    packed: DataFrame, names: list[str], key: str, k: int = 8, rounds: int = 30, inner: int = 20, seed: int = 42, keys: DataFrame | None = None
) -> tuple[DataFrame, pd.DataFrame]:
    """Topic weights per key (key, topics, dominant_topic) and the topics (term by topic) of ``vectors``.

    With ``keys`` there is one row for each of its rows: keys without a weight,
    whose texts hold none of the terms, get zeros and topic 0. The number of
    topics is ``clamped`` by the number of keys.

    Only the topics, k by terms, reach the driver; the packed rows are written
    once and solved anew against the topics in each round, summed per partition
    and then per topic.
    """
    held_rows = materialise(packed)
    k = clamped(k, (keys if keys is not None else held_rows.select(key)).limit(max(k, 1)).count())
    h = np.random.default_rng(seed).uniform(0.1, 1.0, (k, len(names)))

    for _ in range(rounds if names else 0):
        def sums(batches, held=h):
            up, gram = np.zeros_like(held), np.zeros((k, k))
            for b in batches:
                row, at, x, w = _solved(b, held, inner)
                for t in range(k):
                    up[t] += np.bincount(at, x * w[row, t], held.shape[1])
                gram += w.T @ w
            rows = list(np.hstack([up, gram]))
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["t", "x"])

        def total(t, f):
            return pd.DataFrame({"t": [t[0]], "x": [np.sum(np.stack(f["x"].to_numpy()), 0)]})

        got = held_rows.select("i", "w").mapInArrow(sums, "t int, x array<double>").groupBy("t").applyInPandas(total, "t int, x array<double>").collect()
        full = np.array([r["x"] for r in sorted(got, key=lambda r: r["t"])])
        h = h * full[:, : h.shape[1]] / (full[:, h.shape[1] :] @ h + 1e-12)

    def final(batches):
        for b in batches:
            w = _solved(b, h, inner)[3]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(w), pa.list_(pa.float64())), pa.array(w.argmax(1), pa.int32())], [key, "topics", "dominant_topic"])

    kind = packed.schema[key].dataType.simpleString()
    out = held_rows.mapInArrow(final, f"{key} {kind}, topics array<double>, dominant_topic int")
    if keys is not None:
        named = out.withColumnRenamed(key, "__key")
        out = keys.select(key).join(named, F.col(key).eqNullSafe(F.col("__key")), "left").select(
            key, F.coalesce("topics", F.array_repeat(F.lit(0.0), k)).alias("topics"), F.coalesce("dominant_topic", F.lit(0)).alias("dominant_topic")
        )
    return out, pd.DataFrame(h.T, index=names)


def clamped(k: int, n: int) -> int:
    """A number of topics between 1 and the number of documents."""
    return max(1, min(k, n))


def topic_words(topics: pd.DataFrame, n: int = 10) -> list[tuple[int, int, str, float]]:
    """(topic, rank, word, weight) of the ``n`` heaviest words of each topic; ``topics`` is term by topic, ties go by word."""
    out = []
    for t in topics.columns:
        first = sorted(topics[t].items(), key=lambda x: (-x[1], x[0]))[:n]
        out += [(int(t), k + 1, w, float(x)) for k, (w, x) in enumerate(first)]
    return out


def topic_report(words: list[tuple[int, int, str, float]]) -> list[str]:
    """Lines of a report: each topic's words with weights of three decimals."""
    lines = ["===== TOP WORDS PER TOPIC =====", ""]
    for t in sorted({w[0] for w in words}):
        lines += [f"--- Topic {t} ---", *(f"{w} ({x:.3f})" for topic, _, w, x in words if topic == t), "-" * 30]
    return lines


def topic_label(category: str, topic: Column) -> Column:
    """<category>_T<topic>."""
    return F.format_string("%s_T%d", F.lit(category), topic)


def phrase_pairs(rows: DataFrame, words: str, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """a, b: the adjacent words that score over the threshold, written.

    The score is that of ``collocations``, but the vocabulary counts the
    distinct pairs besides the distinct words, as gensim's Phrases does.
    """
    counts, single = _adjacent(rows, words)
    n_pairs, n_words = counts.where("b IS NOT NULL").count(), single.count()
    out = materialise(_scored(counts, single, min_count, threshold * (max(n_words, 1) / max(n_words + n_pairs, 1))).select("a", "b"))
    discard(counts)
    clear(rows.sparkSession)
    return out


def phrases(rows: DataFrame, words: str, min_count: int = 5, threshold: float = 10.0) -> Callable[[Column], Column]:
    """A function that joins the ``phrase_pairs`` by an underscore, from the left and without overlap.

    The driver and each worker hold the pairs; ``lda_with_words`` joins them
    where the documents lie instead.
    """
    pairs = phrase_pairs(rows, words, min_count, threshold)
    held = {(r["a"], r["b"]) for r in pairs.collect()}
    discard(pairs)
    known = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("array<string>")
    def joined(lists: pd.Series) -> pd.Series:
        def one(ws):
            out, i = [], 0
            ws = [] if ws is None else list(ws)
            while i < len(ws):
                n = 2 if tuple(ws[i : i + 2]) in known.value else 1
                out.append("_".join(ws[i : i + n]))
                i += n
            return out

        return lists.map(one)

    return joined


def lda(rows: DataFrame, words: str, k: int = 8, passes: int = 20, vocabulary: int = 2**31 - 1, seed: int = 42) -> DataFrame:
    """All columns with topics and dominant_topic of ``lda_with_words``."""
    return lda_with_words(rows, words, k, passes, vocabulary, seed)[0]


def lda_with_words(rows: DataFrame, words: str, k: int = 8, passes: int = 20, vocabulary: int = 2**31 - 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """All columns with topics and dominant_topic by online LDA (``DealtLDA``) over words and joined pairs (``phrase_pairs``); and each topic's ten words.

    The second frame has topic, rank, word, weight. Each of the ``passes`` takes
    every document once. A document without a word has no topic: its
    dominant_topic is null.
    """
    from millrace.operators.lda import DealtLDA

    held = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))
    # the default rate would take 5 % of the documents a pass
    made = DealtLDA(k=k, maxIter=passes, seed=seed, featuresCol=words, optimizer="online", subsamplingRate=1.0)
    made.pairs, made.vocabulary = phrase_pairs(held, words), vocabulary
    model = made.fit(held)
    discard(made.pairs)
    best = (F.array_position("topics", F.array_max("topics")) - 1).cast("int")
    found = model.topics.select("__row", "topics", F.when(F.col("n") > 0, best).alias("dominant_topic"))
    return held.join(found.hint("merge"), "__row").drop("__row"), model.words
