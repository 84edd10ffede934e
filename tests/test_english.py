import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import english as E
from millrace.operators import chunks, models, terms, vectors
from millrace.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("given, expected", [
    (None, None), ("", ""), ("Suite 101, 2nd floor", "Suite one hundred and one, twond floor"), ("0 stars", "zero stars"), ("007 1,000", "seven one,zero"),
    ("1234567", "one million, two hundred and thirty-four thousand, five hundred and sixty-seven"), ("1001", "one thousand and one"), ("9" * 40, "9" * 40),
])
def test_number_words(spark, given, expected):
    assert one(spark, given, E.number_words) == expected


@pytest.mark.parametrize("given, expected", [
    (None, None), ('we don\'t say "no" / never', "we don't say no never"), ("Anna's café-bar!!", "Anna s café bar"), ("IT’s let's", "IT’s let s"),
    ("mail bob@a.example please", "mail please"), ("see https://a.example/x now", "see now"),
])
def test_clean_review(spark, given, expected):
    assert one(spark, given, E.clean_review) == expected


def test_stop_words(spark):
    assert one(spark, "The garden is very quiet", E.without_stop_words) == "garden quiet"
    assert one(spark, "Zimmer groß b2", E.without_stop_words) == "zimmer"
    assert one(spark, "I don't know", lambda c: E.without_stop_words(c, True)) == "don't know"
    assert one(spark, "Don't, 3 dogs", E.letters_only) == ["dont", "dogs"] and one(spark, None, E.letters_only) == []
    assert one(spark, "the and der", E.language) == "en" and one(spark, None, E.language) == "unknown"
    assert [one(spark, x, E.iso_date) for x in ("2024-01-01T23:00:00-05:00", "soon", None)] == ["2024-01-01", "soon", ""]


@pytest.mark.parametrize("n, length, centre, expected", [(5, 10, 3, (0, 5)), (20, 6, 1, (0, 6)), (20, 6, 10, (7, 13)), (20, 6, 19, (14, 20)), (20, 5, 8, (15, 10))])
def test_window(spark, n, length, centre, expected):
    a, b = chunks.window(F.lit(n), F.lit(centre), length)
    assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).first()) == expected


def test_chunks(spark):
    rows = spark.createDataFrame([(1, "a b boat c d gravy boat e f g Boat h"), (2, "gravy boat"), (3, None), (4, "")], "id int, t string")
    out = chunks.chunked(rows, "t", {"sea": ["boat"]}, {"sea": ["gravy boat"]}, 4).collect()
    assert [(r["id"], r["chunk_no"], r["chunk"], r["kw_category"]["sea"]) for r in out] == [(1, 0, "a b boat c", "yes"), (1, 1, "f g Boat h", "yes")]
    assert len(chunks.chunked(rows, "t", {"sea": ["boat"]}, {}, 12, 0.75).where("id = 1").collect()) == 1  # all windows overlap


def test_terms(spark):
    rows = spark.createDataFrame([(i, ["red", "cat"] if i % 2 else ["blue", "dog"]) for i in range(12)], "id int, w array<string>")
    got = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(rows, "id", "w", 1, 1.0).collect()}
    assert len(got) == 24 and abs(got[1, "cat"] - 0.5**0.5) < 1e-9
    assert rows.select(terms.ngrams(F.col("w"), 1, 3)).first()[0] == ["blue", "dog", "blue dog"]
    topics, shape = terms.nmf(terms.tfidf(rows, "id", "w", 1, 1.0), "id", 2, 20)
    named = {r["id"]: r["dominant_topic"] for r in topics.collect()}
    assert shape.shape == (4, 2) and len({named[i] for i in range(0, 12, 2)}) == 1 and named[0] != named[1]
    assert {(r["a"], r["b"]) for r in terms.collocations(rows, "w", 2, 0.1).collect()} == {("red", "cat"), ("blue", "dog")}


def test_nmf_keeps_documents_without_terms(spark):
    rows = spark.createDataFrame([(i, ["red", "cat"] if i % 2 else ["blue", "dog"]) for i in range(12)] + [(12, []), (13, ["rare"]), (None, None)], "id int, w array<string>")
    got = {r["id"]: r for r in terms.nmf(terms.tfidf(rows, "id", "w", 5, 1.0), "id", 2, 3, keys=rows)[0].collect()}
    assert set(got) == {*range(14), None} and all(got[i]["topics"] == [0.0, 0.0] and got[i]["dominant_topic"] == 0 for i in (12, 13, None))


def test_lda_learns_from_all_documents(spark, monkeypatch):
    from pyspark.ml import clustering

    made, fit = [], clustering.LDA.fit
    monkeypatch.setattr(clustering.LDA, "fit", lambda self, data: made.append(self) or fit(self, data))
    texts = [[f"x{i}a", f"x{i}b"] if i % 2 else ["new", "york", "new"] for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(40, []), (41, None)], "id int, w array<string>")
    got = terms.lda(rows, "w", 2, 3).select("id", "w", "topics").collect()
    assert made[0].getSubsamplingRate() == 1.0 and made[0].getMaxIter() == 3 and len(got) == 42
    joined = {r["id"]: r["j"] for r in rows.select("id", terms.phrases(rows, "w", 5, 1.0)(F.col("w")).alias("j")).collect()}
    assert joined[0] == ["new_york", "new"] and joined[1] == ["x1a", "x1b"] and joined[40] == joined[41] == []


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "a", [0.0, 1.0]), (4, "b", [0.0, 0.0])], "id int, g string, v array<double>")
    best = {r["id"]: (r["topic"], r["score"]) for r in vectors.assign_best(rows, "v", [("x", [1, 0]), ("y", [0, 1])]).collect()}
    assert best[1] == ("x", 1.0) and best[3] == ("y", 1.0) and best[4] == ("x", 0.0)
    assert {r["g"]: r["id"] for r in vectors.medoids(rows, "g", "id", "v").collect()} == {"a": 2, "b": 4}
    assert vectors.agglomerative([[1, 0], [0.9, 0.1], [0, 1]]) == [0, 0, 1] and vectors.agglomerative([]) == []
    picks = spark.sql("SELECT 0.4D e, 0.9D t UNION ALL SELECT 0.39D, 0.08D UNION ALL SELECT 0.3D, 0.05D").select(vectors.hybrid(F.col("e"), F.lit("E"), F.col("t"), F.lit("T")).alias("x")).collect()
    assert [tuple(r["x"]) for r in picks] == [("E", 0.4, "embedding"), ("T", 0.08, "tfidf"), ("No dominant need", 0.3, "none")]


def test_models_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good"), (2, None)], "id int, t string")
    out = models.classify(rows, "t", ["x", "y"], lambda: lambda texts: [[1.0, -1.0] if t else [0.0, 0.0] for t in texts]).collect()
    assert [tuple(r["prediction"]) for r in out] == [("yes", "no"), ("yes", "yes")]
    answer = 'so {"topics":["a",{"topic":"b","justification":"c"},["z"]]} done'
    assert one(spark, answer, models.answer_topics) == ["a", "b : c"] and one(spark, None, models.answer_topics) == []
    moved = models.translate(rows, "t", F.lit("de"), lambda: lambda t, k: t.upper()).collect()
    assert {r["id"]: r["t"] for r in moved} == {1: "GOOD", 2: None}
    quoted = spark.createDataFrame([(1, 'a "b"\nc', "s")], "id int, t string, category string")
    files.write_csv(quoted, str(tmp_path / "x"))
    assert files.read_reviews(spark, str(tmp_path / "x")).first()["t"] == 'a "b"\nc' and files.count_matches(spark, str(tmp_path / "x"), 1)
    pages = files.feed_from(lambda n: json.dumps({"records": [{"id": str(n)}], "has_next_page": n < 3}))
    got = files.feed_posts(spark.createDataFrame([(p,) for p in [*pages, "broken"]], "page string")).select("id").collect()
    assert [r[0] for r in got] == ["1", "2", "3"] and files.output_folder("a/b.csv") == "results/pipeline/b"
