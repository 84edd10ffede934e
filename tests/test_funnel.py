import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import english as E
from millrace.operators import chunks, funnel
from millrace.operators import reviews as R
from millrace.sources import feeds, files

LEXICON = {"pet": ["dog", "pet - friendly", "cats and dogs"], "sea": ["boat"], "none": []}
EXCLUSIONS = {"sea": ["gravy boat"]}


def says(*words):
    """A classifier that says yes to each label whose word stands in the text."""
    return lambda: lambda texts: [[1.0 if w in t.lower() else -1.0 for w in words] for t in texts]


def test_keywords_lose_stop_words_as_texts_do():
    assert R.prepared_lexicon({"a": ["the cats and dogs", "boat", "the", "don't pet"], "b": 5}) == {"a": ["cats dogs", "boat", "don't pet"], "b": 5}


@pytest.mark.parametrize("text", ["The garden is very quiet", "Zimmer groß b2", "I don't know, it’s a pet-friendly room7!", "", "won't x_y"])
def test_plain_keyword_equals_the_expression(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(E.without_stop_words(F.col("x"))).first()[0]
    assert got == E.plain_keyword(text)


def test_counters(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",), ("a",), (None,)], "t string")
    assert tuple(R.counters(rows, "t").first()) == (6, 2, 2) and tuple(R.counters(rows.where("false"), "t").first()) == (0, 0, 0)


def results(spark, rows):
    kind = "original_id long, review string, review_cleaned string, chunk string, keywords_found string, bert_prediction struct<pet:string,sea:string>, status string"
    return spark.createDataFrame(rows, kind)


def test_export_and_complements(spark, tmp_path):
    rows = results(spark, [
        (1, "r", "c", "k", "dog, cats", ("yes", "no"), "kw_bert_agree"), (2, "r", "c", "k", "dog", ("no", "yes"), "x"), (3, "r", "c", "k", "wheel", ("yes", "no"), "x"),
        (4, "r", "c", "k", None, ("yes", "yes"), None), (5, "r", "c", "k", " boat ,, dog", ("yes", "yes"), None), (6, "r", "c", "k", "dog", None, None),
    ])
    out = R.category_export(rows, LEXICON | {"unknown": ["dog"]})
    assert sorted((r["category"], r["original_id"], r["status"]) for r in out.collect()) == [("pet", 1, "kw_bert_agree"), ("pet", 5, "unknown"), ("sea", 5, "unknown")]
    assert out.columns == ["category", *R.EXPORTED]
    reference = spark.createDataFrame([(i, "t", "u") for i in (1, 2, 5, None)], "id long, review string, review_cleaned string")
    rest = R.category_complements(reference, out, "id", "review", ["pet", "sea", "gone"])
    assert sorted((r["category"], r["original_id"]) for r in rest.collect()) == [("pet", 2), ("sea", 1), ("sea", 2)]
    assert R.category_export(rows, {}).count() == R.category_export(rows.where("false"), LEXICON).count() == 0
    files.write_csv(out, str(tmp_path / "x"), by="category")
    assert files.read_reviews(spark, str(tmp_path / "x" / "category=pet")).count() == 2 and not (tmp_path / "x" / "category=none").exists()


def test_status_of_structs(spark):
    rows = spark.sql("SELECT struct('yes' AS a) k, struct('yes' AS a) b UNION ALL SELECT struct('no'), struct('yes') UNION ALL SELECT null, null UNION ALL SELECT struct('no'), null")
    assert [r["status"] for r in R.with_status(rows, "k", "b").collect()] == ["kw_bert_agree", "kw_bert_disputed", "kw_bert_agree", "kw_bert_disputed"]
    assert [tuple(r) for r in R.histogram(rows.selectExpr("CAST(null AS string) AS status"), "status").collect()] == [("unknown", 4)]


def test_chunks_follow_the_rows_own_categories(spark):
    rows = spark.createDataFrame([(1, "a dog and a boat", "pet"), (2, "a dog and a boat", "sea pet"), (3, "a boat", "pet"), (4, "a boat", None)], "id int, t string, c string")
    out = chunks.chunked(rows, "t", LEXICON, EXCLUSIONS, 2, 1.1, category="c").collect()
    assert sorted((r["id"], r["chunk"]) for r in out) == [(1, "a dog"), (2, "a boat"), (2, "a dog")]


def test_the_whole_funnel(spark, tmp_path):
    rows = spark.createDataFrame([
        (1, "Our Dog's bed, see https://a.example/x"), (2, "Our Dog's bed, see https://a.example/x"), (3, None), (4, "gravy boat soup"), (5, "A boat and cats, and dogs!"),
        (6, "nothing here"), (7, "ein Boot"), (8, "pet friendly boat"),
    ], "id long, review string")
    made = funnel.run(rows, "id", "review", LEXICON, EXCLUSIONS, says("dog", "boat"), lambda: lambda t, k: "a boat" if "Boot" in t else t, length=6)
    got = sorted((r["original_id"], r["chunk"], r["keywords_found"], tuple(r["bert_prediction"]), r["status"]) for r in made.chunks.collect())
    assert got == [
        (1, "Our Dog s bed see", "dog", ("yes", "no"), "kw_bert_agree"),
        (5, "A boat and cats and dogs", "boat", ("yes", "yes"), "kw_bert_agree"), (5, "A boat and cats and dogs", "cats dogs", ("yes", "yes"), "kw_bert_agree"),
        (7, "a boat", "boat", ("no", "yes"), "kw_bert_agree"),
        (8, "pet friendly boat", "boat", ("no", "yes"), "kw_bert_disputed"), (8, "pet friendly boat", "pet friendly", ("no", "yes"), "kw_bert_disputed"),
    ]
    assert sorted((r["category"], r["original_id"]) for r in made.exported.collect()) == [("pet", 1), ("sea", 5), ("sea", 7), ("sea", 8)]
    assert sorted(r["original_id"] for r in made.complements.where("category = 'pet'").collect()) == [4, 5, 6, 7, 8]
    assert funnel.write(made, str(tmp_path / "out")) == {"kw_bert_agree": 4, "kw_bert_disputed": 2}
    assert spark.read.json(str(tmp_path / "out" / "results.json")).count() == 6


def stand_in():
    return lambda texts: [[1.0, 1.0] for _ in texts]


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "a dog"), (2, "a tree")], "id long, review string").coalesce(1).write.option("header", True).csv(str(tmp_path / "in.csv"))
    (tmp_path / "c.json").write_text(json.dumps({"pet": ["dog"], "sea": ["boat"]}))
    (tmp_path / "e.json").write_text("{}")
    funnel.main(["-i", str(tmp_path / "in.csv"), "--categories", str(tmp_path / "c.json"), "--exclusions", str(tmp_path / "e.json"), "--model", f"{__name__}:stand_in", "--output", str(tmp_path)])
    assert files.read_reviews(spark, str(tmp_path / "in" / "categories")).first()["category"] == "pet"
    assert files.read_reviews(spark, str(tmp_path / "in" / "complements")).first()["original_id"] == 2


def test_posts(spark):
    tree = {"type": "doc", "content": [{"type": "text", "text": "deep "}, {"body": [{"children": {"type": "text", "text": " words"}}]}, {"elements": None}]}
    records = [
        {"id": "1", "published_at": "2024-01-01T10:00:00Z", "space_name": "s", "tiptap_body": tree, "body_text": "no"},
        {"id": "2", "tiptap_body": {"content": []}, "body_trix_content": "<p> </p>", "truncated_content": "<b>a</b>&amp;b", "name": "n"},
        {"id": "3", "display_title": " title "}, {"id": "4", "space_name": ""}, {"id": "5", "published_at": "soon", "name": "n"},
    ]
    page = json.dumps({"records": records, "has_next_page": False})
    held = spark.createDataFrame([(page, "k"), ("broken", "k"), (None, "k")], "page string, kind string")
    got = sorted(tuple(r) for r in feeds.posts(held, "feed").collect())
    assert got == [("", "unknown", "a&b", "2", "feed"), ("", "unknown", "title", "3", "feed"), ("2024-01-01", "s", "deep words", "1", "feed"), ("soon", "unknown", "n", "5", "feed")]
    both = feeds.posts(held, "feed").unionByName(feeds.posts(held, "archive", "kind"))
    by_category, by_source = feeds.statistics(both)
    assert [tuple(r) for r in by_category.collect()] == [("k", 4), ("unknown", 3), ("s", 1)] and [tuple(r) for r in by_source.collect()] == [("archive", 4), ("feed", 4)]
    assert [(r["id"], r["x"]) for r in feeds.numbered(spark.createDataFrame([("b",), ("a",), ("c",)], "x string").repartition(3), ["x"]).collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_pages_stop():
    page = lambda n, more=True: json.dumps({"records": [n], "has_next_page": more})
    assert len(list(feeds.pages(lambda n: page(n, n < 4)))) == 4 and len(list(feeds.pages(page, 1, 2))) == 2
    assert list(feeds.pages(lambda n: None)) == list(feeds.pages(lambda n: json.dumps({"records": []}))) == []
    got = list(feeds.archive_pages(lambda s, n: page(s, n < 2), {"x": (7, "c"), "y": (8, "d")}, ["x", "gone"]))
    assert [c for c, _ in got] == ["c", "c"] and json.loads(got[0][1])["records"] == [7]


def test_reader_and_logger(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,review\n7,NA\n8,"a\nb"\n9,null\n')
    rows = files.read_reviews(spark, str(tmp_path / "r.csv"), missing=["NA", "null"], overrides={"id": "string"})
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("7", None), ("8", "a\nb"), ("9", None)]
    log = files.logger("millrace-test", str(tmp_path / "logs"))
    assert files.logger("millrace-test", str(tmp_path / "logs")) is log and len(log.handlers) == 2 and (tmp_path / "logs" / "millrace-test.log").exists()
