import re

from pyspark.sql import functions as F

from millrace.functions import english as E
from millrace.functions import text as T
from millrace.operators import reviews as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_clean_characters(spark):
    for given, expected in (
        (None, None), ("Anna's café-bar!!", "Anna s café bar"), ("see https://a.example/x now", "see now"),
        ("mail bob@a.example please", "mail please"), ("nice #trip here", "nice here"),
    ):
        assert one(spark, given, E.clean_characters) == expected


def test_patterns():
    assert not re.search(T.keyword_pattern("dog"), "doggy")
    assert T.normalised_keyword("pet - friendly") == "pet-friendly"
    for text in ("pet friendly", "carpet friendly", "pet-friendly"):
        assert re.search(T.keyword_pattern("pet-friendly"), text)


def test_extract(spark):
    rows = spark.createDataFrame([(1, "boat deck  chair"), (2, "gravy boat soup"), (3, "gravy boat near boat"), (4, ""), (5, None)], "id int, t string")
    out = R.extract(rows, {"sea": ["boat", "deck chair"]}, {"sea": ["gravy boat"]}, "t").select("id", "keywords_found").collect()
    assert sorted(map(tuple, out)) == [(1, "boat, deck chair"), (3, "boat")]


def test_complement_and_dedup(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert sorted(r[0] for r in R.complement(ids(1, 2, 3, None), ids(2, 2), "id").collect()) == [1, 3]
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, "b")], "id int, t string")
    assert sorted(r[0] for r in R.distinct_texts(rows, "id", "t").collect()) == [1, 4]


def test_overlap(spark):
    got = spark.sql("SELECT array(1,2,3) a, array(3,4) b, array(1,1,2) c, array(1,2) d, array() e").select(
        T.overlap(F.col("a"), F.col("b")), T.overlap(F.col("c"), F.col("d")), T.overlap(F.col("e").cast("array<int>"), F.col("d"))
    ).first()
    assert tuple(got) == (0.5, 1.0, 0.0)
    assert one(spark, "<p>a</p><p>b&nbsp;&amp;lt;</p>", T.strip_tags) == "ab <"


def test_extract_finds_keywords_that_blanking_makes(spark):
    rows = spark.createDataFrame([(1, "mo ther thonther"), (2, "xther thonther"), (3, "bigravy boatboat"), (4, "gravy boat")], "id int, t string")
    made = R.extract(rows, {"place": ["ther"], "sea": ["boat"]}, {"place": ["ther thon"], "sea": ["gravy boat"]}, "t").select("id", "category", "keywords_found")
    assert sorted(map(tuple, made.collect())) == [(1, "place", "ther"), (2, "place", "ther"), (3, "sea", "boat")]
