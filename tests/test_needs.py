import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import english as E
from millrace.operators import lda, needs, terms, vectors
from millrace.sources import files


@pytest.mark.parametrize("given, expected", [
    ("cities boxes dogs glass was children stopped walking cried bus - stop", "city box dog glass be child stop walk cry bus-stop"), (None, ""), ("", ""),
])
def test_lemmas(spark, given, expected):
    assert spark.createDataFrame([(given,)], "x string").select(E.lemmas(F.col("x"))).first()[0] == expected


def test_without_words(spark):
    got = spark.createDataFrame([("  The  the\tpool ",), (None,)], "x string").select(E.without_words(F.col("x"), ["the"])).collect()
    assert [r[0] for r in got] == ["The pool", ""]


def test_prompts_and_raw_topics(spark):
    rows = spark.createDataFrame([(i, f'say "{i}" 100%', "k" if i < 5 else None) for i in range(8)] + [(9, None, "k")], "id int, t string, kw string")
    asked = needs.prompts(rows, "id", "t", "kw", "pets", 3)
    got = {(r["kw"], r["batch"]): r["prompt"] for r in asked.collect()}
    assert set(got) == {("k", 0), ("k", 1), ("misc", 0)} and json.dumps(['say "3" 100%', 'say "4" 100%'], separators=(",", ":")) in got["k", 1] and "(pets)" in got["k", 1]

    def load():
        def model(prompt):
            if 'say \\"5' in prompt:
                raise ValueError
            return 'x {"topics": ["b", "a", {"topic": "c", "justification": "d"}]}' if 'say \\"0' in prompt else '{"topics": ["a", "e"]}'
        return model

    found = needs.raw_topics(asked, "kw", load).orderBy("position").collect()
    assert [tuple(r) for r in found] == [("b", 0), ("a", 1), ("c : d", 2), ("e", 3)]
    assert needs.with_keywords(rows.drop("kw"), "kw").first()["kw"] == "misc"
    vectors_of = needs.embedded(spark.createDataFrame([("abc",), ("ab",), (None,), ("bad",)], "t string"), "t", lambda: lambda t: [1.0, 1 / (t != "bad")], 2)
    assert [r["vector"] for r in vectors_of.collect()] == [[1.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def linkage(v, least):
    """Complete linkage one merge at a time over the list of clusters."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        far = {(a, b): max(1 - u[i] @ u[j] for i in groups[a] for j in groups[b]) for a in range(len(groups)) for b in range(a)}
        (a, b), d = min(far.items(), key=lambda x: x[1])
        if not d < 1 - least:
            break
        groups[b] += groups.pop(a)
    return {frozenset(g) for g in groups}


def test_clusters_equal_linkage_by_hand(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 3)) + 0.3
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [0.0] * 3)], "k long, v array<double>")
    for least in (0.5, 0.85):
        got: dict[int, set] = {}
        for r in needs.clusters(rows, "k", "v", least).collect():
            got.setdefault(r["cluster"], set()).add(r["k"])
        assert {frozenset(g) for g in got.values()} == linkage(v, least)
        kept = {r["cluster"]: (r["k"], r["size"]) for r in needs.reduced_topics(rows, "k", "v", least, 3).collect()}
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        for c, members in got.items():
            if len(members) >= 3:
                order = sorted(members)
                best = max(order, key=lambda i: (round(float(np.mean([u[i] @ u[j] for j in order])), 9), -i))
                assert kept.pop(c) == (best, len(members))
        assert not kept
    assert needs.clusters(rows.where("false"), "k", "v").count() == 0


def weights_by_hand(texts, most=None):
    """TF-IDF of words and pairs without stop words, rows of length one."""
    docs = []
    for t in texts:
        w = [x for x in t.lower().split() if len(x) > 1 and x not in E.STOP_WORDS]
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(x for d in docs for x in d)
    out = []
    for d in docs:
        raw = {x: n * (math.log((1 + len(docs)) / (1 + df[x])) + 1) for x, n in d.items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        out.append({x: v / norm for x, v in raw.items()})
    return out


def dot(a, b):
    return sum(v * b.get(x, 0.0) for x, v in a.items())


def test_assignment_and_representatives(spark):
    topics = [("quiet garden", [1.0, 0.0]), ("dog bed", [0.0, 1.0])]
    texts = ["a quiet garden for us", "big dog bed here", "dog bed dog bed", "nothing of this", "the and", "our dog sleeps", "garden quiet garden", "quiet garden quiet garden"]
    vs = [[0.9, 0.1], [0.1, 0.2], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [-1.0, 0.1], [1.0, 0.0], [1.0, 0.0]]
    rows = spark.createDataFrame(list(zip(range(8), texts, vs)), "id long, t string, v array<double>")
    held = spark.createDataFrame([(i, *x) for i, x in enumerate(topics)], "position long, topic string, vector array<double>")
    w = weights_by_hand(texts + [t for t, _ in topics])
    want = {}
    for i, v in enumerate(vs):
        n = math.hypot(*v)
        emb = [sum(a * b for a, b in zip(v, x)) / n if n else 0.0 for _, x in topics]
        tf = [dot(w[i], w[len(texts) + k]) for k in range(2)]
        e, c = int(np.argmax(emb)), int(np.argmax(tf))
        want[i] = (topics[e][0], "embedding", emb[e]) if emb[e] >= 0.95 else (topics[c][0], "tfidf", tf[c]) if tf[c] >= 0.08 else (needs.NO_NEED, "none", max(emb[e], tf[c]))
    assigned = needs.assign(rows, "id", "t", "v", held, 0.95, 0.08)
    got = {r["id"]: r for r in assigned.collect()}
    assert {i: (r["assigned_topic"], r["method"]) for i, r in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(abs(got[i]["score"] - x[2]) < 6e-4 for i, x in want.items()) and {"embedding", "tfidf", "none"} == {x[1] for x in want.values()}
    counts = Counter(x[0] for x in want.values() if x[0] != needs.NO_NEED)
    assert [tuple(r) for r in needs.topic_counts(assigned, 2).collect()] == sorted(((t, n) for t, n in counts.items() if n >= 2), key=lambda x: (-x[1], x[0]))
    found = needs.representatives(assigned, "id", 2, 2)
    by = {}
    for r in found.collect():
        by.setdefault(r["assigned_topic"], []).append((r["rank"], r["review"], r["tfidf_score"]))
    for topic in by:
        mine = [i for i, x in want.items() if x[0] == topic]
        own = weights_by_hand([texts[i] for i in mine] + [topic])
        scores = sorted(((-round(dot(own[k], own[-1]), 9), i) for k, i in enumerate(mine)))[:2]
        assert [(k, t) for k, t, _ in sorted(by[topic])] == [(k + 1, texts[i]) for k, (_, i) in enumerate(scores)]
        assert all(abs(x[2] + s) < 6e-4 for x, (s, _) in zip(sorted(by[topic]), scores))
    assert len(by) == 2 and [r["count"] for r in needs.summary(found).collect()] == sorted(counts.values(), reverse=True)
    assert needs.assign(rows, "id", "t", "v", held.where("false")).where(F.col("assigned_topic") == needs.NO_NEED).count() == 8


def test_topic_words_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["red", "cat"] if i % 2 else ["blue", "dog"], i % 2 == 1) for i in range(12)], "id int, w array<string>, inside boolean")
    topics = terms.nmf(terms.tfidf(rows, "id", "w", 1, 1.0), "id", 2, 20)[1]
    words = terms.topic_words(topics, 2)
    assert {frozenset(w for t, _, w, _ in words if t == k) for k in (0, 1)} == {frozenset(("red", "cat")), frozenset(("blue", "dog"))}
    lines = terms.topic_report(words)
    assert lines[0] == "===== TOP WORDS PER TOPIC =====" and lines[2] == "--- Topic 0 ---" and len(lines) == 10
    files.write_lines(spark, lines, str(tmp_path / "words"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "words")).collect()] == lines
    table = terms.discriminative(rows, "id", "w", F.col("inside"), min_df=1, max_df=1.0)
    chosen = terms.discriminants(table)
    assert [tuple(r) for r in chosen.select("rank", "term").orderBy("rank").collect()] == [(1, "cat"), (2, "red")] and terms.discriminants(table, 1.5, 1).count() == 1
    files.write_terms(table, chosen, "pet", str(tmp_path))
    assert [tuple(r) for r in files.read_reviews(spark, str(tmp_path / "pet_discriminant")).collect()] == [("pet", "cat"), ("pet", "red")]
    assert files.read_reviews(spark, str(tmp_path / "pet_ratio")).count() == files.read_reviews(spark, str(tmp_path / "pet_tfidf")).count() == 4
    files.write_array(chosen.select("rank", "term"), str(tmp_path / "a" / "x.json"))
    assert json.loads((tmp_path / "a" / "x.json").read_text()) == [{"rank": 1, "term": "cat"}, {"rank": 2, "term": "red"}]
    assert spark.range(1).select(terms.topic_label("pet", F.lit(3))).first()[0] == "pet_T3" and terms.clamped(8, 3) == 3 and terms.clamped(8, 0) == 1
    out, found = terms.lda_with_words(rows, "w", 2, 3)
    assert out.where("dominant_topic IS NULL").count() == 0 and found.count() == 2 * min(10, 4) and found.where("rank = 1").count() == 2
    assert vectors.MOST_TOPICS == 2000


def test_density_topics(spark):
    from millrace.operators import density

    rng = np.random.default_rng(5)
    blobs = [rng.normal(c, 0.05, (n, 2)) for c, n in (((0, 0), 60), ((5, 5), 40), ((9, 0), 8))]
    points = [*np.vstack(blobs).tolist(), [3.0, -7.0], [20.0, 20.0]]
    rows = spark.createDataFrame(list(enumerate(points)), "k long, p array<double>")
    got = {r["k"]: r["topic"] for r in density.clusters(rows, "k", "p", 0.15, 4, 15).collect()}
    assert len(got) == len(points) and all(got[i] == -1 for i in range(100, 110))
    assert Counter(got[i] for i in range(60))[0] > 50 and Counter(got[i] for i in range(60, 100))[1] > 30
    assert {r["topic"]: r["n"] for r in density.sizes(density.clusters(rows, "k", "p", 0.15, 4, 15)).collect()} == Counter(got.values())
    assert density.clusters(rows.where("false"), "k", "p", 0.15).count() == 0
    flat = density.reduced(spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(9)] + [(9, None)], "k long, v array<double>"), "k", "v", 2)
    assert flat.count() == 9 and len(flat.first()["point"]) == 2


def test_terms_are_counted_where_rows_lie(spark):
    rows = spark.createDataFrame([(i, ["red", "cat", "red"] if i % 2 else ["blue", "dog"]) for i in range(8)] + [(8, None), (9, [])], "id int, w array<string>")
    plan = terms.row_counts(rows.select(F.col("id").alias("__key"), F.col("w").alias("__terms")))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    packed, names = terms.vectors(rows, "id", "w", 1, 1.0, 3)
    assert names == ["blue", "cat", "red"] and "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    # repeated keys are still one row of weights
    twice = rows.unionByName(rows)
    for most in (None, 10):
        for table, times in ((rows, 1), (twice, 2)):
            got = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(table, "id", "w", 1, 1.0, most).collect()}
            n, df = 10 * times, 4
            idf = math.log((1 + n) / (1 + df)) + 1
            assert set(got) == {(i, t) for i in range(8) for t in (("red", "cat") if i % 2 else ("blue", "dog"))}
            assert abs(got[1, "red"] - 2 / math.sqrt(5)) < 1e-12 and abs(got[0, "dog"] - 1 / math.sqrt(2)) < 1e-12 and idf > 0
    pairs = spark.createDataFrame([(["a", "b", "a", "b"],)] * 3 + [(["c"],), ([],), (None,), (["b"],)], "w array<string>")
    found = {(r["a"], r["b"]): r["score"] for r in terms.collocations(pairs, "w", 1, 0.0).collect()}
    assert found == {("a", "b"): 5 * 3 / (6 * 7), ("b", "a"): 2 * 3 / (6 * 7)}


def test_representatives_carry_no_texts_through_ranks(spark):
    assigned = spark.createDataFrame([(i, f"garden {'quiet ' * i}", "quiet garden") for i in range(6)], "id long, review string, assigned_topic string")
    found = needs.representatives(assigned, "id", 2, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2 and not any("Window" in line and "review" in line for line in plan.splitlines())
    assert "Join LeftOuter" in plan and "review" not in plan.split("Window", 1)[1].split("Relation")[0]


def lda_by_hand(docs, k, passes, seed):
    """(topics of each document, weights by word) with one dense matrix, a document at a time."""
    words = sorted({w for d in docs for w in d})
    hashed = dict(zip(words, lda.word_hashes(lda.pa.array(words))))
    lam = lda.starts(np.array([hashed[w] for w in words]), k, seed)
    counts = [Counter(d) for d in docs]
    with np.errstate(over="ignore"):
        seeds = np.array([sum((hashed[w] * np.uint64(0x9E3779B97F4A7C15) for w in d), np.uint64(0)) for d in docs], np.uint64)
    expected = lambda x: lda.digamma(x) - lda.digamma(x.sum(-1, keepdims=True))
    alpha = np.full(k, 1 / k)

    def pass_over(lam, seed):
        beta, stat, gammas = np.exp(expected(lam.T).T), np.zeros_like(lam), np.zeros((len(docs), k))
        for i, d in enumerate(counts):
            if d:
                at, n = [words.index(w) for w in d], np.array(list(d.values()), float)
                gamma, moved = lda.starts(seeds[i : i + 1], k, seed)[0], 1.0
                while moved > 1e-3:
                    theta = np.exp(expected(gamma))
                    new = theta * (beta[at].T @ (n / (beta[at] @ theta + 1e-100))) + alpha
                    gamma, moved = new, np.abs(new - gamma).mean()
                theta = np.exp(expected(gamma))
                stat[at] += np.outer(n / (beta[at] @ theta + 1e-100), theta)
                gammas[i] = gamma
        return gammas, stat * beta

    for step in range(1, passes + 1):
        rho = (1024 + step) ** -0.51
        gammas, stat = pass_over(lam, seed + step)
        full = gammas[gammas[:, 0] > 0]
        lam = (1 - rho) * lam + rho * (stat + 1 / k)
        n = len(full)
        grad = n * (expected(full).mean(0) - expected(alpha))
        c, q = n * lda.trigamma(alpha.sum()), -n * lda.trigamma(alpha)
        alpha = alpha - rho * (grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
    gammas = pass_over(lam, seed)[0]
    return gammas / np.maximum(gammas.sum(1, keepdims=True), 1e-300), dict(zip(words, lam / lam.sum(0)))


def test_lda_holds_no_words_on_the_driver(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(7)
    texts = [["new", "york", "new", "york", "new"] + [f"w{x}" for x in rng.integers(0, 20, 8) + 15 * (i % 2)] for i in range(30)] + [["dog"], [], None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>").repartition(3)
    got_rows, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got_rows.append(collect(self)) or got_rows[-1])
    for kind, name in ((CountVectorizer, "fit"), (SparkContext, "broadcast")):
        monkeypatch.setattr(kind, name, lambda *_: pytest.fail("held by the driver"))
    monkeypatch.setattr(lda, "BLOCK", 60)
    monkeypatch.setattr(lda, "SHARD", 40)
    monkeypatch.setattr(terms.phrase_pairs, "__defaults__", (5, 1.0))
    out, words = terms.lda_with_words(rows, "w", 3, 4, seed=5)
    assert all(len(x) <= 1 for x in got_rows)
    got = {r["id"]: r for r in collect(out)}
    joined = [[*(["new_york"] * 2), *t[4:]] if t and t[0] == "new" else t or [] for t in texts]
    want, weights = lda_by_hand(joined, 3, 4, 5)
    assert set(got) == set(range(33)) and got[31]["topics"] == got[32]["topics"] == [0.0] * 3 and got[31]["dominant_topic"] is got[32]["dominant_topic"] is None
    assert all(np.abs(np.array(got[i]["topics"]) - want[i]).max() < 1e-3 and got[i]["w"] == texts[i] for i in range(33))
    assert all(got[i]["dominant_topic"] == int(np.argmax(got[i]["topics"])) for i in range(31))
    found = {(r["topic"], r["rank"]): r for r in collect(words)}
    assert set(found) == {(t, n) for t in range(3) for n in range(1, 11)}
    for t in range(3):
        first = sorted(weights, key=lambda w: (-weights[w][t], w))[:10]
        assert all(abs(found[t, n + 1]["weight"] - weights[w][t]) < 1e-4 for n, w in enumerate(first)) and found[t, 1]["word"] == first[0]


def test_lda_of_the_words_of_most_occurrences(spark):
    rows = spark.createDataFrame([(i, ["a", "b", "a", "d"] if i % 2 else ["a", "c", "b"]) for i in range(4)] + [(4, ["c"])], "id int, w array<string>")
    out, words = terms.lda_with_words(rows, "w", 2, 1, 3)
    assert {r["word"] for r in words.collect()} == {"a", "b", "c"} and out.where("dominant_topic IS NULL").count() == 0
    assert terms.lda(rows.where("false"), "w", 2, 1).count() == 0
