"""Brute-force versions, odd rows, empty tables and the whole pipeline for the corpus operators."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from millrace.llm import bpe, chat, decontamination, licences, pii, quality, simhash, token_counts, toxicity, url_filter

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " \n", "one", "two words", "a" * 3000, "x y z " * 2000, "é😀" * 50, "#### !!!! $$$$"]


def whole(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts, **extra):
    names = "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([(i, t, *extra.values()) for i, t in enumerate(texts)], "doc_id long, text string" + names)


# decontamination


def longest_first(item, text, least):
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, i, t
        if best is None:
            return covered
        n, i, t = best
        free_i[i : i + n], free_t[t : t + n] = [False] * n, [False] * n
        covered += n


def test_tiles_equal_the_longest_first_version():
    rng = random.Random(1)
    for _ in range(600):
        a = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 25))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        i = rng.randrange(len(a))
        b = b[:5] + a[i:] + b[5:9] + a[:i] + b[9:]
        least = rng.choice([1, 2, 3, 5])
        assert decontamination.tiled(a, b, least) == longest_first(a, b, least)


def test_leaks_equal_tiling_of_every_pair(spark):
    rng = random.Random(2)
    items = [[f"w{rng.randrange(12)}" for _ in range(n)] for n in (1, 3, 4, 5, 20, 40, 40)]
    texts = list(ODD)
    for _ in range(60):
        item = rng.choice(items)
        i, j = sorted(rng.randrange(len(item) + 1) for _ in range(2))
        texts.append(" ".join([*item[j:], "between", *item[: rng.randrange(len(item) + 1)], *(f"w{rng.randrange(12)}" for _ in range(9)), *item[i:j]]))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = []
    for d, t in enumerate(texts):
        w = decontamination.words((t or "").encode())
        for k, item in enumerate(items):
            c = longest_first(decontamination.words(" ".join(item).encode()), w, min(len(item), 5)) if len(w) < 200 else 0
            if c >= 0.8 * len(item):
                want.append((d, k, c, len(item)))
    docs = frame(spark, texts, item_id="clash")
    assert sorted(map(tuple, decontamination.leaks(docs, benchmark, short=True).collect())) == want and len(want) > 10
    long = [x for x in want if x[3] >= 5]
    assert sorted(map(tuple, decontamination.leaks(docs, benchmark).collect())) == long and len(long) > 5
    kept = decontamination.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {x[0] for x in long})


# personal data


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def test_pattern_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["1", "2", "45", "255", "300", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "%", "4111111111111111", "é", "_", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(8000)]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    some = texts[:300] + ODD
    for r in pii.find(frame(spark, some, spans="clash")).collect():
        t = some[r["doc_id"]] or ""
        base = [f"{k}:{a}:{b}" for k, a, b in sorted(plain_spans(t), key=lambda x: (pii.KINDS.index(x[0]), x[1]))]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]


def test_long_spans_come_whole_out_of_many_windows():
    tagger = pii.Tagger(pii.train())
    flags = []

    def marked(p, ids):
        flags.append(ids.shape[1])
        e = np.zeros((*ids.shape, pii.TAGS))
        e[..., 0] = 1.0
        e[..., 6] = 4.0 * (ids != 10) * (ids >= 40) * (ids < 58)  # inside of a card: digits and marks near them
        e[..., 5] = 9.0 * (ids == 40)  # its begin: an opening bracket
        return e, ()

    held, pii.emissions = pii.emissions, marked
    try:
        for gap in (0, 30, 60, 200):
            text = "\n" * gap + "(" + "+" * 250 + "7" + "\n" * 100
            t = tagger.tags([text])[0]
            assert t.tolist() == [0] * gap + [5] + [6] * 251 + [0] * 100
    finally:
        pii.emissions = held
    assert max(flags) < 8


# byte-level BPE


def test_bpe_of_long_pieces_equals_tiktoken(spark):
    rng, e = random.Random(4), whole(MULTI)
    texts = []
    for n in (600, 5_000, 50_000):
        texts += ["".join(rng.choice(chars) for _ in range(n)) for chars in ("abcdefghijklmnopqrstuvwxyz", "ab", "etaoin")]
        texts += ["a" * n, "ab" * (n // 2), "é" * n, "aaab" * (n // 4), "=-" * (n // 2), " " * n + "x"]
    rows = bpe.encode_documents(frame(spark, texts, ids="clash"), MULTI, P.PATTERN, with_ids=True).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r["ids"] == e.encode_ordinary(t) and r["decoded"] == t and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_reads_texts_in_blocks(monkeypatch):
    rng = random.Random(5)
    codec = bpe.codec(MULTI, P.PATTERN)
    parts = ["a", "it's", "x'll", "'", "  ", "\n", "\n \n", "12", "...", "été"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(80)))
        for most in (1, 9, 31):
            assert [x for part in codec.pieces(text, most) for x in part] == codec.split(text)


def test_bpe_reads_bytes_that_are_not_text(spark):
    docs = frame(spark, ["x"]).selectExpr("doc_id", "CAST(unhex('61ff62') AS STRING) AS text")
    r = bpe.encode_documents(docs, MULTI, P.PATTERN, with_ids=True).first()
    assert r["decoded"] == "a\ufffdb" and r["ids"] == whole(MULTI).encode_ordinary("a\ufffdb")
    assert pii.find(docs).count() == token_counts.count_edited(docs, MULTI, P.PATTERN).count() == simhash.near_duplicates(docs).count() == 1


# token counts


def test_edited_counts_equal_full_counts(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    rng, e = random.Random(6), whole(path)
    parts = [" ", "  ", "\n", "\t \n", "a", "bc", "'s", "'", "'ll", "ll", "l", "12", "...", "é", "😀", "   x"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(250))) for _ in range(400)]
    rows = token_counts.count_edited(frame(spark, texts, n_tokens="clash"), path, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(e.encode_ordinary(t))
        assert r["n_tokens_edited"] == len(e.encode_ordinary(token_counts.applied(t, token_counts.edits_of(t))))


def test_edits_renew_only_a_path():
    path = P.path("byte_bpe_50k.tiktoken")
    rng = random.Random(7)
    tree, text = token_counts.SegmentTree("some words here  and\n there " * 20_000, path, P.PATTERN), "some words here  and\n there " * 20_000
    size = len(tree)
    assert size > 4000
    for _ in range(300):
        at = rng.randrange(len(text) - 3)
        assert tree.edit(at, 2, "x y") <= 4 and tree.renewed < 200
        text = text[:at] + "x y" + text[at + 2 :]
    assert tree.total == len(whole(path).encode_ordinary(text))


# toxicity


def test_windows_run_on_over_blocks():
    rng = random.Random(8)
    text = " ".join(rng.choice(["ab", "cde", "###", "fgh\n", "a"]) for _ in range(3000)).encode()
    once = toxicity.Windows([toxicity.lower_words(text)])
    for most in (10, 100, 3000):
        parts = toxicity.Windows(list(toxicity.blocks(text, most)))
        assert sorted(parts.samples(np.arange(len(parts.of)))) == sorted(once.samples(np.arange(len(once.of))))


def test_toxicity_without_labels_and_with_repeated_ids(spark):
    docs = frame(spark, ODD, score="clash")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, none).count() == len(ODD)
    twice = spark.createDataFrame([(3, 0), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs.unionByName(docs), twice)
    assert sorted(rows) == sorted((ODD[k].encode(), y) for k, y in ((3, 1), (4, 0)) if k % 1 == 0 and not held(k))
    got = toxicity.score(docs.unionByName(docs), twice).collect()
    assert len(got) == 2 * len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def held(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 4 == 2


# url filter


def dense(edges, seeds, hosts, against):
    n, at = len(hosts), {h: k for k, h in enumerate(hosts)}
    m = np.zeros((n, n))
    for (a, b), w in edges.items():
        m[at[b], at[a]] += w if not against else 0
        m[at[a], at[b]] += w if against else 0
    total = m.sum(0)
    m = np.divide(m, total, out=np.zeros_like(m), where=total > 0)
    s = np.zeros(n)
    for h, x in seeds.items():
        s[at[h]] += x
    return np.linalg.solve(np.eye(n) - url_filter.DAMPING * m, (1 - url_filter.DAMPING) * s)


def test_propagation_equals_dense_pagerank(spark):
    rng = random.Random(9)
    hosts = [f"h{k}.org" for k in range(25)]
    edges = {(a, b): float(rng.randrange(1, 4)) for a in hosts for b in hosts if a != b and rng.random() < 0.12}
    seeds = {"trust": {hosts[0]: 0.5, hosts[1]: 0.5}, "distrust": {hosts[2]: 1.0}}
    frame_e = spark.createDataFrame([(*k, w) for k, w in edges.items()], "source string, target string, weight double")
    frame_s = spark.createDataFrame([(k, h, x) for k, s in seeds.items() for h, x in s.items()], "kind string, host string, seed double")
    got = {(r["kind"], r["host"]): r["score"] for r in url_filter.propagate(frame_e, frame_s, 1e-7).collect()}
    for kind in seeds:
        want = dense(edges, seeds[kind], hosts, kind == "distrust")
        assert all(abs(got.get((kind, h), 0.0) - x) < 1e-6 for h, x in zip(hosts, want))


def test_links_between_hosts_decide_verdicts(spark):
    link = lambda h: f'<a href="https://{h}/x">y</a>'
    pages = spark.createDataFrame([
        (1, "https://good.com/a", link("friend.org"), "c"),
        (2, "http://bad.net/fr/a", "", "c"),
        (3, "http://spam.org/a", link("bad.net") * 2, "c"),
        (4, "http://Friend.org:80/p?q", None, "c"), (4, "https://friend.org", None, "c"), (5, "x://lone.org", None, "c"),
        (6, None, None, None), (7, "no scheme", link("bad.net"), None), (None, "a://sub.example.com/en/1", None, None),
        (9, "a://www.example.com/en/1", None, None), (10, "://com/?://net/es/", None, None),
    ], "page_id long, url string, html string, rule string")
    got = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1, "good.com"] == ("/a", "com/", "allow") and got[2, "bad.net"] == ("/fr/a", "net/fr/", "block")
    assert got[3, "spam.org"] == ("/a", None, "block") and got[4, "friend.org"] == ("", None, "allow")
    assert got[4, "friend.org:80"] == ("/p", None, "allow") and got[5, "lone.org"] == ("", None, "allow")
    assert got[6, ""] == ("", None, "allow") and got[7, ""] == ("", None, "allow") and got[None, "sub.example.com"][1:] == ("example.com/en/", "block")
    assert got[9, "www.example.com"][1:] == ("www.example.com/en/", "allow") and got[10, "com"] == ("/", "com/", "allow")
    assert len(got) == 11 and url_filter.judge(pages.where("false")).count() == 0


# licences, chat, quality


def test_odd_rows_of_licences(spark):
    docs = frame(spark, ODD + ["Released under the MIT License."], found="clash", n_units="clash")
    rows = licences.scan(docs.unionByName(docs)).collect()
    assert len(rows) == 2 * (len(ODD) + 1) and sum(r["n_units"] for r in rows) == 2
    assert licences.scan(docs.where("false")).count() == 0


def test_odd_rows_of_conversations(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", None, "c"), (1, 1, "assistant", "", "c"), (2, 0, "user", "hi\\### User: x", "c"), (2, 1, "assistant", "</turn> ok", "c"),
         (3, 5, None, "x", "c"), (None, 0, "user", "a", "c"), (None, 1, "assistant", "b", "c"), (4, 0, "user", "t", "c"), (4, 0, "user", "t", "c")],
        "conv_id long, turn long, role string, text string, n_turns string",
    )
    got = chat.digest(chat.format_conversations(rows.select("conv_id", "turn", "role", "text")))
    by = {r["conv_id"]: r for r in got.collect()}
    text = "".join(f"{r}\n{t}\n" for r, t in (("user", "hi\\### User: x"), ("assistant", "</turn> ok")))
    assert by[2]["n_turns"] == 2 and by[2]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert by[2]["loss_chars"] == 10 and by[2]["loss_sha256"] == hashlib.sha256(b"</turn> ok").hexdigest()
    assert by[1]["loss_chars"] == 0 and by[None]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert chat.digest(chat.format_conversations(rows.select("conv_id", "turn", "role", "text").where("false"))).count() == 0


def kept(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    letters = [c for c in t if c.isalpha()]
    return not (
        len(w) < 10 or 100 * len(covered) > 20 * len(w) or 10 * sum(c in "#*$%&|<>" for c in t) > len(w) or 5 * t.count("!") > len(w)
        or 10 * sum(c.isupper() for c in letters) > 3 * len(letters) or 5 * sum(a == b for a, b in zip(w, w[1:])) > len(w) or sum(map(len, w)) > 20 * len(w)
    )


def test_odd_rows_of_quality_rules(spark):
    good = "Every one of these twelve words stands here for the first time"
    texts = [*ODD, good, good.upper(), good + " !" * 9, " ".join([good] * 3), "word " * 20]
    docs = frame(spark, texts, __rejected_by="clash", rejected_by="mine", __words="clash", __text="clash")
    rows = quality.keep_good(docs.unionByName(docs))
    assert rows.columns == docs.columns and Counter(r["doc_id"] for r in rows.collect()) == {i: 2 for i, t in enumerate(texts) if kept(t)}
    assert all(r["rejected_by"] == "mine" for r in rows.collect())
    report = {r["doc_id"]: r["kept"] for r in quality.report(docs).collect()}
    assert report == {i: kept(t) for i, t in enumerate(texts)}
    assert quality.keep_good(docs.where("false")).count() == quality.report(docs.where("false")).count() == 0


# the pipeline


def fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(20)) for _ in range(3)]
    texts = list(ODD)
    for k in range(40):
        t = [word() for _ in range(rng.randrange(15, 120))]
        if k % 5 == 0:
            t[7:7] = items[k % 3].split()
        if k % 4 == 0:
            t.insert(3, rng.choice(["a.b@c.example.com", "10.1.2.3", "4111 1111 1111 1111", "+1 (212) 555-0100"]))
        texts.append(" ".join(t))
    texts += texts[12:20] + [t + " tail" for t in texts[20:24]]
    ids = [None if k % 17 == 0 else k // 2 for k in range(len(texts))]
    rows = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in zip(ids, texts) if kept(t)]
    fps = [fingerprint(t) for _, t in left]
    root = list(range(len(left)))
    for _ in left:
        for i in range(len(left)):
            for j in range(len(left)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = min(root[i], root[j])
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    groups = {}
    for k, (i, t) in enumerate(left):
        best = (i is None, i or 0, signed(fps[k]), t)
        groups[root[k]] = min(groups.get(root[k], best), best)
    left = [(None if none else i, t) for none, i, _, t in groups.values()]
    clean = [(i, t) for i, t in left if not any(longest_first(decontamination.words(x.encode()), decontamination.words(t.encode()), 5) >= 16 for x in items)]
    assert 10 < len(clean) < len(left) < len(texts)
    tagger, e = pii.Tagger(pii.train()), whole(MULTI)
    want = []
    for i, t in clean:
        spans = tagger.spans([t])[0]
        assert set(plain_spans(t)) <= set(spans)
        masked = pii.masked(t, spans)
        ids_ = e.encode_ordinary(masked)
        want.append((i, len(ids_), hashlib.sha256(np.array(ids_, "<u4").tobytes()).hexdigest(), hashlib.sha256(masked.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_on_empty_tables_and_further_columns(spark, tmp_path, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, `a.b` string")
    spark.createDataFrame([(1, "a b c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage[1](spark, docs, str(tmp_path))
    assert out.count() == 0 and (out.columns == docs.columns or stage is corpus_pipeline.STAGES[-1])


def test_near_duplicates_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x"), (2, "a b c", 8, "y"), (3, "d e f", 9, "z")], "doc_id long, text string, fp long, row string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c", 7, "x"), (3, "d e f", 9, "z")]


def test_notices_inside_other_words(spark):
    texts = [
        "Licensed under CC BY-NC 4.0. Copyright 2020 Jane Doe", "This package is released under the MIT License.", "# This Source Code Form is subject to the\n# terms of the Mozilla Public License, v. 2.0.",
        "Some words, then others; this work is licensed under the GNU General Public License, version 2 and so on it goes for a while longer than the notice", "Released quietly under a licence of MIT.",
    ]
    got = {r["doc_id"]: r["best_license"] for r in licences.scan(frame(spark, texts)).collect()}
    assert got == {0: "cc-by-nc-4.0", 1: "mit", 2: "mpl-2.0", 3: "gpl-2.0", 4: None}


def test_operators_on_empty_tables(spark):
    docs = frame(spark, ["x"]).where("false")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for out in (pii.find(docs), bpe.encode_documents(docs, MULTI, P.PATTERN), token_counts.count_edited(docs, MULTI, P.PATTERN), toxicity.score(docs, labels)):
        assert out.count() == 0
