"""Toxicity by compression distance with two zstandard dictionaries.

A text is read as overlapping windows of WORDS words. Each window is compressed
under a dictionary of ordinary and one of toxic text; the two lengths together
tell how much better the toxic one explains it. Calibration counts, on texts
that the dictionaries were not trained on, how often each pair of lengths comes
from toxic and from ordinary windows; a text's evidence is the likelihood that a
small share of its windows is toxic, against none, and a logistic curve turns it
into a score.

Most windows of a toxic text are ordinary, so the toxic dictionary is trained on
those windows of toxic texts that hold a run of GRAM bytes which toxic texts
contain more often than chance allows (EXCESS, twice the log likelihood ratio);
no such run is used for scoring.

Fitting takes at most SAMPLE labelled rows of each class (the smallest hashes of
their doc_ids), whole texts, of which rows beyond SAMPLE_BYTES in all are left
out; scoring takes every window of every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Labelled rows of each class that are used for fitting, and the bytes of their texts, half for each class.
SAMPLE, SAMPLE_BYTES = 1500, 8_000_000
#: Words of a window.
WORDS = 2
#: Bytes of a run, and the statistic beyond which it tells toxic from ordinary texts.
GRAM, EXCESS = 6, 24.0
DICT_BYTES, LEVEL = 8_192, 12
#: Ordinary windows that the ordinary dictionary is trained on.
TRAIN_WINDOWS = 60_000
#: Lengths are counted up to this many bytes.
LONGEST = 48
#: Shares of toxic windows that the evidence is taken for.
SHARES = (0.003, 0.02, 0.1)
FEATURES = len(SHARES) + 2
#: Bytes of text that are measured at once.
BLOCK = 8_000_000
SPACE = re.compile(rb"[\x20\x09-\x0d]")
MARKS = b".,;:!?\"'()[]{}#*$%&|<>-_"
APART = bytes.maketrans(MARKS, b" " * len(MARKS))


def lower_words(text: bytes) -> list[bytes]:
    """Lower-case words between white space and marks."""
    return text.decode("utf-8", "replace").lower().encode().translate(APART).split()


def blocks(text: bytes, most: int = BLOCK) -> Iterator[list[bytes]]:
    """The text's words in lists of about ``most`` bytes, each with the last words of the one before, so that windows run on."""
    at, before = 0, []
    while at < len(text):
        cut = SPACE.search(text, at + most)
        end = cut.end() if cut else len(text)
        words = before + lower_words(text[at:end])
        if len(words) > len(before):
            yield words
        at, before = end, words[1 - WORDS :] if WORDS > 1 else []


class Windows:
    """The windows of several lists of words, as stretches of one buffer; ``of`` gives each one's list."""

    def __init__(self, words: list[list[bytes]]):
        counts = np.array([len(w) for w in words], np.int64)
        self.buffer = b" " + b" ".join(chain.from_iterable(words)) + b" "
        sizes = np.fromiter(map(len, chain.from_iterable(words)), np.int64, int(counts.sum()))
        starts = np.cumsum(sizes + 1) - sizes - 1
        first = np.cumsum(counts) - counts
        windows = np.where(counts > 0, np.maximum(counts - WORDS + 1, 1), 0)
        of = np.repeat(np.arange(len(words)), windows)
        at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + first[of]
        last = np.minimum(at + WORDS, (first + counts)[of]) - 1
        self.of, self.start = of, starts[at]
        self.size = starts[last] + sizes[last] + 2 - self.start
        self.texts = len(words)
        #: where each list begins in the buffer, and where the last one ends
        self.edges = np.concatenate([starts, [len(self.buffer) - 1]])[np.append(first, len(sizes))].tolist()
        # equal windows have equal codes, so that each is compressed once
        codes = Codes()
        word = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int64, len(sizes))
        self.code = word[at]
        for k in range(1, WORDS):
            self.code = self.code * (len(codes) + 1) + np.where(at + k <= last, word[np.minimum(at + k, last)] + 1, 0)

    def samples(self, which: np.ndarray) -> list[bytes]:
        return [self.buffer[a : a + n] for a, n in zip(self.start[which].tolist(), self.size[which].tolist())]


class Codes(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def compressor(dictionary: bytes):
    """A compressor whose match search suits windows of a few words."""
    import zstandard

    how = zstandard.ZstdCompressionParameters(
        window_log=15, chain_log=14, hash_log=14, search_log=4, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def lengths(coder, buffer: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Compressed length of each stretch of the buffer."""
    import zstandard

    if not len(start):
        return np.zeros(0, np.int64)
    parts = np.ascontiguousarray(np.stack([start, size], 1).astype(np.uint64)).tobytes()
    out = coder.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, parts), threads=1)
    return np.fromiter(map(len, out), np.int64, len(start))


def train(samples: list[bytes]) -> bytes:
    """A dictionary of frequent content; with too few samples for training their own bytes stand in."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b" ".join(samples) or b" no sample ")[-DICT_BYTES:]


@dataclass
class Model:
    """Two dictionaries, the likelihood ratio of each pair of lengths, and the calibration over ``features``."""

    toxic: bytes
    ordinary: bytes
    ratio: np.ndarray = field(default_factory=lambda: np.ones((LONGEST, LONGEST)))
    weights: tuple = (0.0,) * FEATURES
    bias: float = 0.0

    def measure(self):
        """A function of windows to each one's lengths (ordinary, toxic), up to LONGEST."""
        a, b = compressor(self.ordinary), compressor(self.toxic)

        def pairs(w: Windows) -> tuple[np.ndarray, np.ndarray]:
            _, first, back = np.unique(w.code, return_index=True, return_inverse=True)
            return tuple(np.minimum(lengths(c, w.buffer, w.start[first], w.size[first]), LONGEST - 1)[back] for c in (a, b))

        return pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -30, 30)))


class Evidence:
    """Features of ``n`` texts, gathered over their windows in any number of steps."""

    def __init__(self, n: int):
        self.sums, self.count, self.top = np.zeros((n, len(SHARES))), np.zeros(n), np.zeros(n)

    def add(self, of: np.ndarray, ratio: np.ndarray) -> None:
        for k, s in enumerate(SHARES):
            self.sums[:, k] += np.bincount(of, np.log1p(s * (ratio - 1)), len(self.count))
        self.count += np.bincount(of, minlength=len(self.count))
        np.maximum.at(self.top, of, ratio)

    def features(self) -> np.ndarray:
        """One row per text: evidence at each share, the number of windows, the largest ratio; zeros without windows."""
        return np.column_stack([np.sign(self.sums) * np.log1p(np.abs(self.sums)), np.log1p(self.count), np.log(np.where(self.top > 0, self.top, 1.0))])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with a small ridge."""
    one = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(one.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        h = one.T @ (one * (p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, one.T @ (y - p) - 1e-2 * w)
    return w[:-1], float(w[-1])


def runs(buffer: bytes, start: int, end: int) -> np.ndarray:
    """Codes of the GRAM bytes from each place between ``start`` and ``end`` of the buffer."""
    b = np.frombuffer(buffer, np.uint8, max(min(end + GRAM - 1, len(buffer)) - start, 0), start).astype(np.uint64)
    n = max(len(b) - GRAM + 1, 0)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = code << np.uint64(8) | b[k : k + n]
    return code


def telling(w: Windows, y: np.ndarray) -> np.ndarray:
    """Codes of the runs that stand in more toxic texts than chance allows."""
    found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for k, label in enumerate(y):
        found[label].append(np.unique(runs(w.buffer, w.edges[k], w.edges[k + 1] - GRAM + 1)))
    codes, toxic = np.unique(np.concatenate(found[1]), return_counts=True)
    plain = np.concatenate(found[0])
    del found
    place = np.searchsorted(codes, plain)
    plain = place[codes[np.minimum(place, len(codes) - 1)] == plain] if len(codes) else place[:0]
    total = toxic + np.bincount(plain, minlength=len(codes))
    usual = y.mean() if len(y) else 0.0
    share = toxic / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (toxic * np.log(share / usual) + np.where(total > toxic, (total - toxic) * np.log((1 - share) / (1 - usual)), 0))
    return codes[(share > usual) & (g >= EXCESS)]


def holding(w: Windows, codes: np.ndarray) -> np.ndarray:
    """Whether each window holds a run of ``codes`` (sorted)."""
    good = np.zeros(len(w.buffer) + 1, np.int32)
    for a in range(0, len(w.buffer) if len(codes) else 0, 1_000_000):
        code = runs(w.buffer, a, min(a + 1_000_000, len(w.buffer)))
        good[a + 1 : a + 1 + len(code)] = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
    good = np.cumsum(good, dtype=np.int32)
    return good[np.maximum(w.start + w.size - GRAM + 1, w.start)] > good[w.start]


def dictionaries(w: Windows, y: np.ndarray) -> tuple[Model, np.ndarray]:
    """A model without calibration, and the codes its toxic training windows were picked by."""
    codes = telling(w, y)
    toxic = np.flatnonzero((y[w.of] == 1) & holding(w, codes))
    plain = np.random.default_rng(0).permutation(np.flatnonzero(y[w.of] == 0))[:TRAIN_WINDOWS]
    return Model(train(w.samples(toxic)), train(w.samples(plain))), codes


def ratios(w: Windows, y: np.ndarray, codes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How much likelier each pair of lengths is in toxic windows than in ordinary ones, smoothed."""
    def share(which: np.ndarray) -> np.ndarray:
        c = np.zeros((LONGEST + 2, LONGEST + 2))
        np.add.at(c, (pairs[0][which] + 1, pairs[1][which] + 1), 1.0)
        for axis in (0, 1):
            c = (np.roll(c, 1, axis) + 2 * c + np.roll(c, -1, axis)) / 4
        c = c[1:-1, 1:-1]
        return c / max(c.sum(), 1e-12)

    few = 2.0 / max(int((y[w.of] == 0).sum()), 1)
    return (share((y[w.of] == 1) & holding(w, codes)) + few / 2) / (share(y[w.of] == 0) + few)


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """A model from (text, label); each half of the rows is measured with the other half's dictionaries for calibration."""
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(b" no sample ", b" no sample ", bias=3.0 if len(y) and y[0] else -3.0)
    words = [lower_words(t) for t, _ in rows]
    half = np.zeros(len(rows), bool)
    for label in (0, 1):  # every other row of each class
        half[np.flatnonzero(y == label)[::2]] = True
    xs, ys, tables = [], [], []
    for part in (half, ~half):
        other = np.flatnonzero(~part)
        model, codes = dictionaries(Windows([words[i] for i in np.flatnonzero(part)]), y[part])
        w = Windows([words[i] for i in other])
        pairs = model.measure()(w)
        model.ratio = ratios(w, y[other], codes, pairs)
        tables.append(model.ratio)
        found = Evidence(w.texts)
        found.add(w.of, model.ratio[pairs])
        xs.append(found.features())
        ys.append(y[other])
    model, _ = dictionaries(Windows(words), y)
    model.ratio = (tables[0] + tables[1]) / 2
    weights, model.bias = calibrate(np.vstack(xs), np.concatenate(ys).astype(float))
    model.weights = tuple(map(float, weights))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most ``most`` rows of each class outside the held-out fold, ``most_bytes`` of text in all.

    Of a doc_id with several labels the greatest counts, of one with several
    texts the least.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    there = texts.select("doc_id", F.octet_length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    picked = []
    for y in (0, 1):
        # the labels may lack a document, and the documents a label
        part = known.where(F.col("toxic") == y).join(there, "doc_id").orderBy("h", "doc_id").limit(most).collect()
        left = most_bytes // 2
        for r in part:
            if r["n"] <= left:
                left -= r["n"]
                picked.append((r["doc_id"], r["toxic"], r["h"]))
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int, h long")
    got = texts.join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r["text"].encode("utf-8", "replace"), r["toxic"]) for r in sorted(got, key=lambda r: (r["h"], r["doc_id"]))]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``.

    Fitting runs Spark jobs and trains on the driver while the plan is built.
    Null and empty texts have no window and get the score of no evidence. A
    null doc_id is not held out. Repeated rows are scored alike; extra columns
    are ignored; with no labelled rows of both classes all scores are the
    prior's; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels)))

    def run(batches):
        model, measure = held.value, None
        for batch in batches:
            measure = measure or model.measure()
            found = Evidence(batch.num_rows)
            words, rows, size = [], [], 0

            def flush():
                w = Windows(words)
                found.add(np.array(rows, np.int64)[w.of], model.ratio[measure(w)])

            for row, text in enumerate(texts_of(batch, "text")):
                for part in blocks(text):
                    words.append(part)
                    rows.append(row)
                    size += min(len(text), BLOCK)
                    if size >= BLOCK:
                        flush()
                        words, rows, size = [], [], 0
            if words:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(found.features()), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
