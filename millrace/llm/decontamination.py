"""Benchmark decontamination by greedy string tiling.

Benchmark items come in blocks of bounded size, each shipped to the workers
whole; every document passes every block, so nothing is shuffled and frequent
passages or huge benchmarks change only the number of blocks. A document and an
item that share a seed (a shingle of LEAST words, or a shorter item's all) are tiled: the longest
matches of unmarked words, found by Karp-Rabin hashing, are marked first, then
shorter ones down to LEAST words. Marked words of the item over its words are
the coverage, in whatever order the passages stand. Pairs with too few words
under shared seeds, in the document or in the item, can't reach COVERAGE and
aren't tiled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_slices, texts_of

LEAST, COVERAGE = 5, 0.8
#: Words of the items in a block.
BLOCK_WORDS = 1_000_000
MOD, BASE = (1 << 61) - 1, 1_000_003


def words(text: bytes) -> list[bytes]:
    """Words without case and without the ASCII marks at their ends."""
    return [x for w in text.decode("utf-8", "replace").lower().encode().split() if (x := w.strip(b".,;:!?\"'()[]{}#*$%&|<>-_"))]


def _scan(item: list, text: list, free_i: list, free_t: list, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``size`` unmarked words as (length, item start, text start), by Karp-Rabin."""
    power = pow(BASE, size - 1, MOD)

    def hashes(seq: list, free: list) -> Iterator[tuple[int, int]]:
        h = run = 0
        for i, w in enumerate(seq):
            if not free[i]:
                h = run = 0
                continue
            if run >= size:
                h = (h - hash(seq[i - size]) * power) % MOD
            h = (h * BASE + hash(w)) % MOD
            run += 1
            if run >= size:
                yield h, i - size + 1

    at = defaultdict(list)
    for h, i in hashes(item, free_i):
        at[h].append(i)
    found = []
    for h, t in hashes(text, free_t):
        for i in at.get(h, ()):
            if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                continue  # part of a run that begins earlier
            n = 0
            while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                n += 1
            if n >= size:
                found.append((n, i, t))
    return found


def tiled(item: list, text: list, least: int = LEAST) -> int:
    """Words of ``item`` under greedy string tiles of ``text``: always the longest match of unmarked words first.

    Ties go to the first place in the item, then in the text. What an earlier
    tile leaves of a match waits again among those of its length.
    """
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    size = max(len(item), least)
    while True:
        waiting = [(-n, i, t) for n, i, t in _scan(item, text, free_i, free_t, size)]
        heapq.heapify(waiting)
        while waiting:
            n, i, t = heapq.heappop(waiting)
            n = -n
            if all(free_i[i : i + n]) and all(free_t[t : t + n]):
                free_i[i : i + n], free_t[t : t + n] = [False] * n, [False] * n
                covered += n
                continue
            run = 0
            for k in range(n + 1):
                if k < n and free_i[i + k] and free_t[t + k]:
                    run += 1
                    continue
                if run >= size:
                    heapq.heappush(waiting, (-run, i + k - run, t + k - run))
                run = 0
        if size == least:
            return covered
        size = max(least, size // 2)


def _seeded(item: list, seeds: set[tuple], least: int = LEAST) -> int:
    """Words of ``item``, repeated ones too, that lie under any of ``seeds``: no tiling covers more."""
    n = end = 0
    for i, s in enumerate(zip(*[item[i:] for i in range(least)])):
        if s in seeds:
            n += i + least - max(i, end)
            end = i + least
    return n


class Block:
    """Items of a block with their seeds, by the seeds' lengths: LEAST words, or with ``short`` the whole of a shorter item."""

    def __init__(self, items: list[tuple[int, bytes]], short: bool = False):
        self.items = [(k, w) for k, t in items if len(w := words(t)) >= (1 if short else LEAST)]
        self.seeds: dict[int, dict[tuple, set[int]]] = {}
        for n, (_, w) in enumerate(self.items):
            least = min(LEAST, len(w))
            held = self.seeds.setdefault(least, {})
            for s in zip(*[w[i:] for i in range(least)]):
                held.setdefault(s, set()).add(n)

    def leaks(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item id, covered words, words) of each item that the text covers."""
        w = words(text)
        out = []
        for size, seeds in self.seeds.items():
            near: dict[int, list[int]] = defaultdict(list)
            for t, s in enumerate(zip(*[w[i:] for i in range(size)])):
                for n in seeds.get(s, ()):
                    near[n].append(t)
            for n, spots in near.items():
                key, item = self.items[n]
                # only words under seeds can be tiled: the text is cut to them, with a gap between runs
                cut, end = [], -1
                for t in spots:
                    if end >= 0 and t > end:
                        cut.append(None)
                    cut += w[max(t, end) : t + size]
                    end = t + size
                # tiles use up words of the text and of the item, and on both sides these lie under seeds
                least = COVERAGE * len(item)
                if len(cut) - cut.count(None) >= least and _seeded(item, {tuple(w[t : t + size]) for t in spots}, size) >= least and (c := tiled(item, cut, size)) >= least:
                    out.append((key, c, len(item)))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS, short: bool = False) -> Iterator[Block]:
    """The items in blocks of about ``most`` words; the driver holds one at a time."""
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        held.append((r[0], r[1].encode()))
        n += len(held[-1][1]) // 5
        if n >= most:
            yield Block(held, short)
            held, n = [], 0
    if held:
        yield Block(held, short)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", short: bool = False) -> DataFrame:
    """doc_id, item_id, covered, n_words: the items of which a document covers COVERAGE or more.

    One row per row of ``docs`` and item. Null and empty texts leak nothing;
    items of fewer than LEAST words are common phrases and not looked for
    unless ``short`` asks for them, whole; an empty benchmark or
    table gives no rows; extra columns are ignored. Column ``key`` of ``docs``
    is returned as doc_id.
    """
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, covered long, n_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, short=short):

        def run(batches, held=docs.sparkSession.sparkContext.broadcast(block)):
            for batch in batches:
                for part in small_slices(batch, "text"):
                    rows = [(d, *x) for d, t in zip(part.column(0).to_pylist(), texts_of(part, "text")) for x in held.value.leaks(t)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], ["doc_id", "item_id", "covered", "n_words"])

        out = out.unionByName(read.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that leak no item, with their columns as they were; each row is judged by its own text, without any shuffle."""
    for block in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def make(name, held=held):
            def run(batches):
                for batch in batches:
                    for part in small_slices(batch, name):
                        yield part.filter(pa.array([not held.value.leaks(t) for t in texts_of(part, name)], pa.bool_()))

            return run

        docs = map_rows(docs, make)
    return docs
