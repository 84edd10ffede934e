"""Byte-level BPE by DuckDB recursive queries, one engine per Python worker.

Pre-tokens that are no token are split into rows (piece, place, token). A
recursive query joins adjacent rows with the ranks of concatenated tokens and
contracts each piece's leftmost pair of least rank until no pair is left. Ids
are decoded by an ordered aggregation over their tokens.

In a piece of more than SHORT bytes a round contracts a pair of least rank in
every neighbourhood instead, so that the rounds don't grow with the piece. What a
contraction can lead to lies inside one token, so a pair is out of reach of all
that comes before it if no lesser one lies within two tokens' length; the order
of the one-by-one method is thereby kept. Equal pairs go together, overlapping
ones alternately from the left, up to one whose token makes a pair of lesser rank
with a neighbour or its like.

A worker remembers up to CACHE pre-tokens. Texts are read in blocks of BLOCK
characters, so that memory follows neither a text's nor a batch's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Bytes of a piece that are contracted one pair a round, and of the pieces in a query.
SHORT, QUERY = 64, 250_000
#: Characters of a text read at once, and of the blocks encoded at once.
BLOCK = 2_000_000
#: Pre-tokens that a worker remembers.
CACHE = 250_000
#: Tokens in a row that is decoded.
ROW = 4
BASE = 1 << 32

ONE_A_ROUND = f"""
WITH RECURSIVE r(p, g, tok, k) AS (
  SELECT p, g, tok, 0 FROM start
  UNION ALL
  SELECT r.p, r.g, CASE WHEN r.g = b.key % {BASE} THEN b.key // {BASE} ELSE r.tok END, r.k + 1
  FROM r JOIN (
    SELECT p, min(id * {BASE} + g) AS key, arg_min(after, id * {BASE} + g) AS gone
    FROM (
      SELECT p, g, tok << 32 | lead(tok) OVER w AS pair, lead(g) OVER w AS after, lead(p) OVER w AS other
      FROM r WINDOW w AS (ORDER BY g)
    ) JOIN merges USING (pair) WHERE other = p GROUP BY p
  ) b ON r.p = b.p AND r.g <> b.gone
)
SELECT p, tok FROM r JOIN (SELECT p, max(k) AS k FROM r GROUP BY p) USING (p, k) ORDER BY g
"""

MANY_A_ROUND = f"""
WITH RECURSIVE r(g, p, tok) USING KEY (g) AS (
  SELECT g, p, tok FROM start
  UNION ALL
  SELECT unnest([g, after]) AS g, p, unnest([id, NULL]) AS tok FROM (
    SELECT *, bool_and(least) OVER (PARTITION BY p, run ORDER BY g ROWS UNBOUNDED PRECEDING) AS safe,
           row_number() OVER (PARTITION BY p, run ORDER BY g) AS nth
    FROM (
      SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY p ORDER BY g ROWS UNBOUNDED PRECEDING) AS run,
             id = lowest // {BASE} AND (lowest % {BASE} = {BASE - 1} OR g <= lowest % {BASE}) AS least
      FROM (
        SELECT *, coalesce(lag(after) OVER v = g AND lag(id) OVER v = id, false) AS joined,
               min(key) OVER (PARTITION BY p ORDER BY g RANGE BETWEEN $reach PRECEDING AND $reach FOLLOWING) AS lowest
        FROM (
          SELECT p, g, after, m.id, m.id * {BASE} + CASE WHEN m.twice OR x.pair IS NOT NULL OR y.pair IS NOT NULL THEN g ELSE {BASE - 1} END AS key
          FROM (
            SELECT p, g, tok << 32 | lead(tok) OVER w AS pair, lead(g) OVER w AS after,
                   lag(tok) OVER w AS before, lead(tok, 2) OVER w AS next
            FROM recurring.r WHERE tok IS NOT NULL WINDOW w AS (PARTITION BY p ORDER BY g)
          ) JOIN merges m USING (pair)
          LEFT JOIN lesser x ON x.pair = before << 32 | m.id LEFT JOIN lesser y ON y.pair = m.id << 32 | next
        ) WINDOW v AS (PARTITION BY p ORDER BY g)
      )
    )
  ) WHERE safe AND nth % 2 = 1
)
SELECT p, tok FROM r WHERE tok IS NOT NULL ORDER BY g
"""


class Codes(dict):
    """Numbers pre-tokens in the order they are met."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.words.append(word)
        return n


class Codec:
    """Encoder and decoder for a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.reach = 2 * max(map(len, self.ranks))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs, whole, twice, lesser = [], [], set(), []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if x is not None and y is not None:
                    pairs.append(x << 32 | y)
                    whole.append(rank)
                    if rank < max(x, y):
                        lesser.append(x << 32 | y)
                        if x == y:
                            twice.add(x)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '300MB'")
        self._table("merges", pair=np.array(pairs, np.int64), id=np.array(whole, np.int64), twice=np.array([x in twice for x in whole], bool))
        self._table("lesser", pair=np.array(lesser, np.int64))
        # one character per byte; the last row fills up rows of ids
        chars = [t.decode("latin-1") for t in self.ranks] + [""]
        self._table("vocabulary", id=np.array([*self.ranks.values(), -1], np.int64), chars=pa.array(chars, pa.string()))
        self.forget()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def forget(self) -> None:
        """Empty the memory of pre-tokens."""
        self.codes = Codes()
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.place = np.zeros(0, np.int64)

    def pieces(self, text: str, most: int = BLOCK) -> Iterator[list[str]]:
        """The text's pre-tokens, in lists of about ``most`` characters.

        A block's last pre-tokens may depend on what follows it, so they are
        found again at the start of the next one.
        """
        at, size = 0, most
        while at < len(text):
            found = self.split(text[at : at + size])
            if at + size < len(text):
                if len(found) < 8:
                    size *= 2
                    continue
                found = found[:-4]
            yield found
            at, size = at + sum(map(len, found)), most

    def merged(self, pieces: list[bytes], query: str, **values) -> list[np.ndarray]:
        """Token ids of each piece by a recursive query."""
        sizes = np.array([len(x) for x in pieces], np.int64)
        p = np.repeat(np.arange(len(pieces)), sizes)
        self.db.register("start", pa.table({"p": p, "g": np.arange(len(p)), "tok": self.single[np.frombuffer(b"".join(pieces), np.uint8)]}))
        out = self.db.execute(query, values or None).fetchnumpy()
        self.db.unregister("start")
        return np.split(np.asarray(out["tok"], np.uint32), np.cumsum(np.bincount(out["p"], minlength=len(pieces)))[:-1])

    def learn(self) -> None:
        """Encode the pre-tokens that are new in the memory."""
        new = [x.encode() for x in self.codes.words[len(self.size) :]]
        ids: list = [None] * len(new)
        short, long = [], []
        for k, x in enumerate(new):
            if (r := self.ranks.get(x)) is not None:
                ids[k] = (r,)
            else:
                (short if len(x) <= SHORT else long).append(k)
        for which, query, values in ((short, ONE_A_ROUND, {}), (long, MANY_A_ROUND, {"reach": self.reach})):
            part, held = [], 0
            for k in [*which, None]:
                if part and (k is None or held + len(new[k]) > QUERY):
                    for j, found in zip(part, self.merged([new[j] for j in part], query, **values)):
                        ids[j] = found
                    part, held = [], 0
                if k is not None:
                    part.append(k)
                    held += len(new[k])
        if new:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.place = np.concatenate([self.place, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, *([np.concatenate([np.asarray(x, np.uint32) for x in ids])] if ids else [])])

    def encode(self, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of blocks of codes, one after the other, and how many each block has."""
        self.learn()
        codes = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.place[codes] - ends + sizes, sizes) + np.arange(total)]
        borders = np.concatenate([[0], ends])[np.cumsum([0, *map(len, blocks)])]
        return ids, np.diff(borders)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids, given how many it has."""
        out = [b""] * len(counts)
        rows = -(-counts // ROW)
        of = np.repeat(np.arange(len(counts)), rows)
        if len(of):
            padded = np.full(len(of) * ROW, -1, np.int64)
            shift = (np.cumsum(rows) - rows) * ROW - (np.cumsum(counts) - counts)
            padded[np.arange(len(ids)) + np.repeat(shift, counts)] = ids
            columns = {f"t{k}": padded[k::ROW] for k in range(ROW)}
            self.db.register("ids", pa.table({"d": of, "n": np.arange(len(of)), **columns}))
            joins = " ".join(f"JOIN vocabulary v{k} ON v{k}.id = t{k}" for k in range(ROW))
            text = " || ".join(f"v{k}.chars" for k in range(ROW))
            for d, s in self.db.execute(f"SELECT d, string_agg({text}, '' ORDER BY n) FROM ids {joins} GROUP BY d").fetchall():
                out[d] = s.encode("latin-1")
            self.db.unregister("ids")
        return out


_held: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; it is built once per Python process."""
    if (path, pattern) not in _held:
        _held[path, pattern] = Codec(path, pattern)
    return _held[path, pattern]


class Encoded:
    """What is known of each row's text: token count, digests, and, if asked for, ids and bytes."""

    def __init__(self, n: int, with_ids: bool):
        self.count = np.zeros(n, np.int64)
        self.of_ids, self.of_bytes = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        self.kept = [([], []) for _ in range(n)] if with_ids else None

    def add(self, c: Codec, rows: list[int], blocks: list[np.ndarray]) -> None:
        ids, counts = c.encode(blocks)
        at = 0
        for row, n, text in zip(rows, counts.tolist(), c.decode(ids, counts)):
            part = ids[at : at + n]
            at += n
            self.count[row] += n
            self.of_ids[row].update(part.astype("<u4").tobytes())
            self.of_bytes[row].update(text)
            if self.kept is not None:
                self.kept[row][0].append(part.astype(np.int32))
                self.kept[row][1].append(text)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded), one row per row of ``docs``.

    Null texts count as empty: no ids, the digests of nothing. Bytes that are
    not valid UTF-8 are read as U+FFFD. Repeated rows give repeated rows; extra
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            c = codec(path, pattern)
            found = Encoded(batch.num_rows, with_ids)
            rows, blocks, size = [], [], 0
            for row, t in enumerate(texts_of(batch, "text")):
                for part in c.pieces(t.decode("utf-8", "replace")):
                    rows.append(row)
                    blocks.append(np.fromiter(map(c.codes.__getitem__, part), np.int64, len(part)))
                    size += min(len(t), BLOCK)
                    if size >= BLOCK:
                        found.add(c, rows, blocks)
                        rows, blocks, size = [], [], 0
                        if len(c.codes) > CACHE:
                            c.forget()
            if rows:
                found.add(c, rows, blocks)
            cols = [
                batch.column(0), pa.array(found.count, pa.int64()),
                pa.array([x.hexdigest() for x in found.of_ids], pa.string()), pa.array([x.hexdigest() for x in found.of_bytes], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                none = np.zeros(0, np.int32)
                cols += [
                    pa.array([np.concatenate(a) if a else none for a, _ in found.kept], pa.list_(pa.int32())),
                    pa.array([b"".join(b).decode("utf-8", "replace") for _, b in found.kept], pa.string()),
                ]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
