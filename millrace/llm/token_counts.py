"""Edit-aware token counts: a balanced tree of pre-token segments per document.

Each node holds a segment of about SEGMENT pre-tokens, and the characters, tokens
and segments of its subtree. A pre-token depends on its own text and on CONTEXT
characters after it. So an edit re-encodes from the segment of the pre-token that
such a distance before it may touch, until a pre-token starts where an untouched
segment does; as nothing before its start matters to a pre-token, all later
segments stand. The tree is split and joined around the new segments, which
renews only the sums on the paths there, logarithmic in the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices, texts_of

SEGMENT = 32
#: A property of the pattern: characters after a pre-token that its end depends on.
CONTEXT = 2
#: Pre-tokens whose counts a worker remembers.
CACHE = 700_000
_held: dict = {}


class Counts(dict):
    """Tokens of pre-tokens, remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n = len(self.encode(piece))
        return n


def encoding(path: str, pattern: str):
    """(pre-tokens of a text, tokens of a pre-token), once per Python process."""
    if (path, pattern) not in _held:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _held[path, pattern] = (regex.compile(pattern).findall, Counts(e.encode_ordinary).__getitem__)
    return _held[path, pattern]


class Node:
    """A segment with the sums of its subtree."""

    __slots__ = ("left", "right", "text", "n", "chars", "tokens", "size")

    def __init__(self, text: str, n: int):
        self.left = self.right = None
        self.text, self.n = text, n
        self.renew()

    def renew(self) -> Node:
        self.chars, self.tokens, self.size = len(self.text), self.n, 1
        for child in (self.left, self.right):
            if child is not None:
                self.chars += child.chars
                self.tokens += child.tokens
                self.size += child.size
        return self


def built(nodes: list[Node], low: int = 0, high: int | None = None) -> Node | None:
    """A balanced tree of fresh nodes in their order."""
    high = len(nodes) if high is None else high
    if low >= high:
        return None
    middle = (low + high) // 2
    root = nodes[middle]
    root.left, root.right = built(nodes, low, middle), built(nodes, middle + 1, high)
    return root.renew()


def in_order(node: Node | None) -> Iterator[Node]:
    path = []
    while path or node is not None:
        while node is not None:
            path.append(node)
            node = node.left
        node = path.pop()
        yield node
        node = node.right


class SegmentTree:
    """Token counts of a text under edits. The pattern must match every character."""

    def __init__(self, text: str, path: str, pattern: str):
        self.find, self.count = encoding(path, pattern)
        self._dice = 1
        #: segments encoded so far, and nodes whose sums were renewed by the last edit
        self.root = built(self.segments(self.find(text)))
        self.renewed = 0

    def segments(self, pieces: list[str]) -> list[Node]:
        return [Node("".join(part := pieces[i : i + SEGMENT]), sum(map(self.count, part))) for i in range(0, len(pieces), SEGMENT)]

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    def __len__(self) -> int:
        return self.root.size if self.root else 0

    def _renew(self, node: Node) -> Node:
        self.renewed += 1
        return node.renew()

    def _join(self, a: Node | None, b: Node | None) -> Node | None:
        """Both trees as one; the root is drawn in proportion to their sizes, which keeps it balanced."""
        if a is None or b is None:
            return a or b
        self._dice = self._dice * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        if (self._dice >> 33) % (a.size + b.size) < a.size:
            a.right = self._join(a.right, b)
            return self._renew(a)
        b.left = self._join(a, b.left)
        return self._renew(b)

    def _split(self, node: Node | None, k: int) -> tuple[Node | None, Node | None]:
        """(the first ``k`` segments, the others)."""
        if node is None:
            return None, None
        before = node.left.size if node.left else 0
        if k <= before:
            a, node.left = self._split(node.left, k)
            return a, self._renew(node)
        node.right, b = self._split(node.right, k - before - 1)
        return self._renew(node), b

    def segment_at(self, at: int) -> tuple[int, int]:
        """(number of the segment that holds character ``at``, or of the last one; its first character)."""
        node, k, start = self.root, 0, 0
        while True:
            left = node.left
            if left is not None and at < start + left.chars:
                node = left
                continue
            if left is not None:
                k, start = k + left.size, start + left.chars
            if at < start + len(node.text) or node.right is None:
                return k, start
            k, start, node = k + 1, start + len(node.text), node.right

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters at ``at``; returns how many segments were encoded again."""
        self.renewed = 0
        if self.root is None:
            self.root = built(self.segments(self.find(inserted)))
            return len(self)
        first, start = self.segment_at(max(at - CONTEXT, 0))
        before, rest = self._split(self.root, first)
        old = ""
        while rest is not None and (not old or len(old) < at - start + removed):
            taken, rest = self._split(rest, 1)
            old += taken.text
        text = old[: at - start] + inserted + old[at - start + removed :]
        while True:
            after = ""
            for node in in_order(rest):
                after += node.text
                if len(after) >= CONTEXT:
                    break
            pieces, end = [], 0
            for piece in self.find(text + after):
                if end >= len(text):
                    break
                pieces.append(piece)
                end += len(piece)
            # further segments are taken in until a pre-token starts where one of them does and small ones are made up
            if rest is None or (end == len(text) and len(pieces) >= SEGMENT // 2):
                break
            taken, rest = self._split(rest, 1)
            text += taken.text
        new = self.segments(pieces)
        self.root = self._join(self._join(before, built(new)), rest)
        return len(new)


def edits_of(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: a word put in the middle, the first word removed, two joined at a quarter."""
    n = len(text)
    word = len(text) - len(text.lstrip()) + len((text.split(None, 1) or [""])[0])
    return [(n // 2, 0, " edited 42"), (0, word, ""), (n // 4, min(2, max(n - word - n // 4, 0)), "'s\n")]


def applied(text: str, edits: list[tuple[int, int, str]]) -> str:
    for at, removed, inserted in edits:
        at = min(at, len(text))
        text = text[:at] + inserted + text[at + removed :]
    return text


def count_edited(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_segments, n_encoded (segments encoded again by the edits), one row per row.

    Null texts count as empty. Bytes that are not valid UTF-8 are read as
    U+FFFD. Repeated rows give repeated rows; extra columns are ignored; an
    empty table gives no rows.
    """

    def one(text: str) -> tuple[int, int, int, int]:
        tree = SegmentTree(text, path, pattern)
        before, size, again, n = tree.total, len(tree), 0, len(text)
        for at, removed, inserted in edits_of(text):
            at = min(at, n)
            removed = min(removed, n - at)
            again += tree.edit(at, removed, inserted)
            n += len(inserted) - removed
        return before, tree.total, size, again

    def run(batches):
        for batch in batches:
            for part in small_slices(batch, "text"):
                rows = [one(t.decode("utf-8", "replace")) for t in texts_of(part, "text")]
                cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_tokens", "n_tokens_edited", "n_segments", "n_encoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_tokens_edited long, n_segments long, n_encoded long"
    )
