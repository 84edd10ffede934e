"""Personal data: fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on labelled spans (invented texts with e-mail
addresses, network addresses, card and phone numbers in many notations). Texts
are cut into overlapping windows; each is decoded by Viterbi, and all windows of
a text are reconciled into one sequence: each character has its tag from the
window in whose middle it stands, and spans, however long, are that sequence's
runs. Pattern matches stay; runs that overlap none are added. ``valid`` demands
an at sign or a digit of every kind, so decoding starts at the windows of these
characters and goes on to neighbours as long as a run reaches their border;
nothing is lost by passing over the others.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_slices, texts_of

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
WINDOW, STEP = 96, 48
#: Characters between a window's start and its middle part of STEP characters.
EDGE = (WINDOW - STEP) // 2
#: Windows that are decoded at once.
BATCH = 512
HIDDEN, EMBED, SYMBOLS = 14, 12, 132
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def window_of(at):
    """The window in whose middle a character stands, or the first."""
    return np.maximum((np.asarray(at) - EDGE) // STEP, 0)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """Whether the string may stand for its kind."""
    d = digits_of(s)
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not set(s) - set("0123456789 -")
    if kind == "phone":
        return 9 <= len(d) <= 15 and not set(s) - set("0123456789+(). -")
    return "@" in s.strip("@") and not re.search(r"\s", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, non-overlapping per kind, linear in the text."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if m and start < at:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def symbols(text: str) -> np.ndarray:
    """Code points as symbols: ASCII itself, other letters, digits and marks one symbol each."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(cp < 128, cp, np.where(cp < 0x2000, 128, 129)).astype(np.int64)


def example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """An invented text and its labelled spans (kind, start, end)."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = ("an", "re", "tion", "the", "or", "el", "ß", "ñe", "ch", "ou", "st", "wh")
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    text, spans = "", []
    while len(text) < WINDOW:
        kind = rng.integers(0, 9)
        s = word()
        if kind == 0:
            s = f"{word()}{pick(('', '.', '_', '+'))}{number(rng.integers(0, 3))}@{pick(('', 'mail', word()))}{number(1)}.{word()}{pick(('', '.com', '.org'))}"
            s = s.replace("ß", "s").replace("ñ", "n")
        elif kind == 1:
            s = ".".join(str(x) for x in rng.integers(0, 256, 4))
        elif kind == 2:
            d = number(15)
            d += next(str(k) for k in range(10) if luhn(d + str(k)))
            s = pick(("", " ", "-")).join(d[i : i + 4] for i in range(0, 16, 4))
        elif kind == 3:
            a, b, c = number(3), number(3), number(4)
            s = pick((f"+1 {a} {b} {c}", f"+{number(2)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}-{b}-{c}"))
        elif kind == 4:
            s = pick((number(rng.integers(1, 9)), f"{number(2)}.{number(2)}", f"v{number(1)}.{number(1)}.{number(1)}", f"20{number(2)}-{number(2)}-{number(2)}", f"@{word()}", rng.bytes(8).hex(), f"{number(2)}:{number(2)}"))
        if kind < 4:
            spans.append((int(kind), len(text), len(text) + len(s)))
        text += s + pick((" ", " ", ", ", ". ", "\n", "### "))
    return text[:WINDOW], [(k, a, min(b, WINDOW)) for k, a, b in spans if a < WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN) of inputs (time, batch, EMBED), and what the gradient needs if asked to keep it."""
    h = c = np.zeros((x.shape[1], HIDDEN), x.dtype)
    out, kept = np.empty((*x.shape[:2], HIDDEN), x.dtype), []
    z = x @ wx + b
    for t in range(len(x)):
        a = z[t] + h @ wh
        s = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        th = np.tanh(c)
        if keep:
            kept.append((i, f, o, g, before, th, h))
        h = out[t] = o * th
    return out, kept


def _lstm_back(x, wx, wh, kept, dout):
    """Gradients of inputs, weights and bias."""
    dx, dwx, dwh, db = np.empty_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, x.dtype)
    dh = dc = np.zeros((x.shape[1], HIDDEN), x.dtype)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, th, h = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - th * th)
        da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
        dx[t] = da @ wx.T
        dwx += x[t].T @ da
        dwh += h.T @ da
        db += da.sum(0)
        dh, dc = da @ wh.T, dc * f
    return dx, dwx, dwh, db


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def emissions(p: dict, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Tag scores (time, batch, TAGS) of symbols (time, batch), and what the gradient needs if asked to keep it."""
    x = p["embed"][ids]
    a, ka = _lstm(x, p["wx0"], p["wh0"], p["b0"], keep)
    b, kb = _lstm(x[::-1], p["wx1"], p["wh1"], p["b1"], keep)
    h = np.concatenate([a, b[::-1]], 2)
    return h @ p["out"] + p["bias"], (x, ka, kb, h)


def _crf(e: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by emissions and transitions (forward-backward)."""
    n, m, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, n):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    dt = np.zeros_like(trans)
    for t in range(n - 1):
        dt += np.exp(alpha[t][:, :, None] + trans + (e[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None]).sum(0)
    de[np.arange(n)[:, None], np.arange(m)[None, :], tags] -= 1
    np.add.at(dt, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    return de / m, dt / m


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (time, batch)."""
    n, m, _ = e.shape
    back, score = np.empty(e.shape, np.int8), e[0]
    for t in range(1, n):
        s = score[:, :, None] + trans
        back[t] = s.argmax(1)
        score = s.max(1) + e[t]
    out = np.empty((n, m), np.int64)
    out[-1] = score.argmax(1)
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t][np.arange(m), out[t]]
    return out


_trained: dict[tuple[int, int], dict] = {}


def train(steps: int = 220, seed: int = 7, batch: int = 32) -> dict:
    """Weights after ``steps`` of Adam on labelled spans; the same for the same arguments, once per process."""
    if (steps, seed) in _trained:
        return _trained[steps, seed]
    rng = np.random.default_rng(seed)
    w = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {"embed": w(SYMBOLS, EMBED) * 8, "out": w(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for d in "01":
        p |= {"wx" + d: w(EMBED, 4 * HIDDEN), "wh" + d: w(HIDDEN, 4 * HIDDEN), "b" + d: np.zeros(4 * HIDDEN, np.float32)}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        ids, tags = np.zeros((WINDOW, batch), np.int64), np.zeros((WINDOW, batch), np.int64)
        for j in range(batch):
            text, spans = example(rng)
            ids[:, j] = symbols(text)
            for kind, a, b in spans:
                tags[a:b, j] = 2 + 2 * kind
                tags[a, j] = 1 + 2 * kind
        e, (x, ka, kb, h) = emissions(p, ids, True)
        de, dt = _crf(e, p["trans"], tags)
        g = {"trans": dt, "out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum((0, 1))}
        dh = de @ p["out"].T
        dxa, g["wx0"], g["wh0"], g["b0"] = _lstm_back(x, p["wx0"], p["wh0"], ka, dh[:, :, :HIDDEN])
        dxb, g["wx1"], g["wh1"], g["b1"] = _lstm_back(x[::-1], p["wx1"], p["wh1"], kb, dh[::-1, :, HIDDEN:])
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], ids, dxa + dxb[::-1])
        norm = np.sqrt(sum(float((y * y).sum()) for y in g.values()))
        for k in p:
            y = g[k] * min(1.0, 10 / max(norm, 1e-6))
            m[k] = 0.9 * m[k] + 0.1 * y
            v[k] = 0.99 * v[k] + 0.01 * y * y
            p[k] -= (0.03 * (1 - step / (steps + 1)) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    _trained[steps, seed] = p
    return p


@dataclass
class Tagger:
    """Finds spans of texts with trained weights."""

    weights: dict

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """The tag of each character, 0 where nothing was decoded."""
        marks = [symbols(t).astype(np.uint8) for t in texts]
        out = [np.zeros(len(t), np.uint8) for t in texts]
        last = [window_of(len(t) - 1) for t in texts]
        todo = {(k, int(j)) for k, x in enumerate(marks) for j in np.unique(window_of(np.flatnonzero((x >= 48) & (x < 58) | (x == 64))))}
        done: set[tuple[int, int]] = set()
        while todo:
            part = sorted(todo)[:BATCH]
            done.update(part)
            ids = np.full((WINDOW, len(part)), 10, np.int64)
            for col, (k, j) in enumerate(part):
                x = marks[k][STEP * j : STEP * j + WINDOW]
                ids[: len(x), col] = x
            found = viterbi(emissions(self.weights, ids)[0], self.weights["trans"])
            for col, (k, j) in enumerate(part):
                a, b = (STEP * j + EDGE if j else 0), STEP * j + EDGE + STEP
                out[k][a:b] = (own := found[a - STEP * j : b - STEP * j, col])[: len(out[k]) - a]
                if j and own[0] and (k, j - 1) not in done:
                    todo.add((k, j - 1))
                if j < last[k] and own[-1] and (k, j + 1) not in done:
                    todo.add((k, j + 1))
            todo.difference_update(part)
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """All spans of each text, by kind, then start."""
        out = []
        for text, t in zip(texts, self.tags(texts)):
            kind = (t + 1) // 2
            before = np.concatenate([[0], kind[:-1]]) if len(t) else kind
            starts = np.flatnonzero((kind > 0) & ((kind != before) | (t % 2 == 1)))
            stops = np.flatnonzero((kind != before) | (t % 2 == 1))
            ends = np.append(stops, len(t))[np.searchsorted(stops, starts, "right")]
            found = [(KINDS[kind[a] - 1], a, b) for a, b in zip(starts.tolist(), ends.tolist())]
            out.append(self.reconciled(text, found))
        return out

    def reconciled(self, text: str, found: list) -> list[tuple[str, int, int]]:
        """Pattern matches, then the network's whole and plausible spans that lie over none of them."""
        out = base_spans(text)
        # pattern matches of different kinds may overlap each other: all stay
        taken = sorted((a, b) for _, a, b in out)
        reach = list(accumulate((b for _, b in taken), max))
        for kind, a, b in found:
            whole = not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())
            k = bisect_left(taken, (b,))
            if whole and not (k and reach[k - 1] > a) and valid(kind, text[a:b]):
                out.append((kind, a, b))
        return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans replaced by its first kind in brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row per row of ``docs``.

    Counts and digest are those of the pattern matches. Null texts count as
    empty: no spans. Repeated rows give repeated rows; extra columns are
    ignored; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        tagger = Tagger(held.value)
        for batch in batches:
            for part in small_slices(batch, "text", 1_000_000):
                texts = [t.decode("utf-8", "replace") for t in texts_of(part, "text")]
                spans, counts, digests = tagger.spans(texts), [], []
                for t in texts:
                    base = sorted(base_spans(t), key=lambda x: (KINDS.index(x[0]), x[1]))
                    counts.append([sum(b[0] == k for b in base) for k in KINDS])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * 4)], pa.array(digests, pa.string()), pa.array(map(_joined, spans), pa.string())],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in their texts; null texts stay null, all columns as they were.

    Bytes that are not valid UTF-8 become U+FFFD.
    """
    held = docs.sparkSession.sparkContext.broadcast(train())

    def make(name):
        def run(batches):
            tagger = Tagger(held.value)
            for batch in batches:
                at = batch.schema.get_field_index(name)
                for part in small_slices(batch, name, 1_000_000):
                    there = part.column(at).is_valid().to_pylist()
                    texts = [t.decode("utf-8", "replace") for t in texts_of(part, name)]
                    new = [masked(t, s) if ok else None for ok, t, s in zip(there, texts, tagger.spans(texts))]
                    yield pa.RecordBatch.from_arrays([pa.array(new, c.type) if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)

        return run

    return map_rows(docs, make)
