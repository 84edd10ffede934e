"""Licence scan by Dice coefficient over word bigrams (native: DataFrame functions only).

Templates are short notices, whole licence texts and their paragraphs. A text's
units are its lines, its sentences (across line ends), its paragraphs and the
whole of it; in a sentence that is too long for a notice, so are the runs of as
many words as the notice has. A unit whose
set of word bigrams A and a template's set B have 2|A n B| / (|A| + |B|) >= t
matches. That needs t/(2-t) |B| <= |A| <= (2-t)/t |B|, which prunes templates by
size, and it needs at least t/(2-t) |B| shared bigrams, so any |B| - that + 1
bigrams of B must be hit: texts with none of a few stems out of those bigrams
can't match and are passed over without loss.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

THRESHOLD = 0.8

#: Bigrams of a licence text's paragraph that count as a template of its own; fewer are headings.
LEAST_PARAGRAPH = 20

#: Names and short notices of public licences.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normalised(text: str) -> list[str]:
    """The words of a template, as the expressions below make those of a text."""
    return [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]


def bigrams_of(text: str) -> list[str]:
    w = normalised(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def least_and_most(size: int, t: float = THRESHOLD) -> tuple[int, int]:
    """Sizes of A that can reach Dice t with |B| = size."""
    return math.ceil(t / (2 - t) * size - 1e-9), math.floor((2 - t) / t * size + 1e-9)


def licence_texts() -> dict[str, str]:
    """The whole texts beside this file (name-text) and their paragraphs (name-text#number), of equal ones the first."""
    out, seen = {}, set()
    for path in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        for k, part in enumerate([text, *re.split(r"\n\s*\n", text)]):
            grams = tuple(bigrams_of(part))
            if grams not in seen and (not k or len(grams) >= LEAST_PARAGRAPH):
                seen.add(grams)
                out[f"{path.stem}-text" + (f"#{k}" if k else "")] = part
    return out


TEMPLATES = NOTICES | licence_texts()


def stems(templates: dict[str, str], t: float = THRESHOLD) -> list[str]:
    """Strings of which every text with a match holds at least one: for each template they cover |B| - least + 1 bigrams."""
    under: dict[str, dict[str, set[str]]] = {}  # bigrams of each template by their words
    left, done = {}, {name: set() for name in templates}
    for name, x in templates.items():
        b = bigrams_of(x)
        left[name] = len(b) - least_and_most(len(b), t)[0] + 1 if b else 0
        for g in b:
            for w in g.split(" "):
                under.setdefault(w, {}).setdefault(name, set()).add(g)

    def gain(w: str) -> int:
        total = sum(min(max(left[name], 0), len(g - done[name])) for name, g in under[w].items())
        return total * min(len(w), 7)  # longer stems are rarer in prose

    chosen: list[str] = []
    while any(n > 0 for n in left.values()):
        chosen.append(max(sorted(under), key=gain))
        for name, g in under[chosen[-1]].items():
            left[name] -= len(g - done[name])
            done[name] |= g
    return chosen


def _bigrams(words: Column) -> Column:
    return F.when(
        F.size(words) >= 2,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, t: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units (matching units), licenses (their best templates, comma-joined), best_license, best_dice.

    One row per row of ``docs``, repeated rows too. Null and empty texts match
    nothing (0 units, empty licenses, null best). Ties go to the first name.
    Extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.lower(text)
    may = None
    for s in stems(templates, t):
        may = F.contains(lower, F.lit(s)) if may is None else may | F.contains(lower, F.lit(s))

    rows = []
    for k, (name, x) in enumerate(sorted(templates.items())):
        b = bigrams_of(x)
        low, high = least_and_most(len(b), t)
        values = {"low": low, "high": high, "rank": -k, "name": name, "words": len(normalised(x)) if name in NOTICES else 0}
        rows.append(F.struct(*[F.lit(v).alias(n) for n, v in values.items()], F.split(F.lit("\n".join(b)), "\n").alias("b")))
    known = F.array(*rows)  # folded to one value
    short = F.array(*[r for r, (name, _) in zip(rows, sorted(templates.items())) if name in NOTICES] or [F.lit(None).cast("struct<low:int,high:int,rank:int,name:string,words:int,b:array<string>>")])
    every = sorted({g for x in templates.values() for g in bigrams_of(x)})
    noted = sorted({g for n, x in templates.items() if n in NOTICES for g in bigrams_of(x)})
    least = min((least_and_most(len(bigrams_of(x)), t)[0] for n, x in templates.items() if n in NOTICES), default=1)
    dice = lambda grams, x: 2.0 * F.size(F.array_intersect(grams, x["b"])) / (F.size(grams) + F.size(x["b"]))

    def scored(found: Column) -> Column:
        """The largest (dice, name) of those that reach t, by name upwards on ties, or null."""
        return F.array_max(F.filter(found, lambda x: x["dice"] >= t))

    def best(grams: Column) -> Column:
        """A unit's best template as a whole."""
        fits = F.filter(known, lambda x: F.size(grams).between(x["low"], x["high"]))
        scores = F.transform(fits, lambda x: F.struct(dice(grams, x).alias("dice"), x["rank"].alias("rank"), x["name"].alias("name")))
        # a match shares t / (2 - t) of the unit's own bigrams too
        return F.when(F.size(F.filter(grams, lambda g: g.isin(every))) >= t / (2 - t) * F.size(grams) - 1e-9, scored(scores))

    def inside(words: Column, grams: Column) -> Column:
        """The best notice among the runs of its length in a longer sentence."""
        def top(x: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(words) - x["words"] + 1)
            return F.array_max(F.transform(starts, lambda i: let(_bigrams(F.slice(words, i, x["words"])), lambda g: dice(g, x))))

        # few sentences hold as many of the notices' bigrams as the least of them needs
        may_hold = F.size(F.filter(grams, lambda g: g.isin(noted))) >= least
        held = F.filter(short, lambda x: (F.size(grams) > x["high"]) & (F.size(words) > x["words"]) & (F.size(F.array_intersect(grams, x["b"])) >= x["low"]))
        return F.when(may_hold, scored(F.transform(held, lambda x: F.struct(top(x).alias("dice"), x["rank"].alias("rank"), x["name"].alias("name")))))

    sentences = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, "\n\n+", "\u0001"), "\n", " "), r"([.!?;:])\s+", "$1\u0001"), "\u0001")
    sentences = F.array_distinct(F.transform(sentences, F.trim))
    others = F.array_except(F.concat(F.split(lower, "\n"), F.split(lower, "\n\n+"), F.array(lower)), sentences)
    words = lambda u: F.array_remove(F.split(F.regexp_replace(u, r"[^\p{L}\p{N}]+", " "), " "), "")
    whole = F.transform(others, lambda u: let(words(u), lambda w: let(_bigrams(w), best)))
    parts = F.transform(sentences, lambda u: let(words(u), lambda w: let(_bigrams(w), lambda g: F.coalesce(best(g), inside(w, g)))))
    found = F.filter(F.concat(parts, whole), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<dice:double,rank:int,name:string>>")
    hits = docs.select("doc_id", F.when(may, found).otherwise(none).alias("found"))
    top = F.array_max("found")
    return hits.select(
        "doc_id",
        F.size("found").cast("long").alias("n_units"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.name"))), ",").alias("licenses"),
        top["name"].alias("best_license"),
        F.round(top["dice"], 6).alias("best_dice"),
    )


def oracle(templates: dict[str, str] = NOTICES, t: float = THRESHOLD) -> str:
    """The scan without any pruning, as DuckDB SQL; by default of the notices alone."""
    values = ", ".join(
        "('" + name + "', [" + ", ".join("'" + g.replace("'", "''") + "'" for g in bigrams_of(x)) + f"], {len(normalised(x))}, {least_and_most(len(bigrams_of(x)), t)[0]}, {least_and_most(len(bigrams_of(x)), t)[1]})"
        for name, x in templates.items()
    )
    return rf"""
WITH templates(name, b, n, low, high) AS (VALUES {values}), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS t FROM documents
), marked AS (
  SELECT rid, t, list_distinct(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '\n\n+', chr(1), 'g'), '\n', ' ', 'g'), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x))) AS sentences FROM docs
), units AS (
  SELECT rid, 1 AS sentence, unnest(sentences) AS u FROM marked
  UNION ALL
  SELECT rid, 0, unnest(list_filter(list_distinct(list_concat(string_split(t, chr(10)), string_split_regex(t, '\n\n+'), [t])), lambda x: NOT list_contains(sentences, x))) FROM marked
), words AS (
  SELECT rid, u, sentence, list_filter(string_split(regexp_replace(u, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM units
), grams AS (
  SELECT rid, u, sentence, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM words
), wholly AS (
  SELECT rid, u, name, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM grams, templates
), longer AS (
  SELECT rid, u, name, n, w, b, high FROM grams, templates
  WHERE sentence = 1 AND len(a) > high AND len(w) > n AND len(list_intersect(a, b)) >= low
  AND (rid, u) NOT IN (SELECT (rid, u) FROM wholly WHERE dice >= {t})
), run AS (
  SELECT rid, u, name, b, list_distinct(list_transform(range(1, n), lambda i: v[i] || ' ' || v[i + 1])) AS a
  FROM (SELECT rid, u, name, n, b, unnest(list_transform(range(1, len(w) - n + 2), lambda s: w[s : s + n - 1])) AS v FROM longer)
), scored AS (
  SELECT * FROM wholly UNION ALL SELECT rid, u, name, max(2.0 * len(list_intersect(a, b)) / (len(a) + len(b))) FROM run GROUP BY ALL
), best AS (
  SELECT * FROM scored WHERE dice >= {t} QUALIFY row_number() OVER (PARTITION BY rid, u ORDER BY dice DESC, name) = 1
), per AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, arg_min(name, (-dice, name)) AS top, max(dice) AS dice
  FROM best GROUP BY rid
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_units, coalesce(names, '') AS licenses, top AS best_license, round(dice, 6)::DOUBLE AS best_dice
FROM docs LEFT JOIN per USING (rid)
"""
