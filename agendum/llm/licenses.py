"""License scans: an exact set-similarity join of text blocks with license templates, beside a search for set phrases.

Each template is a set of terms. Over the whole corpus the templates' terms are counted, and sets are ordered from
the rarest term on. With a containment threshold t, a template T is met by a block B if |B & T| >= t |T|; so B holds
one of T's first |T| - ceil(t |T|) + 1 terms (prefix), has at least ceil(t |T|) terms of any template (length), and
at the first shared term both have enough terms left (position). What passes is verified.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm import common

TERM = re.compile(common.TERM)
#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices by which works are put under a license.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "this library is licensed under the gnu lesser general public license": "lgpl",
    "this program is licensed under the gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable": "zlib",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "no rights reserved dedicated to the public domain under cc0": "cc0",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}


@dataclass(frozen=True)
class Index:
    """Templates in the global order: rank of each term, the ranks of each template, how many must be met, and prefix ranks to (template, position)."""

    rank: dict[str, int]
    sets: list[list[int]]
    labels: list[str]
    need: list[int]
    prefix: dict[int, list[tuple[int, int]]]

    @staticmethod
    def of(templates: dict[str, str], counts: dict[str, int], threshold: float) -> Index:
        words = sorted({w for t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: n for n, w in enumerate(words)}
        sets = [sorted({rank[w] for w in t.split()}) for t in templates]
        need = [max(1, ceil(threshold * len(s) - 1e-9)) for s in sets]
        prefix: dict[int, list[tuple[int, int]]] = {}
        for n, s in enumerate(sets):
            for pos, r in enumerate(s[: len(s) - need[n] + 1]):
                prefix.setdefault(r, []).append((n, pos))
        return Index(rank, sets, list(templates.values()), need, prefix)

    def meets(self, block: list[int]) -> dict[int, set[int]]:
        """Templates that a block meets, with the shared ranks; block: sorted distinct ranks of its template terms."""
        checked, found = set(), {}
        for at, r in enumerate(block):
            for n, pos in self.prefix.get(r, ()):
                if n in checked:
                    continue
                checked.add(n)  # at and pos are those of the first shared term
                need = self.need[n]
                if len(block) < need or 1 + min(len(block) - at, len(self.sets[n]) - pos) - 1 < need:
                    continue
                shared = set(block).intersection(self.sets[n])
                if len(shared) >= need:
                    found[n] = shared
        return found


def by_block(templates: dict[str, str], block: int) -> dict[int, dict[str, str]]:
    """Templates by the length of block in which they are looked for: the given one, doubled until the template fills half of it at
    most. So each is looked for whole, and no template changes where another one is looked for."""
    out: dict[int, dict[str, str]] = {}
    for template, label in templates.items():
        size = block
        while 2 * len(template.split()) > size:
            size *= 2
        out.setdefault(size, {})[template] = label
    return out


def find_phrases(terms: list[str], phrases: list[str]) -> list[tuple[int, str]]:
    """(place, phrase) of each phrase's terms standing one after another."""
    held = set(terms)
    out = []
    for phrase in phrases:
        parts = phrase.split()
        if held.issuperset(parts):
            at = -1
            for _ in range(terms.count(parts[0])):
                at = terms.index(parts[0], at + 1)
                if terms[at : at + len(parts)] == parts:
                    out.append((at, phrase))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9, block: int = 48, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and spans (start, end, label, containment) to each row.

    Terms are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased. Blocks are runs of block terms that begin at
    every half block, so that any half block of terms lies in one; a template of more than half a block, a whole license say, has
    blocks of its own, twice, four times and so on as long. Each block that meets a template within threshold
    makes a span, and its label counts unless another template of the block shares those terms and more. n_base counts all places of phrases, first_word and last_word are the first and last (null: none);
    labels are distinct, sorted and joined by commas; score is the highest containment of any template, 1 with a phrase.
    A null or empty text has no terms and empty labels; repeated rows are scanned alike; columns of the added names are replaced; an empty table
    stays empty. Templates travel with the tasks, so their number must stay small (thousands).
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    common.ship(docs.sparkSession)
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kept = common.without(docs, added)
    vocabulary = sorted({w for t in templates for w in t.split()})
    terms = F.split(common.ascii_lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = F.explode(F.array_intersect(terms, F.array(*[F.lit(w) for w in vocabulary])))
    counts = docs.select(held.alias("word")).groupBy("word").count().collect()  # a row for each word of the templates at most
    counts = {r["word"]: r["count"] for r in counts}
    indexes = {size: Index.of(some, counts, threshold) for size, some in sorted(by_block(templates, block).items())}

    def look(text: str | None):
        words = TERM.findall((text or "").translate(common.ASCII_LOWER))
        hits = find_phrases(words, list(phrases))
        base = {phrases[p] for _, p in hits}
        labels, score, spans = set(base), 1.0 if hits else 0.0, []
        for size, index in indexes.items():
            if index.rank.keys().isdisjoint(words):
                continue
            ranks = [index.rank.get(w, -1) for w in words]
            places = np.flatnonzero(np.isin(np.array(ranks), list(index.prefix)))
            half = size // 2
            for b in sorted({s for p in (places // half).tolist() for s in (p - 1, p) if s >= 0}):
                part = sorted(set(ranks[b * half : b * half + size]) - {-1})
                met = index.meets(part)
                for n in sorted(met):
                    share = len(met[n]) / len(index.sets[n])
                    spans.append({"start": b * half, "end": min(len(words), b * half + size), "label": index.labels[n], "containment": share})
                    score = max(score, share)
                    if not any(met[n] < other for other in met.values()):
                        labels.add(index.labels[n])
        at = [p for p, _ in hits]
        return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, containment: double>>"

    @F.pandas_udf(schema)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([look(t) for t in texts], columns=added)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    found = common.fresh(docs, "found")
    out = docs.select(*[F.col(f"`{c}`") for c in kept], scanned(F.col(f"`{text}`").cast("string")).alias(found))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(found)[c].alias(c) for c in added])
