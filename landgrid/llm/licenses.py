"""License scans by a positional index of rare words."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.common import rows_at_a_time, small_batches

#: Words of a text whose ASCII letters are in lower case: ASCII digits and letters, and all bytes of other characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that name a licence, with the labels that the results must bear.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Wording of public licences and notices, as published: (label, text, phrases that must occur).
TEMPLATES = [
    ("agpl", "GNU Affero General Public License", ("affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the license",)),
    ("artistic-2.0", "The Artistic License 2.0", ("artistic license",)),
    ("bsd", "BSD License", ("bsd license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("bsl-1.0", "Boost Software License", ("boost software license",)),
    ("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0", ("cc by nc nd",)),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0", ("cc by nc sa",)),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    ("creative-commons", "Creative Commons Attribution License", ("creative commons",)),
    ("epl", "Eclipse Public License", ("eclipse public license",)),
    ("gpl-2.0", "GNU General Public License, version 2", ("general public license version 2",)),
    ("gpl-3.0", "GNU General Public License, version 3", ("general public license version 3",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("mpl", "Mozilla Public License", ("mozilla public license",)),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("released into the public domain",)),
]

#: A template is found if its aligned words bear this share of its IDF; words may be displaced by up to SLACK places by edits before them.
COVER, SLACK = 0.75, 4
#: What covers less than this and isn't found isn't reported.
SHOWN = 0.5
#: A word leads to a template if its IDF is at least this share of the template's largest.
RARE = 0.6


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[list[bytes]]
    base: bool
    weight: list[float] = field(default_factory=list)
    need: int = 1


class LicenseIndex:
    """Templates, the IDF of their words over all templates, and postings (template, position) of each template's rare words."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES) -> None:
        self.templates = [Template(label, words_of(p), [words_of(p)], True) for p, label in phrases]
        self.templates += [Template(label, words_of(t), [words_of(p) for p in must], False) for label, t, must in templates]
        df = Counter(w for t in self.templates for w in set(t.words))
        idf = {w: math.log(1 + len(self.templates) / n) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            t.weight = [idf[w] for w in t.words]
            # A phrase is led to by its rarest word alone: every place of the phrase has it once.
            least = max(t.weight) * (1 if t.base else RARE)
            led = [p for p, w in enumerate(t.weight) if w >= least - 1e-12]
            # A template of several rare words is looked at where two of them agree on its start.
            t.need = 2 if len(led) > 2 and not t.base else 1
            for p in led[:1] if t.base else led:
                self.postings[t.words[p]].append((i, p))
        self.idf = idf

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of words, and matches: label, base, start and end in words, coverage of the template's IDF, whether found."""
        words = words_of(text)
        postings = self.postings
        hits = [(i, w) for i, w in enumerate(words) if w in postings]
        if not hits:
            return len(words), []
        starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in sorted(hits, key=lambda h: -self.idf[h[1]]):
            for t, p in postings[w]:
                starts[t].append((i - p, p))
        found = []
        for t, at in starts.items():
            template = self.templates[t]
            if template.base:
                found += self._exact(words, template, {s for s, _ in at})
            elif len(at) >= template.need:
                found += self._near(words, template, sorted(at))
        return len(words), found

    def _exact(self, words: list[bytes], t: Template, at: set[int]) -> list[dict]:
        n = len(t.words)
        return [{"label": t.label, "base": True, "start": s, "end": s + n, "coverage": 1.0, "found": True} for s in sorted(at) if s >= 0 and words[s : s + n] == t.words]

    def _near(self, words: list[bytes], t: Template, led: list[tuple[int, int]]) -> list[dict]:
        """Starts within SLACK of each other are one place; a template word counts if it stands in its place for one of them."""
        out, i, n, at = [], 0, len(t.words), [s for s, _ in led]
        while i < len(at):
            j = i
            while j < len(at) and at[j] <= at[i] + SLACK:
                j += 1
            if len({p for _, p in led[i:j]}) < t.need:
                i += 1
                continue
            near = sorted(set(at[i:j]))
            covered = sum(w for p, w in enumerate(t.weight) if any(0 <= s + p < len(words) and words[s + p] == t.words[p] for s in near)) / sum(t.weight)
            low, high = max(0, at[i] - SLACK), min(len(words), at[j - 1] + n + SLACK)
            whole = covered >= COVER and all(_holds(words, low, high, phrase) for phrase in t.phrases)
            if whole or covered >= SHOWN:
                out.append({"label": t.label, "base": False, "start": max(0, at[i]), "end": min(len(words), at[j - 1] + n), "coverage": min(1.0, covered), "found": whole})
            i = j
        return out


def _holds(words: list[bytes], low: int, high: int, phrase: list[bytes]) -> bool:
    return any(words[s : s + len(phrase)] == phrase for s in range(low, high - len(phrase) + 1))


MATCH = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("found", pa.bool_())])


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, matches array<struct<label, base, start, end, coverage, found>>) of every row.

    Each text's rare licence words, highest IDF first, are looked up; a posting and the word's place give the place at which the
    template would start, and the template's other words are intersected by their position relative to it. A phrase must stand there
    word for word (base). A longer template must bear COVER of its IDF and hold its key phrases; matches that don't, but bear SHOWN,
    are given as not found, with what they cover. Whole texts are read; null counts as empty, and gives no words and no matches.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    index = index or LicenseIndex()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            got = [index.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], pa.list_(MATCH))], ["id", "n_words", "matches"])

    return at.mapInArrow(run, f"id {kind}, n_words bigint, matches array<struct<label: string, base: boolean, start: bigint, end: bigint, coverage: double, found: boolean>>").withColumnRenamed("id", id_col)
