"""License scan: exact phrases and short notices with errors.

A text becomes its words, joined by single spaces. Base phrases are found as they stand. A notice may carry up to k
character edits: it is cut into k + 1 pieces, of which one must stand unharmed (pigeonhole), so an Aho-Corasick pass over
all pieces gives the places to look at, and the regex library's bounded-error matching verifies edits there and gives the
spans. Row by row, without a shuffle; memory is bounded by a batch of texts.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows each keep their row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import without
from .textkit import alnum_words

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and grants of licences, as they are usually worded (words only) -> label. No two are within
#: each other's bound of edits.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0-grant",
    "licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "gnu general public license as published": "gpl-grant",
    "gnu lesser general public license as published": "lgpl-grant",
    "gnu affero general public license as published": "agpl-grant",
    "either version 2 of the license or at your option any later version": "gpl-2.0-or-later",
    "redistribution and use in source and binary forms with or without modification": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc-grant",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "made available under the terms of the eclipse public license": "epl-notice",
    "distributed under the boost software license version 1 0": "boost-1.0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is dedicated to the public domain": "public-domain",
    "creative commons cc0 1 0 universal public domain dedication": "cc0-1.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "creative commons attribution 4 0 international": "cc-by-4.0",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa-4.0",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc-4.0",
    "creative commons attribution noderivatives 4 0 international": "cc-by-nd-4.0",
    "licensed under the european union public licence": "eupl-notice",
    "this font software is licensed under the sil open font license version 1 1": "ofl-1.1-notice",
    "licensed under the academic free license version 3 0": "afl-3.0-notice",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "spdx license identifier apache 2 0": "apache-2.0-spdx",
    "spdx license identifier bsd 3 clause": "bsd-3-clause-spdx",
    "spdx license identifier gpl 3 0 or later": "gpl-3.0-spdx",
}
#: One edit for so many characters of a notice.
CHARS_AN_EDIT = 9
SPAN = "label string, start_word long, end_word long, edits int"
_SPACE = re.compile(" ")
OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
SCHEMA = f"struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,spans:array<struct<{SPAN.replace(' long', ':long').replace(' string', ':string').replace(' int', ':int')}>>>"


def edits_of(notice: str) -> int:
    return len(notice) // CHARS_AN_EDIT - 1


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of about one length, with their offsets."""
    n = edits + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        import ahocorasick
        import regex

        self.phrases = {f" {p} ": label for p, label in phrases.items()}
        self.notices = [(n, label, edits_of(n)) for n, label in notices.items()]
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n)}){{e<={k}}}(?= )") for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for which, (n, _, k) in enumerate(self.notices):
            for offset, piece in pieces(n, k):
                seeds.setdefault(piece, []).append((which, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the merged windows in which a match could stand."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            begin = end - size + 1
            for which, offset in uses:
                n, _, k = self.notices[which]
                # one more character at either end for the spaces around a match
                a, b = max(0, begin - offset - k - 1), begin - offset + len(n) + k + 1
                mine = found.setdefault(which, [])
                if mine and a <= mine[-1][1]:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        return found

    def scan(self, text: str | None) -> tuple:
        words = alnum_words(text)
        joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else ""
        base, places, spaces = set(), [], []

        def word_at(place: int) -> int:
            """Words that begin before a space of the text."""
            if not spaces:
                spaces.extend(m.start() for m in _SPACE.finditer(joined))
            return bisect_left(spaces, place)

        for phrase, label in self.phrases.items():
            at = joined.find(phrase)
            while at >= 0:
                base.add(label)
                places.append(word_at(at))
                at = joined.find(phrase, at + 1)
        labels, spans, score = set(base), [], 1.0 if base else 0.0
        for which, parts in self.windows(joined).items():
            n, label, _ = self.notices[which]
            for a, b in parts:
                for m in self.patterns[which].finditer(joined, a, b):
                    edits = sum(m.fuzzy_counts)
                    labels.add(label)
                    score = max(score, 1 - edits / len(n))
                    spans.append((label, word_at(m.start()) - 1, word_at(m.end()), edits))
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(spans)


def license_scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Every row of docs with n_words, n_base, first_word, last_word, base_labels, labels, score (that of the closest
    match) and spans (label, first word, word after the last, edits)."""

    @F.pandas_udf(SCHEMA)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, notices)
        for part in parts:
            rows = [scanner.scan(t) for t in part]
            out = pd.DataFrame(rows, columns=list(OUTPUT))
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out["spans"] = [[dict(zip(("label", "start_word", "end_word", "edits"), s, strict=True)) for s in r[-1]] for r in rows]
            yield out

    rest = without(docs, *OUTPUT)
    return rest.withColumn("__lic", scan(F.col(text_col))).select(*[F.col(f"`{c}`") for c in rest.columns], "__lic.*")
