"""Licence notices in documents, exact and with few errors.

Text is read as its words, A-Z folded and joined by one space, so line breaks and comment
marks do not matter. Two things are looked for:

* base phrases, whose words stand one after the other;
* notices, short licence sentences of which at most ``errors`` characters were inserted, deleted or replaced.

A notice allowed k errors is cut into k + 1 seeds. Of an occurrence with at most k errors one seed at
least is untouched, so an exact search for all seeds of all notices (one automaton, one pass over the text) gives every
place where an occurrence can lie. The regex library's bounded-error matching then
verifies the few characters around each such place and tells span and errors. No occurrence is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (words, label): fixed values
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: (words, label, errors allowed): opening or naming sentences of public licences
NOTICES = (
    ("under the terms of the gnu general public license", "gpl", 3),
    ("licensed under the gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("you may not use this file except in compliance with the license", "apache", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 3),
    ("released under the mit license", "mit", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 3),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 3),
    ("subject to the terms of the mozilla public license", "mpl", 3),
    ("free and unencumbered software released into the public domain", "unlicense", 3),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 2),
    ("creative commons attribution noderivatives", "cc-by-nd", 2),
    ("cc by nc", "cc-by-nc", 0),  # one letter apart from each other: no error allowed
    ("cc by sa", "cc-by-sa", 0),
    ("cc by nd", "cc-by-nd", 0),
)

SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,notice:int,start:long,end:long,word:long,errors:int>>"
)
_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("notice", pa.int32()),
                        ("start", pa.int64()),
                        ("end", pa.int64()),
                        ("word", pa.int64()),
                        ("errors", pa.int32()),
                    ]
                )
            ),
        ),
    ]
)
#: every byte that stands between words becomes a space, A-Z become a-z
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: bytes) -> tuple[bytes, int]:
    """Words joined by one space, with one at either end, and their number."""
    found = text.translate(_FOLD).split()
    return b" " + b" ".join(found) + b" ", len(found)


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of a notice of nearly equal length, each with its offset."""
    parts = errors + 1
    cuts = [len(notice) * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    """Searches texts for phrases and notices; one per task."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases, self.notices = phrases, notices
        wanted: dict[str, list[tuple[bool, int, int]]] = {}
        for k, (words, _) in enumerate(phrases):
            wanted.setdefault(f" {words} ", []).append((True, k, 0))
        for k, (words, _, errors) in enumerate(notices):
            if errors >= len(words):
                raise ValueError(f"{words!r} would match anything with {errors} errors")
            for offset, seed in seeds(words, errors):
                wanted.setdefault(seed, []).append((False, k, offset))
        self.automaton = ahocorasick.Automaton()
        for word, uses in wanted.items():
            self.automaton.add_word(word, (len(word), uses))
        self.automaton.make_automaton()
        patterns = [regex.compile(f"(?b)(?:{regex.escape(words)}){{e<={errors}}}") for words, _, errors in notices]

        @lru_cache(maxsize=20_000)
        def verify(k: int, part: str) -> tuple[int, int, int] | None:
            found = patterns[k].search(part)
            return found and (found.start(), found.end(), sum(found.fuzzy_counts))

        self.verify = verify

    def find(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places (start, phrase) and verified notices (notice, start, end, errors) in a normalised text.

        Of overlapping finds of one notice the one with fewest errors stays, then the first.
        """
        places: list[tuple[int, int]] = []
        candidates: set[tuple[int, int]] = set()
        for last, (size, uses) in self.automaton.iter(text):
            first = last + 1 - size
            for base, k, offset in uses:
                if base:
                    places.append((first, k))
                else:
                    candidates.add((k, first - offset))
        found: set[tuple[int, int, int, int]] = set()
        for k, at in candidates:
            words, _, errors = self.notices[k]
            begin = max(at - errors, 0)
            got = self.verify(k, text[begin : at + len(words) + errors])
            if got:
                found.add((k, got[2], begin + got[0], begin + got[1]))
        kept: list[tuple[int, int, int, int]] = []
        for k, spans in _by_notice(sorted(found)):
            kept += [(k, start, end, errors) for errors, start, end in _apart(spans)]
        return places, sorted(kept, key=lambda f: (f[1], f[0]))

    def row(self, key: int | None, text: bytes | None) -> dict:
        """The result row of one document."""
        joined, n_words = normalised(text or b"")
        folded = joined.decode("utf-8", "replace")
        places, found = self.find(folded)
        starts = _word_numbers(folded, sorted({p for p, _ in places} | {s for _, s, _, _ in found} | {e - 1 for _, _, e, _ in found}))
        spans = []
        if found:
            original = [m.span() for m in _WORD.finditer((text or b"").decode("utf-8", "replace"))]
            for k, start, end, errors in found:
                a, b = starts[start], starts[end - 1]
                if folded[end - 1] == " ":
                    b -= 1
                spans.append(
                    {"label": self.notices[k][1], "notice": k, "start": original[a][0],
                     "end": original[max(a, b)][1], "word": a, "errors": errors}
                )
        base = {self.phrases[k][1] for _, k in places}
        at = [starts[p] for p, _ in places]
        close = [1 - errors / len(self.notices[k][0]) for k, _, _, errors in found]
        return {
            "id": key,
            "n_words": n_words,
            "n_base": len(places),
            "first_word": min(at, default=None),
            "last_word": max(at, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s["label"] for s in spans})),
            "score": 1.0 if base else max(close, default=0.0),
            "spans": spans,
        }


def _by_notice(found: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for k, errors, start, end in found:
        groups.setdefault(k, []).append((errors, start, end))
    yield from groups.items()


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that do not overlap, from (errors, start, end) in order of preference.

    Every span is shorter than twice the notice, so a chosen one can only meet those that begin in its own or a
    neighbouring stretch of that length.
    """
    width = max(end - start for _, start, end in spans)
    taken: dict[int, list[tuple[int, int]]] = {}
    out = []
    for errors, start, end in spans:
        near = (s for slot in (start // width - 1, start // width, start // width + 1) for s in taken.get(slot, ()))
        if all(end <= a or b <= start for a, b in near):
            taken.setdefault(start // width, []).append((start, end))
            out.append((errors, start, end))
    return out


def _word_numbers(text: str, places: list[int]) -> dict[int, int]:
    """The word at each of some sorted places of a normalised text; at a space, the word that follows."""
    out, spaces, done = {}, 0, 0
    for p in places:
        spaces += text.count(" ", done, p + 1)
        done = p + 1
        out[p] = spaces - 1
    return out


def _scan(phrases, notices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for first in range(0, batch.num_rows, 2000):
                keys = batch.column(0).slice(first, 2000).to_pylist()
                rows = [scanner.row(k, t.as_py()) for k, t in zip(keys, texts.slice(first, 2000), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for every row of ``docs``: base places, labels, score and the spans of notices.

    n_base counts all places of base phrases; first_word and last_word are the least and greatest of their starts (null
    if none). labels holds base labels and those of notices, sorted. score is 1 with a base phrase, else the best
    1 - errors / length of a notice, else 0. A span gives start and end in code points of the document, its first word and its
    errors; a half-covered word counts whole. Null and empty texts have no words and no labels; null ids are carried
    through; rows that repeat an id give a row each. Other columns of ``docs`` are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_scan(phrases, notices), SCHEMA).withColumnRenamed("id", id_col)
