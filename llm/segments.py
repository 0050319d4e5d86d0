"""Parts of texts that byte-level vocabularies encode apart from each other.

A text is cut at every space between two other characters. The pattern of such vocabularies always ends a
token before such a space, so the ids of a text are those of its segments, each with that space in front. It also ends
one between a letter and punctuation; where no entry joins them either, no merge does.
"""

from __future__ import annotations

import re
import string

SEGMENTS = 300_000  # segments whose ids a task remembers
TOGETHER = 200  # new segments encoded as one text
LETTERS = frozenset(string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))
PUNCTUATION = string.punctuation
# a byte that ends one of LETTERS and ASCII punctuation after it
PUNCTUATED = re.compile(rb"(?:[A-Za-z]|(?:^|\xc3)[\x80-\xbf])[!-/:-@\[-`{-~]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str) -> list[str]:
    """Parts of a text, cut at every space between two other characters; that space is left out."""
    return _BETWEEN.split(text)


def open_ended(segment: str) -> bool:
    """Whether space at an end would run on into the space before or after: possible at the ends of a text only."""
    return segment != segment.strip()


def byte_level(entries: list[str]) -> list[bytes]:
    """The bytes that entries of a byte-level vocabulary stand for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    of_char = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    return [bytes(of_char[c] for c in e) if all(c in of_char for c in e) else e.encode() for e in entries]
