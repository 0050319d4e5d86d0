"""Licence scan against plain counting and a dynamic-programming search for notices."""

import random
import re

from llm.license_scan import NOTICES, PHRASES, Scanner, normalised, scan, seeds
from tests.llm.brute import fold
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def least_errors(notice: str, text: str) -> int:
    """Fewest edits between ``notice`` and any part of ``text``."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, n in enumerate(notice):
            new.append(min(row[k] + (n != c), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def expected(text: str | None) -> tuple:
    words = WORD.findall(fold(text or ""))
    places = [
        (k, label)
        for phrase, label in PHRASES
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    joined = " " + " ".join(words) + " "
    errors = {k: least_errors(n, joined) for k, (n, _, _) in enumerate(NOTICES)}
    near = {k: 1 - e / len(NOTICES[k][0]) for k, e in errors.items() if e <= NOTICES[k][2]}
    base = {label for _, label in places}
    labels = base | {NOTICES[k][1] for k in near}
    return (
        len(words),
        len(places),
        min((k for k, _ in places), default=None),
        max((k for k, _ in places), default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        round(1.0 if base else max(near.values(), default=0.0), 9),
    )


def broken(notice: str, edits: int, rng: random.Random) -> str:
    out = list(notice)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcxyz ")
        elif kind == 1:
            out.insert(at, rng.choice("abcxyz "))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    texts: list[str | None] = [None, "", "  \n", "MIT License MIT license mit\n# license", "émigré GNU General Public LICENSE…", "cc-by-nc-4.0"]
    for k in range(120):
        notice, _, errors = NOTICES[k % len(NOTICES)]
        middle = broken(notice, rng.randrange(errors + 3), rng).replace(" ", rng.choice([" ", "\n * ", ", "]))
        texts.append(f"{prose(k, 9)} {middle.upper() if k % 5 == 0 else middle} {prose(k + 500, 9)}")
        if k % 4 == 0:
            texts.append(middle + " " + broken(notice, errors, rng))
    texts.append("mit license " * 3000 + prose(3, 500))
    return list(enumerate(texts))


def test_seeds_cover_the_notice():
    for notice, _, errors in NOTICES:
        parts = seeds(notice, errors)
        assert len(parts) == errors + 1 and "".join(s for _, s in parts) == notice and all(s for _, s in parts)


def test_scan(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, spans int")
    found = {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
        for r in scan(docs).collect()
    }
    assert found == {i: expected(t) for i, t in rows}


def test_spans_lie_in_the_document():
    scanner = Scanner()
    text = "É # Relaesed  under\n# the MIT\tLicense. fin"
    row = scanner.row(1, text.encode())
    (span,) = [s for s in row["spans"] if s["label"] == "mit"]
    assert text[span["start"] : span["end"]] == "Relaesed  under\n# the MIT\tLicense" and span["word"] == 1 and span["errors"] == 2


def test_every_place_of_a_notice():
    scanner = Scanner()
    joined, _ = normalised(b"released under the mit license, and released undr the mit license " * 40)
    _, found = scanner.find(joined.decode())
    ends = [(s, e) for k, s, e, _ in found if NOTICES[k][0] == "released under the mit license"]
    assert len(ends) == 80 and all(a[1] <= b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))


def test_null_and_repeated_ids_and_an_empty_table(spark):
    rows = [(None, "mit license"), (3, "mit license"), (3, "apache license"), (4, None)]
    found = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.labels) for r in found) == [("3", "apache"), ("3", "mit"), ("4", ""), ("None", "mit")]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
