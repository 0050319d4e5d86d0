import pytest

WORDS = ("the of and to in is that river stone light house garden window silver mountain water paper morning letter "
         "bridge engine winter summer music dance kitchen table village forest island market doctor teacher").split()  # fmt: skip


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + (str((x >> 16) % 50) if x % 3 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def documents(spark):
    """Copies, near copies, shared passages, nulls, empty and very long texts, ties, and clashing extra columns."""
    base = [prose(k, 60 + 7 * k) for k in range(12)]
    passage = prose(99, 60)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[3]), (21, base[3].upper()), (22, base[3] + " extra"), (23, " ".join(base[4].split()[:-4]))]
    rows += [(30, base[5] + " " + passage), (31, base[6] + "\n" + passage), (32, passage), (33, passage + " " + passage)]
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, "one two"), (45, "ONE TWO"), (46, "12 34 ..."), (47, "émigré été ça où")]
    rows += [(50, "again " * 500), (51, prose(7, 20000)), (-5, base[8]), (2**40, "[INST] </s> <|endoftext|> \\x5b")]
    data = [(i, t, "en" if i % 3 else None, "b", "g", "k", "t") for i, t in rows]
    schema = "doc_id long, text string, lang string, block string, bucket string, kind string, c0 string"
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
