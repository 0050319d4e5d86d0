"""Text extraction: retry-error messages, index recommendations, DML targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
RETRY_ERROR_TYPE = r"TransactionRetryWithProtoRefreshError:\s*([A-Za-z_()]+):"
CONFLICT_KEY = r"conflicting txn: meta=\{[^}]*key=([^ ]+)"
CONFLICT_TIME = r"conflicting txn: meta=\{[^}]*ts=([0-9]+\.[0-9]+)"
TXN_ID_PREFIX = r'(?:"|\\")sql txn(?:"|\\") meta=\{id=([0-9A-Fa-f]+)'
INDEX_TARGET = r"(?i)ON\s+([a-zA-Z0-9_\.]+)"
TABLE_NAME = r'((?:"[^"]+"|\w+)(?:\.(?:"[^"]+"|\w+)){0,2})'
WRITE_VERBS = (
    r"insert\s+into",
    r"upsert\s+into",
    r"merge\s+into",
    r"update",
    r"delete\s+from",
)
# ------------------------------------------------------------ end fixed values


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match, or NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def unescaped(text: Column) -> Column:
    r"""``\"`` becomes ``"`` and ``\\`` becomes ``\``."""
    return F.regexp_replace(text, r'\\(["\\])', "$1")


def epoch_timestamp(text: Column) -> Column:
    return F.timestamp_seconds(text.try_cast("decimal(20,6)"))


def name_part(path: Column, from_end: int) -> Column:
    """The n-th dotted part counted from the end, NULL if there are fewer."""
    return F.try_element_at(F.split(path, "[.]"), F.lit(-from_end))


def written_table(query: Column) -> Column:
    """Lower-case name of the table a DML text writes to."""
    return F.coalesce(
        *[F.lower(first_group(query, rf"(?is)\b{verb}\s+{TABLE_NAME}")) for verb in WRITE_VERBS]
    )


def leaf_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit('"'), F.lit("")), ".", -1)


def like(text: Column, pattern: Column) -> Column:
    """LIKE with a pattern taken from a column; ``_`` stays a wildcard."""
    return F.call_function("like", text, pattern)
