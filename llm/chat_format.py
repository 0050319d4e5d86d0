"""Chat formatting by incremental black-box rendering.

A renderer is any function from a list of ``(role, text)`` turns to a string.
Nothing else is assumed of it: each conversation's successive prefixes are
rendered, and the growth from one output to the next is the new turn's span.
Where an output does not begin with the one before, the template rewrites
history; the conversation is flagged and its spans up to there are void. Inside
a span the text is found by rendering the turn once more with an empty text:
what both outputs share at either end is markup.

Texts are escaped before they are rendered, so no text can pose as a control
string; the escape is reversible. ``read_back`` parses formatted output to turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.near_duplicates import runs

Turns = list[tuple[str, str]]
Renderer = Callable[[Turns], str]

LEARNED_ROLE = "assistant"
#: What the template writes between texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE ", "[/ROLE]", "<<SYS>>", "<</SYS>>")
_HIDDEN = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_SHOWN = re.compile(r"\\(\\|x[0-9a-f]{2})")
_NAMED = ("system", "user", "assistant")


def escape(text: str) -> str:
    """Every backslash doubled, the first character of every control string as ``\\xNN``."""
    return _HIDDEN.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\x{ord(m[0]):02x}", text)


def unescape(text: str) -> str:
    return _SHOWN.sub(lambda m: "\\" if m[1] == "\\" else chr(int(m[1][1:], 16)), text)


def escape_role(role: str) -> str:
    """Roles stand inside markup, so their brackets and backslashes go as well."""
    return re.sub(r"[\\\[\]<>]", lambda m: f"\\x{ord(m[0]):02x}", role)


def instruct(turns: Turns) -> str:
    """The default template: system, user and assistant turns, and any other role by name."""
    out = ["<s>"]
    for role, text in turns:
        if role == "system":
            out.append(f"<<SYS>>\n{text}\n<</SYS>>\n")
        elif role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text}</s>")
        else:
            out.append(f"[ROLE {role}] {text} [/ROLE]")
    return "".join(out)


def _common(a: str, b: str) -> int:
    """How many characters both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(turns: Turns, render: Renderer) -> tuple[str, list[tuple[int, int, int, int] | None], bool]:
    """The output; for each turn (start, text start, text end, end) or None; whether history is rewritten.

    Every prefix is rendered, so the work grows with the square of a
    conversation's turns; that is the price of knowing nothing of the template.
    """
    before, spans, rewrites = render([]), [], False
    for k, (role, text) in enumerate(turns):
        now, empty = render(turns[: k + 1]), render([*turns[:k], (role, "")])
        if not now.startswith(before):
            rewrites, spans = True, [None] * (k + 1)
            before = now
            continue
        spans.append(_text_span(now, empty, len(before), text))
        before = now
    return before, spans, rewrites


def _text_span(now: str, empty: str, start: int, text: str) -> tuple[int, int, int, int] | None:
    """Where the text sits: the rest of the turn is what the empty turn's output has on either side."""
    if len(now) - len(empty) != len(text) or now[:start] != empty[:start]:
        return None
    new, bare = now[start:], empty[start:]
    upper, lower = _common(new, bare), len(bare) - _common(new[::-1], bare[::-1])
    for at in range(lower, upper + 1):
        if new.startswith(text, at):
            return start, start + at, start + at + len(text), len(now)
    return None


def _until(formatted: str, at: int, close: str) -> tuple[str, int]:
    end = formatted.index(close, at)
    return formatted[at:end], end + len(close)


def read_back(formatted: str) -> Turns:
    """The turns in the output of ``instruct``, roles and texts unescaped."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        if formatted.startswith("<<SYS>>\n", at):
            role, (text, at) = "system", _until(formatted, at + 8, "\n<</SYS>>\n")
        elif formatted.startswith("[INST] ", at):
            role, (text, at) = "user", _until(formatted, at + 7, " [/INST]")
        elif formatted.startswith("[ROLE ", at):
            role, at = _until(formatted, at + 6, "] ")
            text, at = _until(formatted, at, " [/ROLE]")
        else:
            role, (text, at) = "assistant", _until(formatted, at + 1, "</s>")
        turns.append((unescape(role), unescape(text)))
    return turns


_SPAN = pa.struct([("role", pa.string()), *((k, pa.int64()) for k in ("start", "text_start", "text_end", "end"))])


def _format(render: Renderer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for group in runs(batches, ["known", "key"]):
            roles = [r or "" for r in group["role"].to_pylist()]
            turns = [
                (r if r in _NAMED else escape_role(r), escape(t or ""))
                for r, t in zip(roles, group["text"].to_pylist(), strict=True)
            ]
            formatted, spans, rewrites = locate(turns, render)
            marks = [
                dict(zip(("role", "start", "text_start", "text_end", "end"), (r, *(s or [None] * 4)), strict=True))
                for r, s in zip(roles, spans, strict=True)
            ]
            held.append((group["id"][0].as_py(), formatted, marks, rewrites))
            if len(held) >= 500:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    ids, outputs, marks, rewrites = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(outputs, pa.string()), pa.array(marks, pa.list_(_SPAN)), pa.array(rewrites, pa.bool_())],
        ["id", "formatted", "turns", "rewrites"],
    )


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", render: Renderer = instruct) -> DataFrame:
    """One row per conversation: id, formatted, turns (role and spans) and rewrites.

    Turns go in the order of turn, role and text (nulls first), so rows that tie or
    repeat have a fixed place and all stay. Null texts and roles count as empty.
    Rows with a null id form one conversation with a null id. A turn whose text
    the template changes, and all turns up to one that rewrites history, have
    null spans. Rows are sorted within partitions and read as a stream: a task
    holds one conversation at a time. Other columns are not read.
    """
    base = rows.select(
        F.col(conv_col).cast("long").alias("id"),
        F.col(conv_col).isNotNull().alias("known"),
        F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("key"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    spans = "array<struct<role:string,start:bigint,text_start:bigint,text_end:bigint,end:bigint>>"
    return (
        base.repartition("known", "key")
        .sortWithinPartitions("known", "key", "turn", "role", "text")
        .mapInArrow(_format(render), f"id long, formatted string, turns {spans}, rewrites boolean")
        .withColumnRenamed("id", conv_col)
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for formatted, marks in zip(batch["formatted"].to_pylist(), batch["turns"].to_pylist(), strict=True):
            turns = read_back(formatted)
            loss = "".join(
                unescape(formatted[m["text_start"] : m["text_end"]])
                for m in marks
                if m["role"] == LEARNED_ROLE and m["text_start"] is not None
            )
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(formatted))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["id", *out]
        )


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns, loss text and lengths read back from the output of ``format_conversations`` with ``instruct``."""
    schema = "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    done = formatted.select(F.col(conv_col).alias("id"), "formatted", "turns").mapInArrow(_digest, schema)
    return done.withColumnRenamed("id", conv_col)
