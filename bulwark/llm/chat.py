"""Chat formatting: schema fingerprints select mappings to canonical turns.

A layout is the set of nested field paths of a record (``messages[].role``); its
fingerprint is a hash of the sorted paths.  ``MAPPINGS`` lists, per layout, how
canonical turns (role, text) come out of a record.  Tables of typed columns have
one fingerprint for all rows; JSON records are fingerprinted one by one.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|`` (and a line feed in a
role becomes ``\\n``), so no control string survives in a text and reading back
is exact.  The loss mask covers the texts of the assistant.

Conversations are streamed, never gathered: rows are sorted by conversation and
turn, formatted one by one, and put out in parts of at most ``PART`` characters
(a longer turn fills a part alone).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
PART = 1 << 16

# -- layouts ---------------------------------------------------------------


def paths_of(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON record; items of lists share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def paths_of_schema(schema: T.DataType, at: str = "") -> set[str]:
    if isinstance(schema, T.StructType):
        return {p for f in schema for p in paths_of_schema(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(schema, T.ArrayType):
        return paths_of_schema(schema.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """turns: pairs of (role, path), a role starting with ``@`` being itself a path; path items[] repeats over items."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]


MAPPINGS = {
    fingerprint(set(m.paths)): m
    for m in (
        Mapping(("prompt", "response"), (("user", "prompt"), (ASSISTANT, "response"))),
        Mapping(("prompt", "completion"), (("user", "prompt"), (ASSISTANT, "completion"))),
        Mapping(("question", "answer"), (("user", "question"), (ASSISTANT, "answer"))),
        Mapping(("instruction", "output"), (("user", "instruction"), (ASSISTANT, "output"))),
        Mapping(("instruction", "input", "output"), (("user", "instruction|input"), (ASSISTANT, "output"))),
        Mapping(("system", "instruction", "input", "output"), (("system", "system"), ("user", "instruction|input"), (ASSISTANT, "output"))),
        Mapping(("system", "prompt", "response"), (("system", "system"), ("user", "prompt"), (ASSISTANT, "response"))),
        Mapping(("messages[].content", "messages[].role"), (("@messages[].role", "messages[].content"),)),
        Mapping(("conversations[].from", "conversations[].value"), (("@conversations[].from", "conversations[].value"),)),
        Mapping(("turns[].speaker", "turns[].text"), (("@turns[].speaker", "turns[].text"),)),
    )
}
#: The layout of a table that holds one turn per row.
TURN_ROWS = fingerprint({"conv_id", "turn", "role", "text"})
#: Names of the same speaker in different layouts.
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def turns_of(record: dict) -> list[tuple[str, str]] | None:
    """Canonical turns of a parsed record; None if its layout is unknown."""
    mapping = MAPPINGS.get(fingerprint(paths_of(record)))
    if mapping is None:
        return None

    def text(v: object) -> str:
        return v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)

    out = []
    for role, path in mapping.turns:
        if "[]" in path:
            items, _, leaf = path.partition("[].")
            field = role.partition("[].")[2]
            for item in record[items]:
                name = text(item.get(field))
                out.append((ROLES.get(name, name), text(item.get(leaf))))
        else:
            out.append((role, "\n".join(x for x in (text(record.get(p)) for p in path.split("|")) if x)))
    return out


def canonical_turns(records: DataFrame, record: str = "record", key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text, layout) from JSON records.

    A record of an unknown layout, a broken one or a null gives one row with a
    null turn and its fingerprint (null if it can't be parsed), so that nothing
    is lost silently.
    """
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    parsed = json.loads(raw) if raw is not None else None
                except ValueError:
                    parsed = None
                layout = fingerprint(paths_of(parsed)) if isinstance(parsed, dict) else None
                turns = turns_of(parsed) if isinstance(parsed, dict) else None
                rows += [(k, i, r, t, layout) for i, (r, t) in enumerate(turns)] if turns is not None else [(k, None, None, None, layout)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(key).cast("long"), F.col(record)).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


# -- template --------------------------------------------------------------


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(p.replace("<\\|", "<|") for p in text.split("\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    if "\\" not in role:
        return role
    return "\\".join(p.replace("\\n", "\n").replace("<\\|", "<|") for p in role.split("\\\\"))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where the loss mask begins and ends in it (equal: nothing)."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    begin = len(head)
    return f"{head}{body}{END}\n", begin, begin + (len(body) if role == ASSISTANT else 0)


def format_turns(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv_id, part, formatted, loss): parts of a conversation in order; loss: list of [begin, end) in the part.

    ``turns(conv_id, turn, role, text)``; null texts and roles are empty.  Turns
    of a conversation come in the order of turn (null first), then role, then
    text, so ties and repeated rows have one order.  Other columns are ignored.
    Each output partition holds whole conversations, parts in order.
    """
    if not set(("conv_id", "turn", "role", "text")) <= set(turns.columns):
        raise ValueError("turn rows need the columns conv_id, turn, role and text")
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    # short keys first: texts are compared only where all else ties
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = "conv_id long, part long, formatted string, loss array<struct<begin:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        none = object()
        now: object = none
        part, size, pieces, loss = 0, 0, [], []
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), spans), strict=True)], names=["conv_id", "part", "formatted", "loss"])

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                piece, begin, end = render(role, text)
                if pieces and (conv != now or size + len(piece) > PART):
                    out.append((now, part, "".join(pieces), loss))
                    part, size, pieces, loss = part + 1, 0, [], []
                if conv != now or now is none:
                    now, part = conv, 0
                if end > begin:
                    loss.append({"begin": size + begin, "end": size + end})
                size += len(piece)
                pieces.append(piece)
            total = sum(len(r[2]) for r in out)
            if total > 16 * PART:
                yield batch_of(out)
                out = []
        if pieces:
            out.append((now, part, "".join(pieces), loss))
        yield batch_of(out)

    return dealt.mapInArrow(run, kind)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted parts alone.

    Needs the parts as ``format_turns`` leaves them: whole conversations per
    partition, in order.  (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            done.append((now, state["turns"], state["all"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["size"]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, part, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")), strict=True):
                if part == 0:
                    if state is not None:
                        close()
                    now, state = conv, {"turns": 0, "all": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "size": 0}
                state["size"] += len(text)
                for span in loss:
                    plain = unescape(text[span["begin"] : span["end"]])
                    state["loss"] += len(plain)
                    state["masked"].update(plain.encode())
                for turn in text.split(f"{END}\n")[:-1]:
                    role, _, body = turn[len(START) :].partition("\n")
                    state["turns"] += 1
                    state["all"].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
            if len(done) > 20_000:
                yield flush()
                done = []
        if state is not None:
            close()
        yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows_as_they_are(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "role", "text")


#: Mappings of whole tables, by the fingerprint of their schema.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {TURN_ROWS: _rows_as_they_are}


def turns_of_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn rows of a table whose schema fingerprint (over ``columns``, by default all) is known."""
    chosen = df.select(*columns) if columns else df
    mapping = TABLES.get(fingerprint(paths_of_schema(chosen.schema)))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(paths_of_schema(chosen.schema))}")
    return mapping(chosen)


def loss_share(spans: Column, text: Column) -> Column:
    """Characters under the mask as a share of all."""
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["begin"]) / F.length(text)
