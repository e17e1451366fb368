"""Chat formatting that is checked by reading it back.

A conversation is a run of turns, each written <s>[ROLE] text [/ROLE]</s> in a fixed grammar with the tags SYS, INST and
OUT for system, user and assistant, and ROLE:name for any other role. Texts go in as they are. The rendered text is then
reparsed by a deterministic parser and the recovered turns are compared with the source; where they differ, the turns
whose texts hold control strings are escaped and the text is rendered again, until the turns are identical. Escaping
puts a mark inside each control string and doubles marks that were there; the parser takes both back.

Turns go by turn number, then role, then text (nulls first); repeated rows are repeated turns. Null text counts as
empty, null role as the empty role. A row with a null conv_id is a conversation of its own, as nothing says that it belongs
to another row; such rows aren't shuffled, so any number of them may come. Texts of any length are kept whole.
The loss mask covers the assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed tags of the template.
TAGS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
ROLES = {tag: role for role, tag in TAGS.items()}
MARK = "␛"
#: Strings that steer the parser, or that models of this family read as control tokens.
CONTROL = re.compile(r"</?s>|\[/?(?:SYS|INST|OUT|ROLE)[\]:]|<</?SYS>>|<\|[^|<>]{0,40}\|>")
_OPEN = re.compile(r"<s>\[(?:(SYS|INST|OUT)|ROLE:((?:[^\]␛]|␛.)*))\]")

Turn = tuple[str, str]


class Malformed(ValueError):
    """The text isn't a run of turns."""


def escape(text: str) -> str:
    """Marks are doubled, and a mark and a bar go into each control string after its first character."""
    return CONTROL.sub(lambda m: f"{m[0][0]}{MARK}|{m[0][1:]}", text.replace(MARK, MARK + MARK))


def unescape(text: str) -> str:
    return re.sub(f"{MARK}([{MARK}|])", lambda m: MARK if m[1] == MARK else "", text) if MARK in text else text


def _name(role: str) -> str:
    """A role name inside a tag: marks are doubled, and what would end the tag is written out."""
    return role.replace(MARK, MARK + MARK).replace("]", MARK + ")")


def _role(name: str) -> str:
    return re.sub(f"{MARK}(.)", lambda m: "]" if m[1] == ")" else m[1], name, flags=re.S)


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The turn as written, and where its text begins."""
    tag = TAGS.get(role)
    head = f"<s>[{tag}]" if tag else f"<s>[ROLE:{_name(role)}]"
    return f"{head}{text}[/{tag or 'ROLE'}]</s>", len(head)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Role, unescaped text, and the span of the text as written, for each turn."""
    turns, at = [], 0
    while at < len(text):
        if not (head := _OPEN.match(text, at)):
            raise Malformed(f"no turn begins at {at}")
        end = text.find(f"[/{head[1] or 'ROLE'}]</s>", head.end())
        if end < 0:
            raise Malformed(f"the turn at {at} has no end")
        turns.append((ROLES[head[1]] if head[1] else _role(head[2]), unescape(text[head.end() : end]), head.end(), end))
        at = end + len(head[1] or "ROLE") + 7
    return turns


def _recovered(text: str) -> list[Turn] | None:
    try:
        return [turn[:2] for turn in parse(text)]
    except Malformed:
        return None


def render(turns: list[Turn]) -> str:
    """The turns as one text that parses to them. Texts with control strings are escaped from the start, others as far as
    reading back calls for it."""
    escaped = [bool(CONTROL.search(text)) for _, text in turns]
    write = lambda i: render_turn(turns[i][0], escape(turns[i][1]) if escaped[i] else turns[i][1])[0]
    while True:
        text = "".join(map(write, range(len(turns))))
        if _recovered(text) == turns:
            return text
        open_ = [i for i, e in enumerate(escaped) if not e]
        conflicting = [i for i in open_ if _recovered(write(i)) != [turns[i]]] or open_
        if not conflicting:
            raise Malformed("no escaping reads back")
        for i in conflicting:
            escaped[i] = True


_TEXT = "conv_id bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _sorted_turns(rows: DataFrame) -> DataFrame:
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = turns.where(F.col("conv_id").isNotNull()).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return named.unionAll(turns.where(F.col("conv_id").isNull()))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    now, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if turns and (conv is None or conv != now):
                yield now, turns
                turns = []
            now = conv
            turns.append((role, text))
    if turns:
        yield now, turns


def format_conversations(rows: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, the formatted text, and the spans of its assistant texts as written, in code
    points. Rows have conv_id, turn, role and text; one shuffle by conv_id, then one conversation after another."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, turns in _conversations(batches):
            text = render(turns)
            held.append((conv, text, [{"start": a, "end": b} for role, _, a, b in parse(text) if role == "assistant"]))
            size += len(text)
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return _sorted_turns(rows).mapInArrow(run, _TEXT)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and their loss spans say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss")), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{t}\n" for role, t, _, _ in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
