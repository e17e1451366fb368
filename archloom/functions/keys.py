"""Keys as column expressions: nodes are layer:type:domain:name, edges are from->to:TYPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Keys that normalisation leaves as they are: printable ASCII without blanks or capitals, and no slash at the ends of the last
#: part. An edge's source has no ">", so that its first arrow is the one behind it.
_WORD, _OF_SOURCE = r"[!-9;-@\[-~]+", r"[!-9;-=?@\[-~]+"
_LAST, _LAST_OF_SOURCE = r"(?!/)[!-@\[-~]*[!-.0-@\[-~]", r"(?!/)[!-=?@\[-~]*[!-.0-=?@\[-~]"
NORMAL_NODE = rf"\A{_WORD}:{_WORD}:{_WORD}:{_LAST}\z"
NORMAL_EDGE = rf"\A{_OF_SOURCE}:{_OF_SOURCE}:{_OF_SOURCE}:{_LAST_OF_SOURCE}->{_WORD}:{_WORD}:{_WORD}:{_LAST}:[!-9;-~]+\z"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _normalised(raw: Column) -> Column:
    def whole(parts: Column, last: Column) -> Column:
        first = [F.get(parts, i) for i in range(3)]
        given = (F.size(parts) == 4) & (first[0] != "") & (first[1] != "") & (first[2] != "") & (last != "")
        return F.when(given, F.concat_ws(":", *first, last))

    parts = F.transform(F.split(F.lower(F.trim(raw)), ":", 4), lambda p: F.trim(p))
    last = lambda p: F.trim(F.regexp_replace(F.get(p, 3), "^/+|/+$", ""))
    return _once(parts, lambda p: _once(last(p), lambda end: whole(p, end)))


def node_key(raw: Column) -> Column:
    """The normalised key, or null where a part is empty or missing."""
    return F.when(raw.rlike(NORMAL_NODE), raw).otherwise(_normalised(raw))


def edge_parts(raw: Column) -> tuple[Column, Column, Column]:
    """From, to and type as written: cut at the first arrow and the last colon."""
    text = F.trim(raw)  # no branches, so that Spark computes what the parts have in common once
    at = F.nullif(F.instr(text, F.lit("->")), F.lit(0))
    rest = text.substr(at + 2, F.length(text))
    kind = F.substring_index(rest, ":", -1)
    to = rest.substr(F.lit(1), F.length(rest) - F.length(kind) - 1)
    return text.substr(F.lit(1), at - 1), to, F.when(rest.contains(":"), F.trim(kind))


def edge_key(raw: Column) -> Column:
    """The normalised key (the type keeps its case), or null where it is malformed."""
    parts = F.struct(*(part.alias(name) for part, name in zip(edge_parts(raw), ("a", "b", "kind"), strict=True)))
    whole = lambda p: F.when(p["kind"] != "", F.concat(node_key(p["a"]), F.lit("->"), node_key(p["b"]), F.lit(":"), p["kind"]))
    return F.when(raw.rlike(NORMAL_EDGE), raw).when(raw.contains("->"), _once(parts, whole))


def build_edge_key(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit(":"), kind)


def lenient_int(raw: Column) -> Column:
    """The integer that a string begins with, else 0."""
    return F.coalesce(F.expr("1").cast("int") * F.regexp_extract(raw, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


#: Whole numbers up to which keys that end in them are told apart by them.
_GREATEST = 10**17


def number_of(key: Column) -> Column:
    """The number of at most 18 digits that a key ends in, else -1."""
    return F.coalesce(F.regexp_extract(key, r"(?:^|[^0-9])([0-9]{1,18})$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def as_number(value: Column) -> Column:
    """What number_of tells of a key that is text and this value, if the value is a whole number and the text has no digit at
    its end; -1 also stands for all values that aren't told apart: those below 0 or above _GREATEST, null, and no whole numbers."""
    whole = F.typeof(value).isin("tinyint", "smallint", "int", "bigint")
    number = value.try_cast("bigint")
    return F.when(whole & number.between(0, _GREATEST), number).otherwise(F.lit(-1).cast("bigint"))
