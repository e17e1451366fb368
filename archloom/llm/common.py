"""Shared helpers: free column names, values used twice, the learned split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.session import cut, shared_dir

__all__ = ["cut", "free", "learned_split", "let", "shared_dir", "whole_text"]


def free(frame: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of the frame has, in any case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def whole_text(name: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def learned_split(doc_id: str, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
