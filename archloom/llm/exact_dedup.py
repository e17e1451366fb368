"""Exact deduplication by Grace hashing: spill files for what doesn't fit, open addressing for what does.

A record is a content with its SHA-256. A task fills an open-addressing table that compares complete contents. Once the
table has used up its bytes, records of contents that it lacks go to one of sixteen spill files by the next four bits of
their hash, and each file is treated in the same way, recursively, until what is left fits. Copies take one entry
whatever their number, so a large group never makes a bucket grow.

This runs twice: where the rows are read, so that one row for each content of a partition is shuffled, and again for
each hash. The classes then go back to the documents by hash, a join whose skewed keys Spark splits.

Null text counts as empty; empty texts are equal to each other. Of equal texts the row with the largest doc_id stays;
rows that repeat a doc_id as well stay once; a null doc_id comes before all others. Other columns are ignored by
`classes` and passed through by `drop_copies`, which keeps any one of rows that repeat text and doc_id. No row numbers are
used, so that a task that runs again gives the same rows.
"""

from __future__ import annotations

import os
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import cut, free, whole_text

#: Bytes of contents that a task's table holds before it spills.
TABLE_BYTES = 48 << 20
FANOUT, LEVELS = 16, 64
NO_ID = -(1 << 63)

#: Copies of a row with one doc_id that `classes` returns from one array.
RUN = 4096

Record = tuple[bytes, bytes, int, int, int]  # hash, content, doc_id, rows with that doc_id, rows


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def _slot(self, hashed: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = int.from_bytes(hashed[-8:], "big") & mask
        while (e := self.slots[i]) >= 0:
            entry = self.entries[e]
            if entry[0] == hashed and entry[1] == content:
                break
            i = i + 1 & mask
        return i

    def add(self, record: Record, room: float) -> bool:
        """Merge the record into its content's entry; a new entry only while there is room. False: not taken."""
        hashed, content, doc, ties, n = record
        i = self._slot(hashed, content)
        if self.slots[i] >= 0:
            entry = self.entries[self.slots[i]]
            entry[4] += n
            if doc > entry[2]:
                entry[2:4] = doc, ties
            elif doc == entry[2]:
                entry[3] += ties
            return True
        if self.bytes and self.bytes + len(content) > room:
            return False
        self.slots[i] = len(self.entries)
        self.entries.append(list(record))
        self.bytes += len(content) + 200
        if len(self.entries) * 2 > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (len(self.slots) * 4)
        mask = len(self.slots) - 1
        for e, entry in enumerate(self.entries):
            i = int.from_bytes(entry[0][-8:], "big") & mask
            while self.slots[i] >= 0:
                i = i + 1 & mask
            self.slots[i] = e


_HEAD = struct.Struct("<32sqqqq")


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as lines:
        while head := lines.read(_HEAD.size):
            hashed, doc, ties, n, size = _HEAD.unpack(head)
            yield hashed, lines.read(size), doc, ties, n
    os.unlink(path)


def grace(records: Iterable[Record], room: float = TABLE_BYTES, level: int = 0) -> Iterator[Record]:
    """One record for each content, in no particular order. The spill files are gone at the end, however it comes."""
    table, files = ContentTable(), {}
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for record in records:
            if not table.add(record, room if level < LEVELS else float("inf")):
                part = record[0][level // 2] >> (4 if level % 2 == 0 else 0) & FANOUT - 1
                if part not in files:
                    files[part] = open(f"{folder}/{part}.spill", "wb")
                hashed, content, doc, ties, n = record
                files[part].write(_HEAD.pack(hashed, doc, ties, n, len(content)) + content)
        for entry in table.entries:
            yield tuple(entry)
        del table
        for part, file in files.items():
            file.close()
            yield from grace(_read(f"{folder}/{part}.spill"), room, level + 1)


_FIELDS = "hash binary, content binary, doc bigint, ties bigint, n bigint"
_SCHEMA = pa.schema([("hash", pa.binary()), ("content", pa.binary()), ("doc", pa.int64()), ("ties", pa.int64()), ("n", pa.int64())])


def _task(room: int, keep_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    yield from zip(*(batch.column(n).slice(start, 512).to_pylist() for n in _SCHEMA.names), strict=True)

        held, size = [], 0
        for hashed, content, *rest in grace(records(), room):
            held.append((hashed, content if keep_content else b"", *rest))
            size += len(held[-1][1])
            if len(held) >= 1024 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _groups(rows: DataFrame, room: int) -> DataFrame:
    """A row for each content: its hash, the doc_id that stays, how many of its rows have that doc_id, how many there are."""
    one = F.lit(1).cast("long")
    records = rows.select("hash", "content", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), one.alias("ties"), one.alias("n"))
    local = records.mapInArrow(_task(room, True), _FIELDS)
    groups = local.repartition("hash").mapInArrow(_task(room, False), _FIELDS)
    return groups.select("hash", F.nullif("doc", F.lit(NO_ID)).alias("keep_id"), "ties", F.col("n").alias("group_size"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = whole_text(text).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(content, 256)).alias("hash"), content.alias("content"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", room: int = TABLE_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. Rows that repeat doc_id and text are counted
    before they are shuffled, and listed again afterwards."""
    rows = _rows(docs, doc_id, text)
    counted = rows.groupBy("hash", "doc_id").agg(F.count("*").alias("copies"))
    found = counted.join(_groups(rows, room), "hash").withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
    each = F.explode(F.sequence(F.col("run") * RUN + 1, F.least("copies", (F.col("run") + 1) * RUN)))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.withColumn("copy", each).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("hash")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", room: int = TABLE_BYTES) -> DataFrame:
    """docs without the rows that don't stay, all columns as they were."""
    _id, _hash, _keep, _key, _ties = free(docs, "_id", "_hash", "_keep", "_key", "_ties")
    groups = cut(_groups(_rows(docs, doc_id, text), room).select(F.col("keep_id").alias(_keep), F.col("hash").alias(_key), F.col("ties").alias(_ties)))
    rows = docs.withColumns({_id: F.col(doc_id).cast("long"), _hash: F.unhex(F.sha2(whole_text(text).cast("binary"), 256))})
    same = F.col(_id).eqNullSafe(F.col(_keep)) & (F.col(_hash) == F.col(_key))
    once = rows.join(groups.where(F.col(_ties) == 1), same, "left_semi")
    repeated = rows.join(groups.where(F.col(_ties) > 1), same, "left_semi").dropDuplicates([_id, _hash])
    return once.unionByName(repeated).select(docs.columns)
