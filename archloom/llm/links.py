"""Linking records that share a bucket, without listing pairs.

A record has an id, a multiplicity (how many rows it stands for), bucket keys and a payload. Two records with a common
key are compared once, in the bucket of their least common key, so that the links of a record can be summed where they
are found and no pair ever leaves a task. Of buckets with the same members only the one with the least key is visited.
Large buckets are cut into blocks of bounded count and bytes, and each pair of blocks is a group of its own. Groups arrive
sorted; small ones are compared many at a time, as most buckets hold a few records only.

Components come from the spanning edges of each group by alternating large-star and small-star steps; the driver only
sees a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import cut

#: Records and bytes of payload of a block, in the mean.
BLOCK_RECORDS, BLOCK_BYTES = 1024, 16 << 20
#: Groups of up to SMALL records are compared together, as many as fit CHUNK_ROWS records and CHUNK_BYTES of payload.
SMALL, CHUNK_ROWS, CHUNK_BYTES = 64, 4096, 8 << 20

#: prepare(payloads) gives a function of a row and candidate rows that says which are linked.
Prepare = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]

_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def buckets(records: DataFrame) -> DataFrame:
    """Key, member id and number of blocks, of each bucket that has to be visited. records: id, keys, weight (bytes)."""
    member = records.select("id", "weight", F.explode(F.array_distinct("keys")).alias("key"))
    mark = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    size = member.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes"), F.min("id").alias("least"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    visited = size.groupBy("n", "bytes", "least", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_RECORDS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    return member.drop("weight").join(visited.select("key", blocks.alias("blocks")), "key")


class Roots:
    """Union-find over 0..n-1 with the least member as the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = self.top(i), self.top(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)


def within_runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions, the first the lesser, that lie in the same of consecutive runs."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(ends))
    after = ends - place - 1
    first = np.repeat(place, after)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)


def _lesser_keys(group: np.ndarray, key: np.ndarray, keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records in order of (group, key), and run lengths, for keys that several records of a group share and that are less
    than the group's own. Rows are sorted by group; row i has keys[ends[i-1]:ends[i]]."""
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    less = keys < key[of]
    of, keys = of[less], keys[less]
    order = np.lexsort((keys, group[of]))
    of, keys = of[order], keys[order]
    at = group[of]
    lengths = np.diff(np.r_[np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])]), len(keys)]) if len(keys) else np.zeros(0, int)
    shared = lengths > 1
    return of[np.repeat(shared, lengths)], lengths[shared]


def compare(table: pa.Table, prepare: Prepare) -> pa.Table:
    """Links of each record that are its bucket's to count, and the least id that it is joined with through them. The table
    holds whole groups: one large group, or small ones."""
    ids = table.column("id").to_numpy()
    marks = [table.column(c).to_numpy() for c in ("key", "first", "second")]
    order = np.lexsort((ids, *marks[::-1]))
    fresh = np.r_[True, np.any([m[order][1:] != m[order][:-1] for m in marks], axis=0)]
    once = fresh | np.r_[True, ids[order][1:] != ids[order][:-1]]  # rows of an id that occurs again in its group add nothing
    order, fresh = order[once], fresh[once]
    table, ids = table.take(pa.array(order)), ids[order]
    key, first, second = (m[order] for m in marks)
    block, many = (table.column(c).to_numpy() for c in ("block", "many"))
    lists = table.column("keys").combine_chunks()
    n, group = len(ids), np.cumsum(fresh) - 1
    sizes = np.bincount(group)
    of, shared = _lesser_keys(group, key, lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy()))
    links, roots = np.zeros(n, np.int64), Roots(n)
    linked = None

    def visit(i: int, near: np.ndarray) -> None:
        nonlocal linked
        linked = linked or prepare(table.column("payload").to_pylist())
        if len(near := near[linked(i, near)]):
            links[i] += many[near].sum()
            links[near] += many[i]
            roots.join(i, near)

    if len(sizes) == 1 and n > SMALL:
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        todo = np.zeros((n, n), bool)
        todo[np.ix_(left, right)] = True
        todo |= todo.T
        for a, length in zip(np.cumsum(shared) - shared, shared, strict=True):  # another bucket's
            todo[np.ix_(of[a : a + length], of[a : a + length])] = False
        for i in range(n):
            if len(near := np.flatnonzero(todo[i, i + 1 :]) + i + 1):
                visit(i, near)
    else:
        i, j = within_runs(sizes)
        mine = (first[i] == second[i]) | (block[i] != block[j])
        pairs = i[mine] * n + j[mine]
        a, b = within_runs(shared)
        pairs = np.setdiff1d(pairs, np.minimum(of[a], of[b]) * n + np.maximum(of[a], of[b]))
        i, j = pairs // n, pairs % n
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        for a, b in zip(starts, np.r_[starts[1:], len(i)], strict=False):
            visit(i[a], j[a:b])
    some = links > 0
    root = ids[[roots.top(i) for i in range(n)]] if n else ids
    return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], schema=_FOUND)


def _parts(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
    """The groups between starts: large ones alone, small ones together."""
    sizes = np.diff(starts).tolist()
    weight = np.cumsum(pa.compute.binary_length(table.column("payload")).to_numpy().astype(np.int64))[starts[1:] - 1].tolist()
    a = 0
    while a < len(sizes):
        b, rows, spent = a + 1, sizes[a], weight[a - 1] if a else 0
        while b < len(sizes) and max(rows, sizes[b]) <= CHUNK_ROWS and max(sizes[b], sizes[a]) <= SMALL and weight[b] - spent <= CHUNK_BYTES:
            rows += sizes[b]
            b += 1
        if rows > 1:
            yield table.slice(starts[a], rows)
        a = b


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by key, first and second: one large group, or small ones."""
    last, going = None, []  # a group may go on in the next batch
    for batch in batches:
        table = pa.Table.from_batches([batch])
        marks = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "first", "second")], 1)
        if not len(marks):
            continue
        starts = np.flatnonzero(np.r_[last is None or (marks[0] != last).any(), (marks[1:] != marks[:-1]).any(1)])
        if len(starts):
            if going:
                yield pa.concat_tables([*going, table.slice(0, starts[0])])
            yield from _parts(table, starts)
            going = []
        going.append(table.slice(starts[-1] if len(starts) else 0))
        last = marks[-1]
    if going:
        yield pa.concat_tables(going)


def find_links(records: DataFrame, payloads: Callable[[DataFrame], DataFrame], prepare: Prepare) -> DataFrame:
    """id, links (weighted by multiplicity) and component of each record that is linked with another.

    records: id, many, weight, keys. payloads: given the ids that share a bucket (id), their payloads (id, payload)."""
    member = cut(buckets(records))
    # of a record's keys only those of buckets that are visited travel with it: every pair with a common key has one of them
    at = member.groupBy("id").agg(F.collect_list(F.struct("key", "blocks")).alias("at"))
    rows = at.join(records.select("id", "many").join(payloads(member.select("id").distinct()), "id"), "id")
    rows = rows.select("id", "many", "payload", F.transform("at", lambda x: x["key"]).alias("keys"), F.explode("at").alias("here")).select("*", "here.*")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("block", own).withColumn("other", other)
    dealt = dealt.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "id", "block", "many", "keys", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            yield from compare(table, prepare).to_batches()

    group = ("key", "first", "second")
    found = cut(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "id bigint, links bigint, root bigint"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    return counts.join(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "id")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id that edges a, b lead to) of each id that an edge to another id has."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        now = cut(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = state
