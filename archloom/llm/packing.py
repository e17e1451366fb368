"""Variable-capacity best-fit packing of documents into training sequences.

A document longer than the largest permitted length is cut: every full piece fills a sequence of its own, the remainder
is packed like a short document. Documents are dealt by a hash of their id and length into shards of a bounded mean size,
and each shard is packed by itself, so that the result depends on the rows alone, not on the cluster. Rows that repeat id
and length are counted before they are shuffled and dealt in runs of RUN, so that no shard gets all of them.

`pack` plans by lengths; `sequences` also builds the sequences, from the ids of a tokenizer.

In a shard, pieces come longest first and go to the open bin that they leave the least room in. Where none has room a new
bin is opened. All permitted lengths are tried as the size to open (the least that holds the piece where it is longer),
as is the size of least expected cost for a token; every bin is downsized to the least permitted length that holds its
contents, and the plan of least total cost stays. The cost of a bin is its length plus a fixed overhead.

Documents without tokens (null and empty texts) are returned with piece 0 and no bin, and are in no sequence. Repeated rows
are packed as often as they occur. Ties: equal lengths go by doc_id and piece. Columns other than id and length are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import cut

#: Mean number of documents of a shard.
SHARD_DOCS = 4096
#: Rows that repeat id and length and go to one shard together.
RUN = 64
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096, 8192), 16


def count_tokens(text: str = "text") -> Column:
    """Words and marks; the length that `pack` plans with unless another is given."""
    return F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))


def least(capacities: Sequence[int], size: int) -> int:
    """The least permitted length that holds size."""
    return capacities[bisect_left(capacities, size)]


def best_fit(sizes: Sequence[int], capacities: Sequence[int], opened: int | None, overhead: int) -> tuple[list[int], list[int]]:
    """The bin of each size (descending) and the contents of each bin. opened: the size of new bins; None: least cost."""
    left: list[tuple[int, int]] = []  # room and bin, ascending
    bins, contents = [], []
    rest = sum(sizes)
    for size in sizes:
        at = bisect_left(left, (size, -1))
        if at < len(left):
            room, b = left.pop(at)
        else:
            b = len(contents)
            contents.append(0)
            if opened is None:  # what is left to pack bounds what a bin can be filled with
                room = min((c for c in capacities if c >= size), key=lambda c: ((c + overhead) / min(c, rest), c))
            else:
                room = max(opened, least(capacities, size))
        bins.append(b)
        contents[b] += size
        rest -= size
        if room > size:
            insort(left, (room - size, b))
    return bins, contents


def pack_shard(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """The bin of each size (descending) and the length of each bin, by the plan of least cost (the first of equals)."""
    plans = []
    for opened in [*capacities, None]:
        bins, contents = best_fit(sizes, capacities, opened, overhead)
        lengths = [least(capacities, c) for c in contents]
        plans.append((sum(lengths) + overhead * len(lengths), len(plans), bins, lengths))
    return min(plans)[2:]


Piece = tuple[int, int, int, int, int, int, int]


def place(lengths: Sequence[int], capacities: Sequence[int], overhead: int) -> list[Piece]:
    """Document (its number), piece, start, tokens, bin, capacity and offset of each piece of the documents of a shard; the
    bins of full pieces come last."""
    top, full, short = capacities[-1], [], []
    for d, n in enumerate(lengths):
        full += [(d, i, i * top, top) for i in range(n // top)]
        if n % top:
            short.append((n % top, d, n // top))
    short.sort(key=lambda x: (-x[0], x[1]))
    bins, sizes = pack_shard([n for n, *_ in short], capacities, overhead)
    used, out = [0] * len(sizes), []
    for (n, d, piece), b in zip(short, bins, strict=True):
        out.append((d, piece, piece * top, n, b, sizes[b], used[b]))
        used[b] += n
    return out + [(d, i, s, n, len(sizes) + b, top, 0) for b, (d, i, s, n) in enumerate(full)]


def _dealt(rows: DataFrame, names: list[str], shard_docs: int) -> DataFrame:
    """Equal rows counted, in runs of a bounded number of copies, each in its shard; whole shards in the order of names. The
    rows are written first, as their number is needed and lengths or ids are dear to compute."""
    rows = cut(rows)
    counted = rows.groupBy(*names).agg(F.count("*").alias("copies"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
    runs = runs.withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN))
    shards = max(1, -(-rows.count() // shard_docs))
    dealt = runs.withColumn("shard", F.pmod(F.xxhash64(*names, "run"), F.lit(shards)))
    # each shard alone in a partition's order; a partition may hold several
    return dealt.select("shard", "copies", *names).repartition(F.col("shard")).sortWithinPartitions("shard", *names)


def _shards(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """The documents of one shard after another."""
    now, held = None, []
    for batch in batches:
        for shard, copies, *row in zip(*(batch.column(x).to_pylist() for x in ("shard", "copies", *names)), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held += [tuple(row)] * copies
    if held:
        yield now, held


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.int64()), ("bin", pa.int32()), ("capacity", pa.int32()), ("offset", pa.int32())])


def pack(docs: DataFrame, length: Column | None = None, doc_id: str = "doc_id", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece: doc_id, piece, start and n_tokens in the document; shard, bin, capacity and offset in the
    sequence. A shard and a bin number name a sequence."""
    capacities = sorted(capacities)
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(count_tokens() if length is None else length, F.lit(0)).cast("long"), F.lit(0)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _shards(batches, ["doc_id", "n"]):
            rows = [(held[d][0], p, s, n, shard, b, c, o) for d, p, s, n, b, c, o in place([n for _, n in held], capacities, overhead)]
            rows += [(doc, 0, 0, 0, shard, None, None, None) for doc, n in held if not n]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return _dealt(sized, ["doc_id", "n"], shard_docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, n_tokens bigint, shard bigint, bin int, capacity int, offset int")


_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int32())]))
_SEQUENCE = pa.schema([("shard", pa.int64()), ("bin", pa.int32()), ("capacity", pa.int32()), ("ids", pa.list_(pa.int32())), ("pieces", _PIECES)])


def sequences(encoded: DataFrame, ids: str = "ids", doc_id: str = "doc_id", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each sequence: shard, bin, capacity, the ids that it holds, and which pieces of which documents they are.
    encoded has an array of ids (null: none); a task holds the ids of one shard."""
    capacities = sorted(capacities)
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).where("size(ids) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _shards(batches, ["doc_id", "ids"]):
            bins: dict[int, list] = {}
            for d, p, s, n, b, c, o in place([len(x) for _, x in held], capacities, overhead):
                size, tokens, pieces = bins.setdefault(b, [c, [], []])
                tokens += held[d][1][s : s + n]
                pieces.append({"doc_id": held[d][0], "piece": p, "start": s, "n_tokens": n, "offset": o})
            out = [(shard, b, c, tokens, pieces) for b, (c, tokens, pieces) in bins.items()]
            for start in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[start : start + 256], strict=True), _SEQUENCE, strict=True)], schema=_SEQUENCE)

    pieces = "array<struct<doc_id:bigint,piece:int,start:bigint,n_tokens:bigint,offset:int>>"
    return _dealt(rows, ["doc_id", "ids"], shard_docs).mapInArrow(run, f"shard bigint, bin int, capacity int, ids array<int>, pieces {pieces}")
