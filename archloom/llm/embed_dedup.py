"""Near-duplicate embeddings by E8 lattice hashing.

A unit vector is projected by random Gaussian matrices to groups of eight coordinates, which are decoded to the nearest
point of the E8 lattice; the points of a table's groups together are its cell. Cells next to it are probed as well, those
whose lattice points are nearest to the projection first. Vectors with a cell in common in any table are compared by
their cosine in double precision (see links). The number of groups grows with the logarithm of the number of vectors, so
that a cell holds few vectors that aren't alike.

Equal vectors are hashed once and count as often as they occur. Null and zero vectors and those with null or non-finite
components link with nothing; vectors of different lengths aren't compared. Rows that repeat a vec_id are vectors of
their own in counts and share its component; a null vec_id links with nothing. Label and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.llm.common import cut
from archloom.llm.links import find_links

#: For g groups there are TABLES * g * (g + 1) tables with PROBES * g probed cells besides a vector's own (twice as many for
#: five groups, the most); width of the lattice in standard deviations. Recall at a cosine of just 0.9 is 0.95 or more for
#: all numbers of groups.
TABLES, PROBES, WIDTH, SEED = 2, 2, 1.9, 20
#: Cells that unit vectors of no kinship spread over with one group, roughly.
SPREAD = 400
MOST_GROUPS = 5


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0...) and all (+-1/2)^8 with an even number of minus signs."""
    whole = [[0] * i + [a] + [0] * (j - i - 1) + [b] + [0] * (7 - j) for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half, float)


ROOTS = roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(-1)
    odd = np.flatnonzero(r.sum(-1) % 2 != 0)
    at = worst[odd]
    r[odd, at] += np.where(off[odd, at] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point to each row of eight coordinates."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return np.where(closer[:, None], a, b)


class LatticeHash:
    """Cell keys of unit vectors of one length."""

    def __init__(self, length: int, groups: int, tables: int | None = None, probes: int | None = None, width: float = WIDTH):
        tables, probes = tables or TABLES * groups * (groups + 1), probes or PROBES * groups * (2 if groups >= MOST_GROUPS else 1)
        random = np.random.default_rng([SEED, length, groups])
        self.groups, self.tables, self.probes = groups, tables, probes
        self.matrix = random.standard_normal((length, tables * groups * 8)) / width
        self.odd = random.integers(1, 2**62, (tables, groups, 8), dtype=np.int64) * 2 + 1
        self.salt = random.integers(-(2**62), 2**62, tables, dtype=np.int64)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Own cell and probed cells in each table, as 64-bit keys: rows, then tables times (1 + probes)."""
        n = len(vectors)
        spots = (vectors @ self.matrix).reshape(n, self.tables, self.groups, 8)
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            home, extra, moved = np.full(n, self.salt[t]), [], []
            for g in range(self.groups):
                x = spots[:, t, g]
                point = nearest_e8(x)
                home = home + ((point * 2).astype(np.int64) * self.odd[t, g]).sum(-1)
                # squared distance to home + root, less that to home, for all roots
                extra.append(2 - 2 * (x - point) @ ROOTS.T)
                moved.append(((ROOTS * 2).astype(np.int64) * self.odd[t, g]).sum(-1))
            cost, step = np.concatenate(extra, 1), np.concatenate(moved)
            pick = np.argpartition(cost, self.probes, 1)[:, : self.probes]
            out[:, t, 0] = home
            out[:, t, 1:] = home[:, None] + step[pick]
        return _mix(out).reshape(n, -1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys."""
    u = x.view(np.uint64) if x.flags.c_contiguous else np.ascontiguousarray(x).view(np.uint64)
    u = (u ^ (u >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (u ^ (u >> np.uint64(29))).view(np.int64)


def groups_for(n: int) -> int:
    """Groups of eight coordinates for n vectors."""
    return min(MOST_GROUPS, max(1, math.ceil(math.log(max(n, 2)) / math.log(SPREAD))))


def _unit(payloads: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.stack([np.frombuffer(p, kind) for p in payloads]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def link_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", groups: int | None = None) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: x.cast("double") + 0.0).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    distinct = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("many")).withColumn("id", F.xxhash64("v")))
    n = groups or groups_for(distinct.count())
    source = vectors.schema[embedding].dataType  # floats are sent as they are and compared as doubles
    kind = np.float32 if isinstance(source, T.ArrayType) and isinstance(source.elementType, T.FloatType) else np.float64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, LatticeHash] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raw = [np.array(v, np.float64) for v in part.column("v").to_pylist()]
                keys: list = [None] * len(raw)
                for length in {len(v) for v in raw}:
                    hasher = made.setdefault(length, LatticeHash(length, n))
                    at = [i for i, v in enumerate(raw) if len(v) == length]
                    x = np.stack([raw[i] for i in at])
                    x = x / np.abs(x).max(1, keepdims=True)
                    for i, k in zip(at, hasher.keys(x / np.sqrt((x * x).sum(1, keepdims=True))), strict=True):
                        keys[i] = k
                sent = [v.astype(kind).tobytes() for v in raw]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("many"), pa.array([len(s) for s in sent], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sent, pa.binary())], names=["id", "many", "weight", "keys", "payload"])

    records = cut(distinct.mapInArrow(hashed, "id bigint, many bigint, weight int, keys array<bigint>, payload binary"))

    def prepare(payloads: list[bytes]):
        lengths = np.array([len(p) for p in payloads])
        place, units = np.zeros(len(payloads), int), {}
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            place[at], units[length] = np.arange(len(at)), _unit([payloads[i] for i in at], kind)

        def linked(i: int, near: np.ndarray) -> np.ndarray:
            x, same = units[lengths[i]], lengths[near] == lengths[i]
            same[same] = x[place[near[same]]] @ x[place[i]] >= threshold
            return same

        return linked

    linked = find_links(records, lambda need: records.select("id", "payload").join(need, "id"), prepare)
    joined = distinct.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    found = joined.join(named, "component").select(F.col("v").alias("_v"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id")
    out = rows.join(found, F.col("v") == F.col("_v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
