"""Joining documents whose sets of word n-grams have a Jaccard similarity of a threshold or more.

Words are the lowered runs of letters and digits of a text; an n-gram is a run of five of them (a shorter text is one
n-gram of all its words), kept as 64 bits. MinHash signatures are cut into bands; the numbers of bands and rows are those
with the fewest hashes that find a pair at the threshold with the target recall, and among them let through the fewest
pairs at half of it. Documents are shuffled on their band hashes, and every pair that shares a band is verified on the
full sets (see links).

Documents with the same set are one class, which is compared once and counts as often as it occurs. Texts without words
(null and empty ones too) link with nothing. Rows that repeat a doc_id count as documents of their own. A null doc_id
links with nothing. Other columns are ignored, and passed through by `drop_near_copies`, which keeps one row of each
component: the least doc_id, of rows that repeat it the least hash of a text, and any one of rows that repeat both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import cut, free
from archloom.llm.links import find_links

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.995
_WORD = re.compile(r"[^\W_]+")


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """Bands and rows of a band. A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands."""
    found = lambda s, b, r: 1 - (1 - s**r) ** b
    fit = [(b, r) for r in range(2, 16) for b in range(1, most // r + 1) if found(threshold, b, r) >= recall]
    return min(fit, key=lambda x: (round(found(threshold / 2, *x), 2), x[0] * x[1]))


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_STEPS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def ngrams(text: str | None, known: WordHashes, n: int = WORDS) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    acc = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):  # the place of a word counts
        acc = (acc ^ (h[i : i + len(acc)])) * _STEPS[i % len(_STEPS)]
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


class MinHash:
    """Band hashes of sets of 64-bit numbers."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = random.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = random.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.mix = random.integers(1, 2**62, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = random.integers(1, 2**62, bands, dtype=np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(low), 4096):  # stays in the cache
            x, y = low[start : start + 4096], high[start : start + 4096]
            for k in range(len(self.a)):
                v = (x * self.a[k] + self.b[k]) ^ y  # y breaks the order that multiples of odd numbers keep
                v *= np.uint32(0x85EBCA6B)
                least[k] = min(least[k], v.min())
        h = (least.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)) * self.mix
        h = h.sum(1) + self.salt
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)).view(np.int64)


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, a hash of the text that tells rows of one doc_id apart, and the text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def _signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = WordHashes(), MinHash(bands, rows)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, out = batch.slice(start, 512), []
                for t in part.column(2):
                    grams = ngrams(t.as_py(), known, n)
                    out.append((xxhash.xxh3_128_digest(grams.tobytes()), len(grams), hasher.keys(grams)) if len(grams) else (None, 0, None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.list_(pa.int64()))))], names=["doc_id", "row", "set", "size", "keys"])

    return _named(docs, doc_id, text).mapInArrow(run, "doc_id bigint, row bigint, set binary, size int, keys array<bigint>")


def _sets(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                grams = [ngrams(t.as_py(), known, n).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(g) for g in grams], pa.binary()), pa.array(grams, pa.binary())], names=["doc_id", "set", "payload"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, set binary, payload binary")


def jaccard_links(threshold: float):
    """Verification on full sets: which of the candidates share enough n-grams with a row."""

    def prepare(payloads: list[bytes]):
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        sizes = np.array([len(s) for s in sets])
        words, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        present = np.zeros(len(words), np.int32)

        def linked(i: int, near: np.ndarray) -> np.ndarray:
            out = np.zeros(len(near), bool)
            fit = np.flatnonzero(np.minimum(sizes[near], sizes[i]) >= threshold * np.maximum(sizes[near], sizes[i]))
            own = number[ends[i] - sizes[i] : ends[i]]
            present[own] = 1
            for start in range(0, len(fit), 256):
                some = near[fit[start : start + 256]]
                grams = np.concatenate([number[ends[j] - sizes[j] : ends[j]] for j in some])
                common = np.add.reduceat(present[grams], np.r_[0, np.cumsum(sizes[some])[:-1]])
                out[fit[start : start + 256]] = common >= threshold * (sizes[some] + sizes[i] - common) - 1e-9
            present[own] = 0
            return out

        return linked

    return prepare


def _components(docs: DataFrame, threshold: float, recall: float, n: int, doc_id: str, text: str) -> DataFrame:
    """A row for each row of docs: doc_id, row, n_links, and first, the least doc_id and row that links lead to (its own
    where it links with nothing, null for a null doc_id)."""
    bands, rows = bands_for(threshold, recall)
    signed = cut(_signatures(docs, doc_id, text, n, bands, rows))
    usable = signed.where("set is not null and doc_id is not null").withColumn("first", F.struct("doc_id", "row"))
    same = usable.groupBy("set").agg(F.min("first").alias("first"), F.count("*").alias("many"), F.min_by("keys", "first").alias("keys"), F.max("size").alias("size"))
    # a class goes by a hash of its set; the documents that stand for classes are found by doc_id and set
    classes = cut(same.select(F.xxhash64("set").alias("id"), "set", "first", "many", "keys", (F.col("size") * 8).alias("weight")))

    def payloads(need: DataFrame) -> DataFrame:
        chosen = classes.join(need, "id").select("id", F.col("set").alias("_set"), F.col("first.doc_id").alias("_doc"), F.col("first.row").alias("_row"))
        texts = _named(docs, doc_id, text).join(chosen.select(F.col("_doc").alias("doc_id"), F.col("_row").alias("row")), ["doc_id", "row"], "left_semi")
        made = _sets(texts, "doc_id", "text", n)
        return made.join(chosen, (F.col("doc_id") == F.col("_doc")) & (F.col("set") == F.col("_set"))).select("id", "payload")

    linked = find_links(classes.select("id", "many", "weight", "keys"), payloads, jaccard_links(threshold))
    # components go by class; name each by its least document
    joined = classes.select("id", "set", "first", "many").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = joined.groupBy("component").agg(F.min("first").alias("first"))
    found = joined.drop("first").join(named, "component").select(F.col("set").alias("_set"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "first")
    out = signed.select("doc_id", "row", "set").join(found, (F.col("set") == F.col("_set")) & F.col("doc_id").isNotNull(), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))
    return out.select("doc_id", "row", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", own).alias("first"))


def link_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_links (documents that it is linked with), component_id (the least doc_id that
    links lead to), kept (doc_id = component_id)."""
    found = _components(docs, threshold, recall, n, doc_id, text)
    return found.select("doc_id", "n_links", F.col("first.doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that aren't the first of their component."""
    _id, _row = free(docs, "_id", "_row")
    found = _components(docs, threshold, RECALL, WORDS, doc_id, text).where("doc_id is not null and n_links > 0")
    linked = cut(found.select(F.col("doc_id").alias(_id), F.col("row").alias(_row), (F.struct("doc_id", "row") == F.col("first")).alias("first")))
    gone = linked.where("not first").drop("first")
    repeated = cut(linked.where("first").groupBy(_id, _row).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = docs.withColumns({_id: F.col(doc_id).cast("long"), _row: F.xxhash64(text)})
    once = rows.join(gone.unionByName(repeated), [_id, _row], "left_anti")
    return once.unionByName(rows.join(repeated, [_id, _row], "left_semi").dropDuplicates([_id, _row])).select(docs.columns)
