"""A toxicity classifier that is regularised by counterfactuals.

Logistic regression on the presence of words and of their first letters (four, five and six), hashed into a table of
fixed size. In every labelled sentence that names a group, the identity term is swapped for the others of its set; in one
that names none, a term of a set is inserted and swapped for another one. The squared change of the score under these swaps
is added to the loss. The terms themselves are compared in the same way, so that groups that the sample doesn't name are
held together too. Neutral mentions of a group then weigh the same for all groups. Features of identity terms are always
part of the model; others are kept if they tell the classes apart.

Training takes a bounded sample of the labelled rows: SAMPLE documents at most, least by a hash of doc_id; of rows that
repeat a doc_id the least text counts. How often each feature occurs in each class is counted in Spark, and a row sends the
driver no more than the numbers of its features that are kept. Scoring reads each whole text once. Null text counts as
empty; an empty text gets the score of the bias alone. Labels other than 0 and 1 and documents without a label teach
nothing; of a document with several labels the greatest counts. If the sample lacks a class, all scores are that class's
frequency. Other columns pass through; a column named like the score is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import cut, free, whole_text

#: Labelled rows that the classifier learns from, at most.
SAMPLE = 6000
BITS, ROUNDS, L2, COUNTERFACTUAL = 18, 150, 2e-3, 30.0
#: Features are kept if their frequencies in the two classes are so many standard errors apart, in so many rows.
SCREEN, RARE = 3.0, 3
#: Words that name groups; the terms of a set stand in for each other.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "christians", "muslims", "jews", "hindus"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab", "indian", "mexican"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "native", "foreigner", "immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly", "teenage", "disabled", "deaf", "blind"),
)
WORD = re.compile(r"[^\W_]+")
SETS = {word: group for group in IDENTITY for word in group}


class Features(dict):
    """The hashed features of a word; remembers a bounded number of words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        names = {"w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}
        self[word] = found = tuple(zlib.crc32(n.encode()) >> (32 - BITS) for n in sorted(names))
        return found


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str], known: Features) -> np.ndarray:
    """Sorted numbers of the features that are present."""
    return np.array(sorted({f for w in words for f in known[w]}), dtype=np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, present: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[present].sum(), -30, 30))))


def swaps(words: set[str]) -> Iterator[tuple[str, str]]:
    """Identity terms that are present, each with the other terms of its set."""
    for word in sorted(words & SETS.keys()):
        yield from ((word, other) for other in SETS[word] if other != word)


def identity_features(known: Features) -> set[int]:
    return {f for word in SETS for f in known[word]}


def telling(clean: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which features differ in frequency between the classes by SCREEN standard errors and occur in RARE rows at least.
    clean and bad: in how many rows of a class each occurs; n: rows of the classes."""
    both = (clean + bad) / max(n.sum(), 1)
    error = np.sqrt(both * (1 - both) * (1 / np.maximum(n, 1)).sum()) + 1e-12
    return (np.abs(bad / max(n[1], 1) - clean / max(n[0], 1)) >= SCREEN * error) & (clean + bad >= RARE)


def changes_of(names: set[str], there: np.ndarray, pick: int, known: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features that each swap takes from a sentence and adds to it. One that names no group gets one of the terms first,
    drawn by `pick`."""
    of_word = lambda w: features_of({w}, known)
    if names:
        return [(of_word(a), np.setdiff1d(of_word(b), there)) for a, b in swaps(names)]
    group = IDENTITY[pick % len(IDENTITY)]
    a, b = (pick // len(IDENTITY) + np.array([0, 1 + pick // 997 % (len(group) - 1)])) % len(group)
    return [(np.setdiff1d(of_word(group[a]), there), np.setdiff1d(of_word(group[b]), there))]


def fit(rows: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], strength: float = COUNTERFACTUAL) -> Model:
    """rows: the kept features of each sentence. changes: features that a swap takes away and those that it adds."""
    size, n = 1 << BITS, max(1, len(rows))
    share = float(labels.mean()) if len(labels) else 0.5
    start = np.log((share + 0.5 / n) / (1 - share + 0.5 / n))
    if not len(labels) or share in (0.0, 1.0):
        return Model(np.zeros(size), float(start))
    flat, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
    of = np.repeat(np.arange(n), lengths)
    pairs = np.concatenate([np.concatenate([a, b]) for a, b in changes]) if changes else np.zeros(0, np.int32)
    signs = np.concatenate([np.repeat([-1.0, 1.0], [len(a), len(b)]) for a, b in changes]) if changes else np.zeros(0)
    pair_of = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes]) if changes else np.zeros(0, int)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # half way to balanced classes
    w, b = np.zeros(size), float(start)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(of, weights=w[flat], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        grad = np.bincount(flat, weights=error[of], minlength=size) + L2 / 10 * w
        if len(changes):
            change = np.bincount(pair_of, weights=signs * w[pairs], minlength=len(changes))
            grad += np.bincount(pairs, weights=2 * strength / len(changes) * signs * change[pair_of], minlength=size)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
        rate = 0.1 * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t) * (1 - t / (ROUNDS + 1)) ** 0.5
        w -= rate * m / (np.sqrt(v) + 1e-6)
        b -= rate * mb / (np.sqrt(vb) + 1e-6)
    return Model(w, float(b))


def _featured(rows: DataFrame, kept: np.ndarray | None) -> DataFrame:
    """doc_id, toxic, features (only those kept, if given) and the identity terms that are named. rows: doc_id, toxic, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Features()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [words_of(t) for t in part.column(2).to_pylist()]
                found = [features_of(w, memory) for w in made]
                found = found if kept is None else [np.intersect1d(f, kept) for f in found]
                named = [" ".join(sorted(w & SETS.keys())) for w in made]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(named, pa.string())], names=["doc_id", "toxic", "features", "named"])

    return rows.mapInArrow(run, "doc_id bigint, toxic int, features array<int>, named string")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, usable: Column | None = None, strength: float = COUNTERFACTUAL) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic). usable: which doc_ids may teach (default: all). strength:
    weight of the penalty on score changes."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable))
    taught = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    present = taught.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    # the sample: a bounded number of ids, the same whatever the partitions
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    told = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    told = cut(told.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(F.col("doc_id").cast("long"), "toxic", "text"))
    n = {r.toxic: r["count"] for r in told.groupBy("toxic").count().collect()}
    each = _featured(told, None).select("toxic", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad")).where(F.col("clean") + F.col("bad") >= RARE).collect()
    clean, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)  # at most as many rows came
    for feature, c, b in counts:
        clean[feature], bad[feature] = c, b
    memory = Features()
    kept = np.union1d(np.flatnonzero(telling(clean, bad, np.array([n.get(0, 0), n.get(1, 0)], float))), sorted(identity_features(memory))).astype(np.int32)
    rows = sorted(_featured(told, kept).collect())
    there = [np.array(r.features, np.int32) for r in rows]
    changes = [c for r, f in zip(rows, there, strict=True) for c in changes_of(set(r.named.split()), f, zlib.crc32(str(r.doc_id).encode()), memory)]
    of_word = lambda w: features_of({w}, memory)
    changes += [(of_word(g[0]), of_word(x)) for g in IDENTITY for x in g[1:]]
    return fit(there, np.array([r.toxic for r in rows], float), changes, strength)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced. The model is a table of fixed size (1 MB)."""
    kept = [c for c in docs.columns if c != into]
    weights, bias = model.weights.astype(np.float32), model.bias
    schema = docs.select(*kept, F.lit(0.0).alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = weights.astype(float).tolist()
        memory = Features()

        def one(text: str | None) -> float:
            words = words_of(text or "")
            present: set[int] = set()
            for found in map(memory.__getitem__, words):
                present.update(found)
            z = bias + sum(map(listed.__getitem__, sorted(present)))
            return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = [one(v.as_py()) for v in part.column(part.schema.get_field_index(text))]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(scores, pa.float64())], names=[*kept, into])

    return docs.mapInArrow(run, schema)
