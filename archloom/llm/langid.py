"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed greedily into the longest phrases that
occur in that text; the fewer phrases it takes for its letters, the closer the language. Counts are normalised by the
number of characters parsed, and the language that needs the fewest phrases wins (the first by name among equals). The
score is the winner's share: the inverse of its phrases among the inverses of all languages' phrases.

Texts are lowered, and runs of characters that are neither letters (Unicode category L) nor marks on them (M) become one
blank. They are parsed whole, in stretches of STRETCH characters, which bounds the phrases that are cut; all stretches of a
batch and all languages go through the automata side by side. The transitions of all automata are one open-addressing table
of states and letters, so that room is needed for those that there are, whatever the size of the alphabets.

Learned from a bounded sample of whole texts: documents of a language by a hash of doc_id, those of LONG characters or
fewer first, until SAMPLE_CHARS characters or SAMPLE_ROWS documents are reached. Texts that are null or have no letter are
`und`, score 0. With no language learned, all texts are. Rows that repeat are taken once for the sample. Other columns pass
through; columns named like the results are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The labelled sample of a language: documents at most, characters from which on none is added, and the length of a document
#: up to which it comes first.
SAMPLE_ROWS, SAMPLE_CHARS, LONG = 48, 30_000, 20_000
STRETCH, LANES = 2048, 2048


@cache
def _gaps() -> re.Pattern[str]:
    """Runs of characters that are no letters and no marks."""
    kinds = groupby(range(0x110000), lambda c: unicodedata.category(chr(c))[0] in "LM")
    spans = [(run[0], run[-1]) for wanted, codes in kinds if wanted and (run := list(codes))]
    return re.compile(f"[^{''.join(f'{chr(a)}-{chr(b)}' for a, b in spans)}]+")


def normalise(text: str | None) -> str:
    """Lowered letters with single blanks between words, one at each end; empty if there is no letter."""
    words = _gaps().sub(" ", (text or "").lower()).strip(" ")
    return f" {words} " if any(map(str.isalpha, words)) else ""


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the states of the automaton of all substrings; state 0 is the start."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in text:
        now = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return to


class Transitions:
    """From a state and a letter, as one number, to the next state: open addressing, a third of the slots used at most."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, 3 * len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            open_ = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[open_]] = keys[open_]  # the last of those that want a slot gets it
            got = self.keys[slot] == keys
            self.targets[slot[got]] = targets[got]
            keys, targets, slot = keys[~got], targets[~got], slot[~got] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The targets, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys.take(slot)
        out = np.where(there == keys, self.targets.take(slot), -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.targets[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Parser:
    """Counts the phrases of texts under several languages at once."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        alphabet = sorted(set("".join(samples.values())))
        self.width = len(alphabet) + 1  # class 0: characters of no sample
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in alphabet]] = np.arange(1, self.width)
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        first, keys, targets, base = [], [], [], 0
        for name in self.names:
            states = suffix_automaton(samples[name])
            lost = len(states)  # after a character that the sample lacks, which is a phrase of its own
            begun = np.full(self.width, base + lost, np.int64)
            begun[[number[c] for c in states[0]]] = [base + t for t in states[0].values()]
            first.append(begun)
            keys += [(base + s) * self.width + number[c] for s, ways in enumerate(states) for c in ways]
            targets += [base + t for ways in states for t in ways.values()]
            base += lost + 1
        self.first = np.stack(first) if first else np.zeros((0, self.width), np.int64)
        self.next = Transitions(np.array(keys, np.int64), np.array(targets, np.int32))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each normalised text (rows) under each language (columns)."""
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        parts = [(i, t[s : s + STRETCH]) for i, t in enumerate(texts) for s in range(0, len(t), STRETCH)]
        parts.sort(key=lambda x: -len(x[1]))
        for start in range(0, len(parts), LANES):
            part = parts[start : start + LANES]
            lengths = np.array([len(t) for _, t in part])
            grid = np.zeros((lengths[0], len(part)), np.int32)
            flat = self.codes[np.frombuffer("".join(t for _, t in part).encode("utf-32-le"), np.uint32)]
            lane = np.repeat(np.arange(len(part)), lengths)
            grid[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lane] = flat
            active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # stretches longer than each place
            state = self.first[:, grid[0]]
            begun = np.ones((len(self.names), len(part)), np.int32)
            for place in range(1, lengths[0]):
                n = active[place]
                letters = grid[place, :n]
                there = self.next.find((state[:, :n] * self.width + letters).ravel()).reshape(-1, n)
                new = there < 0
                begun[:, :n] += new
                state[:, :n] = np.where(new, self.first[:, letters], there)
            np.add.at(counts, np.array([i for i, _ in part]), begun.T)
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [normalise(t) for t in texts]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        counts = self.phrases(clean)
        share = 1 / np.maximum(counts, 1)
        share /= share.sum(1, keepdims=True)
        best = counts.argmin(1)
        return [self.names[b] if t else "und" for b, t in zip(best, clean, strict=True)], [float(share[i, b]) if t else 0.0 for i, (b, t) in enumerate(zip(best, clean, strict=True))]


def learn(docs: DataFrame, usable: Column | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, long: int = LONG) -> dict[str, str]:
    """Normalised sample text of each language of docs (doc_id, text, lang). usable: which rows may teach (default: all)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if usable is None else usable))
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("of_text"))
    ranked = known.select(F.struct("doc_id", "lang", "of_text").alias("row"), "lang", (F.length("text") > long).alias("late"), F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("lang").orderBy("late", "h", "row")  # each task keeps only the first rows of a language
    chosen = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).groupBy("row").agg(F.min("place").alias("place"))
    # bounded by rows and languages
    told = known.withColumn("row", F.struct("doc_id", "lang", "of_text")).join(F.broadcast(chosen), "row")
    told = told.select("lang", "place", "text").dropDuplicates(["lang", "place"]).collect()
    samples: dict[str, str] = {}
    for r in sorted(told, key=lambda r: (r.lang, r.place)):
        if len(samples.get(r.lang, "")) < chars:
            samples[r.lang] = samples.get(r.lang, "") + normalise(r.text)
    return {k: v for k, v in samples.items() if v}


_parsers: dict[int, Parser] = {}


def parser(samples: dict[str, str]) -> Parser:
    """One parser for each set of samples in a process."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in into]
    schema = docs.select(*kept, F.lit("").alias(into[0]), F.lit(0.0).alias(into[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser(samples)
        for batch in batches:
            size = np.cumsum([len(v.as_py() or "") for v in batch.column(batch.schema.get_field_index(text))])
            cuts = [0, *(np.flatnonzero(np.diff(size // 4_000_000)) + 1).tolist(), batch.num_rows]  # 4 million characters at a time
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                names, scores = parse.predict(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *into])

    return docs.mapInArrow(run, schema)
