"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import public_tokenizers
import tiktoken

import corpus_pipeline
from archloom.llm import bpe, pii, queries, toxicity
from archloom.llm.common import learned_split
from tests.llm.test_operators import word_runs

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram join", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), SF).columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), usable=learned_split("doc_id", 5) != 0)
    known = toxicity.Features()
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY)), special_tokens={}).encode_ordinary
    kept = [r for r in docs.collect() if model.score(toxicity.features_of(toxicity.words_of(r.text), known)) < 0.5]
    last = {r.text: r.doc_id for r in sorted(kept, key=lambda r: r.doc_id)}
    kept = [r for r in kept if last[r.text] == r.doc_id]
    sets = {r.doc_id: word_runs(r.text) for r in kept}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i for i in ids if top(i) == i}
    got = corpus_pipeline.run(spark, SF)
    # every document that stays is there whole, as many tokens as its text has after pseudonyms went in
    texts = {r.doc_id: r.text for r in pii.pseudonymise(docs.where(docs.doc_id.isin(sorted(want))), queries.PII_KEY).collect()}
    pieces: dict = {}
    for r in got.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    for i, spans in pieces.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) == len(encode(texts[i] or ""))
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    assert got.where("bin is not null").groupBy("shard", "bin").agg({"n_tokens": "sum", "capacity": "max"}).where("`sum(n_tokens)` > `max(capacity)`").count() == 0
