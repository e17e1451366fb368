"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from archloom.llm import bpe, chat, embed_dedup, exact_dedup, langid, line_dedup, links, ngram_join, packing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = "doc_id bigint, text string"
#: Names that operators use inside for frames that hold other columns too.
CLASHING = "hash keys n row _id _row _hash _keep _key _ties _going _left _found _gaps _doc _set _toxic first component links set content copies changes masked leaf key shard bin".split()


def docs_of(spark, rows, extra=True):
    """Documents with columns that clash with names used inside."""
    df = spark.createDataFrame(rows, TEXTS)
    return df.withColumns({c: F.lit("mine") for c in CLASHING}) if extra else df


# 1 -------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    return bpe.serialise_model(bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY)))


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(model, reference):
    codec, rng = bpe.codec(model, public_tokenizers.PATTERN), random.Random(1)
    parts = ["a", "é", "中", "😀", " ", "\n", "\t", "1", "!", "ing", "the", "\x00", "▁", "'s", "　", "ß", "Ж", "́", "ÿ", "  "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()
    long = "ab " * 50_000 + "x" * 100_000
    assert codec.decode(codec.encode(long)) == long.encode()


def test_bpe_remembers_few_characters(model, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_CHARACTERS", 5_000)
    codec, rng = bpe.ByteBpe(model, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.choice([3, 900]))) for _ in range(4)) + " the same again"
        assert codec.encode(text) == reference.encode_ordinary(text)
        held = sum(map(len, codec.young)), sum(map(len, codec.old))
        assert codec.characters == held[0] and max(held) <= 5_000 + len(text)


def test_bpe_frames(spark, model, reference):
    docs = docs_of(spark, [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x y")]).withColumn("ids", F.lit("clash"))
    encoded = bpe.encode_frame(docs, model, public_tokenizers.PATTERN)
    decoded = bpe.decode_frame(encoded, model, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in decoded) == ["", "", "Hello world", "Hello world", "x y"]
    assert all(r.hash == "mine" and list(r.ids) == reference.encode_ordinary(r.text or "") for r in decoded)
    one = bpe.round_trip(docs.where("doc_id = 2"), model, public_tokenizers.PATTERN).first()
    assert one.n_tokens == 0 and one.ids_sha256 == one.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip(docs.limit(0), model, public_tokenizers.PATTERN).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------
def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii(spark):
    rows = [(1, "call +1 (523) 555-1055 or a.b19@mail5.example.com!"), (2, "4994226020900891 and 4994226020900891, not 4994226020900892"), (3, "4994-2260-2090-0891 on 1990-02-28 or 28/02/1990"), (4, "ip 233.233.171.252!! v 2.0. 1.2.3.4.5 300.1.1.1"), (5, "DE89 3704 0044 0532 0130 00"), (6, "078-05-1120 but 000-12-1234"), (7, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###'), (8, None), (9, ""), (10, "clean 12 text, version 3.0"), (11, "a@b.org " * 3 + "x" * 200_000)]
    docs = docs_of(spark, rows).withColumn("pii", F.lit("clash"))
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    for i, text in rows:
        if i in (8, 9, 10):
            assert got[i].text == text and got[i].pii == []
    for r in got.values():
        old = dict(rows)[r.doc_id]
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]", "0", s))
        for x in r.pii:
            value = old[x.start : x.start + x.length]
            assert value not in r.text or x.kind == "email" and len(value) < 10
            assert x.kind == "ipv4" or shape(value.split("@")[0].lower()) == shape(x.pseudonym.split("@")[0].lower())
    cards = re.findall(r"\d{16}", got[2].text)
    assert cards[0] == cards[1] != "4994226020900891" and luhn(cards[0]) and cards[2] == "4994226020900892"
    assert got[3].pii[0].pseudonym.replace("-", "") == cards[0]
    iso, day = got[3].pii[1].pseudonym, got[3].pii[2].pseudonym
    assert iso == "-".join(reversed(day.split("/")))
    assert [x.kind for x in got[4].pii] == ["ipv4"] and "300.1.1.1" in got[4].text and "1.2.3.4.5" in got[4].text
    solid = got[5].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97 == 1
    assert "000-12-1234" in got[6].text and len(got[6].pii) == 1 and len(got[11].pii) == 3
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0
    other = pii.pseudonymise(docs.where("doc_id = 2"), "other key").first()
    assert other.text != got[2].text


def found_in(spark, texts):
    got = {r.doc_id: r for r in pii.pseudonymise(docs_of(spark, list(enumerate(texts))), "k").collect()}
    return [[(x.kind, t[x.start : x.start + x.length], x.pseudonym) for x in got[i].pii] for i, t in enumerate(texts)]


def test_pii_of_neighbouring_values(spark):
    phones, ibans = ["+1 (826) 555-4081", "+44 20 7946 0958", "+33 1 42 68 53 00", "(826) 555-4081", "+49 30 1234 5678"], ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]
    after = [("ipv4", "190.137.223.204"), ("date", "1990-02-28"), ("date", "28/02/1990"), ("card", "4994 2260 2090 0891"), ("ssn", "078-05-1120")]
    pairs = [(("phone", v), a) for v in phones for a in after[:3]] + [(("phone", v), (None, "1990")) for v in phones[:4]] + [(("phone", v), a) for v in phones[:4] for a in after[3:]]
    pairs += [(("iban", v), a) for v in ibans for a in [*after, (None, "1990"), (None, "AND")]]
    got = found_in(spark, [f"{v} {w}" for (_, v), (_, w) in pairs] + [v for (_, v), _ in pairs])
    for (value, other), both, alone in zip(pairs, got, got[len(pairs) :], strict=False):
        assert [x[:2] for x in both] == [x for x in (value, other) if x[0]] and both[0] == alone[0]


def test_pii_of_any_case_and_time(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    days = ["1890-05-04", "0001-01-01", "1599-12-31", "1600-01-01", "1899-12-31", "2099-08-04", "2099-08-05", "2199-12-31", "2200-01-01", "9999-12-31"]
    got = found_in(spark, [f"token = {secret}", f'TOKEN = "{secret.upper()}"', f"Token: {secret}", f"no word {secret.upper()}", "born 1990-02-28T12:00:00Z", "born 1990-02-28", "1990-02-28Tx", *days, "0000-01-01"])
    assert [x[0][:2] for x in got[:3]] == [("secret", secret), ("secret", secret.upper()), ("secret", secret)] and got[0][0][2] == got[2][0][2] == got[1][0][2].lower() != secret
    assert got[1][0][2].isupper() and got[3] == got[6] == got[-1] == [] and got[4] == got[5] != []
    assert [x[0][:2] for x in got[7:-1]] == [("date", d) for d in days]
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\d", x[0][2]) and x[0][2] != x[0][1] for x in got[7:-1])


def test_pii_links_numbers_however_they_are_spelled(spark):
    spelled = ["+1 (523) 555-1055", "+15235551055", "(523) 555-1055", "523-555-1055", "+1.523.555.1055", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+442079460958"]
    got = [x[0] for x in found_in(spark, spelled)]
    digits = [re.sub(r"[^0-9]", "", p.replace("(0)", "")) for _, _, p in got]
    assert [x[1] for x in got] == spelled and {d[-10:] for d in digits[:5]} == {digits[0][1:]} and len({d for d in digits[5:]}) == 1
    assert all(re.sub(r"\d", "0", p) == re.sub(r"\d", "0", v) for _, v, p in got) and all(p.startswith(v[:2]) for _, v, p in got if v[0] == "+")
    assert digits[0][1:] != "5235551055" and found_in(spark, ["+1 (523) 555-105", "+33 1 42 68 53"]) == [[], []]


def test_pii_spans_and_long_values(spark):
    rng = random.Random(13)
    values = [f"{rng.randrange(1, 255)}.{rng.randrange(256)}.1.{rng.randrange(256)}" for _ in range(300)]
    gaps = ["é" * rng.randrange(4) + " " for _ in values]
    text = "".join(g + v for g, v in zip(gaps, values, strict=True))
    long = [f"{'x' * 90}@mail.example.com", f"token={'0123456789abcdef' * 20}"]
    got = found_in(spark, [text, *long])
    assert [v for _, v, _ in got[0]] == values and [x[0][1] for x in got[1:]] == [long[0], long[1][6:]]
    assert all(x[0][2] != x[0][1] and len(x[0][2]) == len(x[0][1]) for x in got[1:])
    sums = spark.sql("select array(3,1,4,1,5,9,2) a union all select array(7) union all select cast(array() as array<int>) union all select null")
    assert sorted(map(str, (r[0] for r in sums.select(pii.running_sum(F.col("a"))).collect()))) == sorted(map(str, [[3, 4, 8, 9, 14, 23, 25], [7], [], None]))


def test_early_and_late_dates_are_permuted(spark):
    df = spark.sql("select date_format(day, 'yyyy-MM-dd') d from (select explode(sequence(date'1600-01-01', date'1899-12-31')) day union all select explode(sequence(date'2099-08-05', date'2199-12-31')))").where("substr(d, 9) < '04'")
    got = df.select("d", pii.pseudonym(F.col("d"), F.lit("date"), "k").alias("p"))
    assert got.where("(d < '1900') = (p between '1600' and '1900') and (d > '2000') = (p between '2099-08-05' and '2200')").select("p").distinct().count() == df.count()


def test_pii_is_a_permutation(spark):
    n = 400
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    got = df.select(pii.permute_string(F.col("v"), "k", "x").alias("v"), pii.pseudonym(F.col("d"), F.lit("date"), "k").alias("d"))
    assert got.select("v").distinct().count() == n and got.select("d").distinct().count() == n


def test_pii_plan_has_no_python(spark):
    plan = queries.op2_pii(spark, SF)._jdf.queryExecution().executedPlan().toString() + queries.op9_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3 -------------------------------------------------------------------------------------------------------------------
def test_grace_spills_and_merges():
    rng = random.Random(3)
    contents = [bytes([rng.randrange(256) for _ in range(rng.randint(0, 400))]) for _ in range(300)]
    records = [(hashlib.sha256(c).digest(), c, i, 1, 1) for i, c in enumerate(rng.choices(contents, k=2000))]
    want: dict = {}
    for _, c, i, *_ in records:
        want[c] = (max(i, want.get(c, (0, 0))[0]), want.get(c, (0, 0))[1] + 1)
    for room in (1, 5_000, 1 << 30):
        assert {c: (doc, n) for _, c, doc, _, n in exact_dedup.grace(iter(records), room)} == want
    same = hashlib.sha256(b"").digest()  # contents that share a hash are still told apart
    clash = [(same, bytes([i]), i, 1, 1) for i in range(40)]
    assert len(list(exact_dedup.grace(iter(clash), 100))) == 40


def test_exact_dedup(spark):
    docs = docs_of(spark, [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (9, "b" * 100_000), (7, "c"), (7, "c"), (None, "d"), (None, "a")])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(docs, room=100).collect()), key=str)
    want = [(1, 5, 4, False), (5, 5, 4, True), (3, 5, 4, False), (None, 5, 4, False), (2, 4, 2, False), (4, 4, 2, True), (9, 9, 1, True), (7, 7, 2, True), (7, 7, 2, False), (None, None, 1, True)]
    assert got == sorted(want, key=str)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([5, 4, 9, 7, None], key=str)
    assert exact_dedup.classes(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_exact_dedup_of_many_repeated_rows(spark, monkeypatch):
    """Rows that repeat id and text are counted and listed again; whatever the partitions, one of them stays."""
    monkeypatch.setattr(exact_dedup, "RUN", 7)
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None, ""])) for _ in range(300)]
    docs = docs_of(spark, rows).repartition(5)
    plain: dict = {}
    for i, text in rows:
        plain.setdefault(text or "", []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in plain.items()}
    got = exact_dedup.classes(docs).collect()
    assert len(got) == 300 and sum(r.kept for r in got) == len(plain) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert sorted((r.text_sha256, r.keep_id, r.group_size) for r in got if r.kept) == sorted((hashlib.sha256(t.encode()).hexdigest(), top[t], len(ids)) for t, ids in plain.items())
    assert sorted((r.text or "", r.doc_id) for r in exact_dedup.drop_copies(docs).collect()) == sorted(top.items())


# 4, 5 ----------------------------------------------------------------------------------------------------------------
def components_of(ids, pairs):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_lattice_points():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8)) * 2
    got = embed_dedup.nearest_e8(x)
    twice = (got * 2).round().astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all()) and (got.sum(1) % 2 == 0).all() and embed_dedup.ROOTS.shape == (240, 8)
    near = np.array([((x[i] - got[i] - embed_dedup.ROOTS) ** 2).sum(1).min() for i in range(200)])
    assert (((x - got) ** 2).sum(1) <= near + 1e-9).all()  # no neighbour is closer


@pytest.mark.parametrize("groups", [1, 2, 3, 4, 5])
def test_lattice_recall_at_the_threshold(groups):
    """Pairs with a cosine of just 0.9."""
    rng = np.random.default_rng(groups)
    a, b = (rng.standard_normal((250, 48)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9001 * a + (1 - 0.9001**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    hasher = embed_dedup.LatticeHash(48, groups)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(hasher.keys(a), hasher.keys(b), strict=True)]) >= 0.9


@pytest.mark.parametrize("groups", [1, 2, 3])
def test_embedding_links(spark, groups, monkeypatch):
    monkeypatch.setattr(links, "BLOCK_RECORDS", 16)  # the large group is cut into blocks
    rng = np.random.default_rng(groups)
    base = rng.standard_normal((60, 32))
    rows = [v for v in base]
    rows += [base[0] + 0.04 * rng.standard_normal(32) for _ in range(60)]
    rows += [base[i] * 3 for i in range(5)] + [base[7].copy(), base[7].copy()]
    rows += [v + 0.07 * rng.standard_normal(32) for v in base[10:30] for _ in range(2)]
    x = np.array(rows)
    special = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0, 2.0]]
    data = [(i, [float(f) for f in v], 0) for i, v in enumerate(x)] + [(1000 + i, v, 1) for i, v in enumerate(special)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int").withColumns({"keys": F.lit(0), "v": F.lit(1)})
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in embed_dedup.link_vectors(vectors, groups=groups).collect()}
    assert len(got) == len(data)
    found, there = sum(got[i].n_links for i in range(len(x))), close.sum()
    assert 0.97 * there <= found <= there
    want = components_of(range(len(x)), np.argwhere(close).tolist())
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(5))
    assert embed_dedup.link_vectors(vectors.limit(0)).count() == 0


def test_embedding_links_of_floats_and_repeated_ids(spark):
    rows = [(1, [1e30, 2e30, 3e30]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (5, [1e-40, 2e-40, 3e-40]), (6, [3.0, -1.0, 0.0]), (6, None)]
    got = embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 0, None), (5, 2, 1), (6, 0, 6), (6, 0, 6)], key=str)


def test_embedding_links_of_two_lengths(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.01]), (3, [3.0, 1.0, 2.0, 5.0]), (4, [3.0, 1.0, 2.0, 5.01]), (5, [-3.0, 1.0, 2.0, -5.0])]
    got = embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_bands():
    b, r = ngram_join.bands_for()
    assert 1 - (1 - 0.8**r) ** b >= 0.995 and b * r <= 160


def word_runs(text):
    """The set of runs of five words, by plain Python."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_keep_one_row_of_each_group(spark):
    rng = random.Random(4)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(2))
    rows = [(3, b), (5, a), (5, f"{b} more"), (7, a), (None, b), (9, ""), (9, None), (11, "one"), (11, "one")]
    left = ngram_join.drop_near_copies(docs_of(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, b), (5, a), (None, b), (9, ""), (9, None), (11, "one")], key=str)


def test_ngram_links(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK_RECORDS", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(30)]

    def changed(text, n):
        parts = text.split()
        for _ in range(n):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        return " ".join(parts)

    texts = base + [changed(base[0], 1) for _ in range(50)] + [base[1], base[1].upper(), base[2] + "!"] + [changed(b, k % 5) for k, b in enumerate(base)] + ["one two", "One, two.", "", None, "...", " ".join(base)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "w1 w2 w3")]
    sets = [word_runs(t) for _, t in rows]
    ids = list(range(len(rows)))
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for i in ids for j in ids if i < j and rows[i][0] is not None and rows[j][0] is not None and near(sets[i], sets[j])]
    want = {i: 0 for i in ids}
    for i, j in pairs:
        want[i] += 1
        want[j] += 1
    docs = docs_of(spark, rows)
    got = ngram_join.link_documents(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert sum(r.n_links for r in got) >= 0.99 * sum(want.values())
    assert all(by_id[rows[i][0]].n_links <= want[i] for i in ids if rows[i][0] is not None)
    component = components_of(ids, pairs)
    assert np.mean([by_id[rows[i][0]].component_id == rows[component[i]][0] for i in ids if rows[i][0] is not None]) > 0.99
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}
    assert ngram_join.link_documents(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 501 + i) for i in range(200)]
    got = {r.id: r.component for r in links.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: c for i, c in components_of(ids, [p for p in pairs if p[0] != p[1]]).items()}


# 6 -------------------------------------------------------------------------------------------------------------------
def test_chat_round_trip():
    rng = random.Random(6)
    parts = ["</s>", "[INST]", "[/INST]", "<s>", "[OUT]", "[/OUT]</s>", "␛", "|", "␛|", "␛␛", "ok", "\n", "]", "[ROLE:", "<<SYS>>", "<|im_end|>", "é"]
    for _ in range(600):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool]x", "␛"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]
        text = chat.render(turns)
        read = chat.parse(text)
        assert [t[:2] for t in read] == turns
        assert not any(chat.CONTROL.search(text[a:b]) for _, _, a, b in read)
    assert chat.render([("user", "plain ␛ mark")]) == "<s>[INST]plain ␛ mark[/INST]</s>"
    with pytest.raises(chat.Malformed):
        chat.parse("<s>[INST]open")


def test_chat_frames(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 3, "user", "n"), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, None, "assistant", "first"), (-7, 0, "user", queries.CLASH), (-7, 1, "assistant", queries.CLASH)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].loss_chars == 1
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert got[3].turns_sha256 == sha("assistant\nfirst\nuser\nx\nuser\nx\n")
    assert got[-7].loss_sha256 == sha(queries.CLASH) and got[-7].turns_sha256 == sha(f"user\n{queries.CLASH}\nassistant\n{queries.CLASH}\n")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_rows_without_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "user", "c"), (None, 1, "assistant", "b"), (4, 1, "assistant", "d")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted((r.conv_id or 0, r.formatted) for r in chat.format_conversations(turns).collect())
    assert got == [(0, "<s>[INST]a[/INST]</s>"), (0, "<s>[OUT]b[/OUT]</s>"), (0, "<s>[OUT]b[/OUT]</s>"), (4, "<s>[INST]c[/INST]</s><s>[OUT]d[/OUT]</s>")]


# 7 -------------------------------------------------------------------------------------------------------------------
def plain_best_fit(sizes, capacities, opened, overhead):
    """Contents of bins by best fit, looking at every bin for every size."""
    bins = []  # capacity and contents
    for i, size in enumerate(sizes):
        fits = [b for b in bins if b[0] - sum(b[1]) >= size]
        if fits:
            least = min(b[0] - sum(b[1]) for b in fits)
            next(b for b in fits if b[0] - sum(b[1]) == least)[1].append(size)
        else:
            fit, rest = [c for c in capacities if c >= size], sum(sizes[i:])
            bins.append([min(fit, key=lambda c: ((c + overhead) / min(c, rest), c)) if opened is None else max(opened, fit[0]), [size]])
    return [b[1] for b in bins]


def plain_cost(bins, capacities, overhead):
    return sum(min(c for c in capacities if c >= sum(b)) + overhead for b in bins)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i, part in enumerate(rest):
            yield [*rest[:i], [items[0], *part], *rest[i + 1 :]]


def test_packing_plan():
    rng, capacities, worse = random.Random(7), (20, 50, 100), []
    for n in [*(rng.randint(0, 7) for _ in range(60)), *(rng.randint(8, 60) for _ in range(40))]:
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        bins, lengths = packing.pack_shard(sizes, capacities, 2)
        used = [sum(s for s, b in zip(sizes, bins, strict=True) if b == i) for i in range(len(lengths))]
        assert all(0 < u <= c and c == packing.least(capacities, u) for u, c in zip(used, lengths, strict=True))
        cost = sum(lengths) + 2 * len(lengths)
        assert cost == min(plain_cost(plain_best_fit(sizes, capacities, opened, 2), capacities, 2) for opened in (20, 50, 100, None))
        if 0 < n <= 7:  # against the least cost of all ways to pack
            best = min(plain_cost(p, capacities, 2) for p in partitions(sizes) if all(sum(b) <= 100 for b in p))
            assert cost >= best
            worse.append(cost / best)
    assert np.mean(worse) < 1.03 and max(worse) < 1.3


def test_packing(spark):
    docs = docs_of(spark, [(1, "a b c"), (2, None), (3, ""), (4, "x " * 45), (5, "y " * 20), (6, "z."), (6, "z."), (None, "q q")])
    got = packing.pack(docs, capacities=(8, 20), overhead=1, shard_docs=4).collect()
    pieces = sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == 4)
    assert pieces == [(0, 0, 20), (1, 20, 20), (2, 40, 5)] and sum(r.n_tokens for r in got) == 3 + 45 + 20 + 2 + 2 + 2
    assert all(r.bin is None for r in got if r.doc_id in (2, 3)) and sum(r.doc_id == 6 for r in got) == 2
    by_bin: dict = {}
    for r in got:
        if r.bin is not None:
            by_bin.setdefault((r.shard, r.bin), []).append(r)
    for rows in by_bin.values():
        spans = sorted((r.offset, r.offset + r.n_tokens) for r in rows)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= rows[0].capacity
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_deals_out_repeated_rows(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.pack(docs, shard_docs=200).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 2000 and len(got) > 5 and max(r["count"] for r in got) < 700


def test_sequences_hold_the_ids_of_documents(spark, model, reference):
    texts = [(1, "Hello world, " * 40), (2, None), (3, ""), (4, "One. Two!\nThree"), (4, "One. Two!\nThree"), (4, "other"), (None, "wide world " * 9)]
    encoded = bpe.encode_frame(docs_of(spark, texts).withColumn("ids", F.lit("clash")), model, public_tokenizers.PATTERN)
    got = packing.sequences(encoded, capacities=(16, 64), overhead=1, shard_docs=3).collect()
    back: dict = {}
    for r in got:
        assert len(r.ids) == sum(p.n_tokens for p in r.pieces) <= r.capacity and r.capacity in (16, 64)
        for p in r.pieces:
            back.setdefault(p.doc_id, []).append((p.piece, r.ids[p.offset : p.offset + p.n_tokens]))
    want: dict = {}
    for i, text in texts:
        ids = reference.encode_ordinary(text or "")
        for k in range(0, len(ids), 64):
            want.setdefault(i, []).append((k // 64, ids[k : k + 64]))
    assert {i: sorted(x) for i, x in back.items()} == {i: sorted(x) for i, x in want.items()}
    counts = bpe.token_counts(docs_of(spark, texts), bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY)), public_tokenizers.PATTERN)
    assert "text" not in counts.columns and sorted(r.n_tokens for r in counts.collect()) == sorted(len(reference.encode_ordinary(t or "")) for _, t in texts)
    assert packing.sequences(encoded.limit(0)).count() == 0


# 8, 10 ---------------------------------------------------------------------------------------------------------------
def test_counterfactuals_level_identity_terms(spark):
    """One group is named in most toxic sentences. At the default strength the terms of its set weigh the same, and neutral
    mentions of the group aren't called toxic, while the insult still is."""
    rng = random.Random(8)
    groups = toxicity.IDENTITY[1][:4]
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.4
        group = groups[0] if bad and rng.random() < 0.9 else rng.choice(groups)  # and one sentence in three names none
        words = [*([group] if i % 3 else []), *rng.choices([f"w{j}" for j in range(50)], k=8), *(["idiot"] if bad and rng.random() < 0.5 else [])]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, told = docs_of(spark, rows), spark.createDataFrame([*labels, (0, 7), (9999, 1), (None, 1)], "doc_id bigint, toxic int")
    known = toxicity.Features()
    of = lambda m, *words: m.score(toxicity.features_of(set(words), known))
    gap = lambda m: max(of(m, g) for g in groups) - min(of(m, g) for g in groups)
    plain, level = (toxicity.train(docs, told, strength=x) for x in (0.0, toxicity.COUNTERFACTUAL))
    assert gap(plain) > 0.2 and gap(level) < 0.15 * gap(plain)
    assert of(level, groups[0], "w1", "w2") < 0.5 < of(level, groups[0], "w1", "idiot")
    neutral = [(groups[0], *rng.choices([f"w{j}" for j in range(50)], k=8)) for _ in range(100)]
    wrong = lambda m: sum(of(m, *words) >= 0.5 for words in neutral)
    assert wrong(level) <= 2 < wrong(plain)


def test_swaps_reach_sentences_that_name_no_group():
    known = toxicity.Features()
    for pick in range(200):
        ((a, b),) = toxicity.changes_of(set(), np.zeros(0, np.int32), pick, known)
        assert len(a) and len(b) and a.tolist() != b.tolist()
    assert len(toxicity.changes_of({"muslim"}, np.zeros(0, np.int32), 0, known)) == len(toxicity.IDENTITY[1]) - 1


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [(r.predicted == r.toxic) for r in got]
    assert np.mean(right) > 0.95
    docs = docs_of(spark, [(1, None), (2, ""), (2, ""), (3, "x " * 200_000)])
    model = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {round(r.toxicity, 3) for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_automaton_counts_phrases():
    rng = random.Random(9)
    sample = {"x": "".join(rng.choices("ab ", k=300)), "y": "".join(rng.choices("bc ", k=300))}
    parser = langid.Parser(sample)
    texts = ["".join(rng.choices("abcd ", k=rng.randint(1, 60))) for _ in range(80)]

    def plain(text, told):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in told:
                size += 1
            n, at = n + 1, at + size
        return n

    got = parser.phrases(texts)
    names, scores = parser.predict(texts + ["\u00b2\u00bd\u2460 12", None])
    phrases = [[plain(langid.normalise(t), sample[k]) for k in "xy"] for t in texts]
    assert names == [("und" if not t.strip() else "xy"[p[1] < p[0]]) for t, p in zip(texts, phrases, strict=True)] + ["und", "und"]
    assert all(s == pytest.approx(max(p) / sum(p)) for s, p, k in zip(scores, phrases, names, strict=False) if k != "und")
    assert got.tolist() == [[plain(t, sample["x"]), plain(t, sample["y"])] for t in texts]


def test_letters_and_marks():
    assert langid.normalise("\u00b2\u00bd\u2460\u2167 ...") == langid.normalise("\u0301\u0302") == "" and langid.normalise("Don't \u0939\u093f\u0928\u094d\u0926\u0940 5x") == " don t \u0939\u093f\u0928\u094d\u0926\u0940 x "


def test_many_letters_take_little_room():
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    parser = langid.Parser({k: "".join(rng.choices(letters, k=20_000)) for k in "ab"})
    assert parser.next.keys.nbytes + parser.next.targets.nbytes < 8 << 20
    assert parser.predict(["".join(letters[:50])])[0][0] in "ab"


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    docs = docs_of(spark, [(1, None), (2, ""), (3, "12 ... 34"), (4, "the " * 60_000), (5, "les des les")])
    samples = langid.learn(spark.createDataFrame([(1, "the cat and the dog", "en", "s", 1), (2, "les chats des rues", "fr", "s", 1), (3, None, "fr", "s", 1), (4, "x", None, "s", 1)], DOCS))
    found = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("clash")), samples).collect()}
    assert [found[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "en", "fr"] and found[1].score == 0
    long = spark.createDataFrame([(i, ("le la " * 9 if i else "un des " * 9) + "les " * (5000 if i == 0 else 1), "fr", "s", 1) for i in range(4)] * 2, DOCS)
    assert "un" not in langid.learn(long, chars=100)["fr"] and langid.learn(long, rows=9, chars=10**6)["fr"].count("un") == 9
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0 and langid.learn(docs.limit(0).withColumn("lang", F.lit("x"))) == {}


# 9 -------------------------------------------------------------------------------------------------------------------
def plain_line_dedup(rows):
    lines = {}
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split()]
            if text and len(tokens) >= line_dedup.MIN_TOKENS:
                lines[doc, i] = tuple(tokens)
    leaves: dict = {}
    for tokens in set(lines.values()):
        leaves.setdefault((len(tokens), tokens[:3]), []).append(tokens)
    template = {}
    for members in leaves.values():
        docs = {d for (d, _), t in lines.items() if t in members}
        fixed = [next((t for t in {m[p] for m in members} if 2 * sum(m[p] == t for m in members) > len(members)), None) for p in range(len(members[0]))]
        for m in members:
            shares = len(members) > 1 and len(docs) > 1 and sum(a == b for a, b in zip(m, fixed, strict=True)) >= 0.6 * len(m)
            template[m] = ("leaf", len(m), m[:3]) if shares else m
    places: dict = {}
    for at, tokens in lines.items():
        places.setdefault(template[tokens], []).append(at)
    gone = {at for p in places.values() for at in p if at[0] != min(p)[0]}
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone) if text is not None else None for doc, text in rows}


def test_line_dedup(spark):
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    line = lambda: " ".join(rng.choices(words, k=rng.randint(1, 7)))
    rows = [(i, "\n".join([line() for _ in range(rng.randint(1, 6))] + ([f"user {rng.randrange(99)} logged in from host{i} today at noon"] if i % 2 else []) + (["read the full terms of use here"] * 2 if i % 3 == 0 else []))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a b c d\n" * 20_000), (103, "  tabs\tand   wide 12 spaces \n tabs and wide 12x spaces"), (104, "tabs and wide 7 spaces")]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs_of(spark, rows).withColumn("n_lines", F.lit("clash"))).collect()}
    want = plain_line_dedup(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r[c] == "mine" for r in got.values() for c in CLASHING)
    assert got[100].n_lines == 0 and got[102].n_dropped == 0 and sum("logged in" in (r.text or "") for r in got.values()) == 1 and got[104].n_dropped == 1
    assert line_dedup.drop_recurring_lines(docs_of(spark, rows).limit(0)).count() == 0


def left_lines(spark, texts):
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs_of(spark, list(enumerate(texts)))).collect()}
    return [got[i] for i in range(len(texts))]


def test_line_dedup_of_rows_that_repeat_a_doc_id(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v\na b c d e f"), (0, "a b c d e f"), (None, "a b c d e f"), (2, "x\na b c d e f"), (2, "x\na b c d e f")]
    got = line_dedup.drop_recurring_lines(docs_of(spark, rows)).collect()
    want = [(1, "", 1), (1, "q r s t u v", 1), (0, "a b c d e f", 0), (None, "a b c d e f", 0), (2, "x", 1), (2, "x", 1)]
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got), key=str) == sorted(want, key=str)


def test_line_dedup_of_many_dropped_lines(spark):
    lines = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of this long list" for i in range(15_000)]
    texts = ["\n".join(lines), "\n".join(["first", *lines[:7000], "", "middle", *lines[7000:], "last"])]
    assert left_lines(spark, texts) == [texts[0], "first\n\nmiddle\nlast"]


def test_line_dedup_keeps_lines_that_only_begin_alike(spark):
    texts = ["He is a doctor", "He is a teacher", "She went to the old house", "She went to the old castle", "They said that we should all go home", "They said that we must never come again", "1 2 3 40", "1 2 5 60", "12 34 56 78 total", "90 12 34 56 total"]
    assert left_lines(spark, texts) == texts
    texts = [f"Connection to server lost after restart by user {name}" for name in ("ann", "bob", "eve")]
    assert left_lines(spark, texts) == [texts[0], "", ""]


def test_line_dedup_finds_short_lines(spark):
    texts = [f"All rights  reserved.\n\nowner{i}\nPage {i}" + ("\nHe came." if i < 7 else "") for i in range(8)]
    assert left_lines(spark, texts) == texts[:1] + [t.split("\n", 1)[1] for t in texts[1:]]


def test_line_dedup_finds_several_templates_of_a_leaf(spark):
    names = "ann bob cid dan eve fay".split()
    forms = ["Connection to server lost after restart by user {}", "Connection to server opened again from host of {}", "Connection to server {} refused since licenses ran out"]
    texts = [form.format(name) for name in names for form in forms] + ["Connection to server works very well today my friend"]
    assert left_lines(spark, texts) == [t if i < 3 or i == len(texts) - 1 else "" for i, t in enumerate(texts)]


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize(("small", "batch"), [(64, 50), (4, 7), (1000, 1000)])
def test_links_of_sorted_groups_against_brute_force(monkeypatch, blocks, small, batch):
    """One key is shared by a third of the records; groups end within batches and go on in later ones."""
    random = np.random.default_rng(1)
    n = 200
    x = random.standard_normal((n, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    keys = random.integers(0, 40, (n, 6))
    keys[: n // 3, 0] = 7
    ids, many = random.permutation(n) * 10 + 1, random.integers(1, 4, n)
    want = {}
    for i in range(n):
        total = sum(int(many[j]) for j in range(n) if j != i and set(keys[i]) & set(keys[j]) and x[i] @ x[j] >= 0.5)
        if total:
            want[int(ids[i])] = total
    rows = []
    for i in range(n):
        own = int(ids[i]) % blocks
        for k in set(keys[i].tolist()):
            rows += [(k, min(own, o), max(own, o), int(ids[i]), own, int(many[i]), sorted(set(keys[i].tolist())), x[i].tobytes()) for o in range(blocks)]
    names = ["key", "first", "second", "id", "block", "many", "keys", "payload"]
    table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: r[:3])])

    def prepare(payloads):
        v = np.stack([np.frombuffer(p) for p in payloads])
        return lambda i, near: v[near] @ v[i] >= 0.5

    monkeypatch.setattr(links, "SMALL", small)
    got = {}
    for part in links.chunks(table.to_batches(max_chunksize=batch)):
        for r in links.compare(part, prepare).to_pylist():
            got[r["id"]] = got.get(r["id"], 0) + r["links"]
    assert got == want
