"""WARC, tokens, sharding, language, SimHash and toxicity against brute force or held-out rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hindcast.llm import common, langid, queries, sharding, simhash, tokens, toxicity, warc

from brute import HARD_TEXTS, close_pairs, fingerprint, roots

DIRECTORY = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{DIRECTORY}/documents.parquet")


# ---- WARC ----


def expected_records(pages):
    by_digest = collections.defaultdict(list)
    for page_id, html in pages:
        by_digest[base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()].append((page_id, html))
    for digest, group in by_digest.items():
        ids = [p for p, _ in group if p is not None]
        top = max(ids, default=None)
        for page_id, html in group:
            revisit = top is not None and page_id != top
            yield (page_id, len((html or "").encode()), digest, "revisit" if revisit else "response", top if revisit else None)


def round_trip(pages):
    folder = warc.archive_folder(pages.sparkSession)
    frame = warc.read_archives(warc.write_archives(pages, folder), folder)
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()]


def test_warc_of_every_page(spark):
    pages = spark.read.parquet(f"{DIRECTORY}/pages.parquet").select("page_id", "html").collect()
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
            for r in queries.op2_warc(spark, DIRECTORY).collect()]
    assert sorted(rows, key=repr) == sorted(expected_records([tuple(p) for p in pages]), key=repr)


def test_warc_of_hard_pages(spark):
    texts = [*HARD_TEXTS, "again", "again", "again", "ends with \r\n\r\n", "\r\n\r\nHTTP/1.1 404\r\n\r\n"]
    pages = [(i, text) for i, text in enumerate(texts)] + [(None, "again"), (None, "alone"), (5, "b"), (5, "b")]
    frame = spark.createDataFrame(
        [(p, "http://x/\r\nA: b" if p else None, h, "extra") for p, h in pages],
        "page_id long, url string, html string, digest string",
    )
    assert sorted(round_trip(frame), key=repr) == sorted(expected_records(pages), key=repr)
    assert round_trip(frame.limit(0)) == []


def test_warc_reader_finds_damage():
    digest = warc.base32_sha1(hashlib.sha1(b"payload").digest())
    first = warc.record(1, "u", b"payload", digest, None)
    second = warc.record(2, "u", b"payload", digest, 1)
    heads = list(warc.read_records(io.BytesIO(first + second)))
    assert [(h.page("warc-record-id"), h.page("warc-refers-to")) for h in heads] == [(1, None), (2, 1)]
    plain = zlib.decompress(first, 31)
    damaged = [
        (first + second)[:-9], plain.replace(b"payload", b"payloae"), plain[:-2],
        plain.replace(b"Content-Length: 7", b"Content-Length: 8"), plain + b"more", b"not gzip at all",
    ]
    for data in damaged:
        if data.startswith(b"WARC"):
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress(data) + packer.flush()
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(data)))


# ---- Tokens ----

MODEL = public_tokenizers.path(tokens.MODEL)
COUNTER = tokens.PrefixCounter(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abething .,\n\té€日▁\U0001f600\u0301<s>0123AQ  ")), max_size=60) | st.text(max_size=30))
def test_every_prefix_has_its_exact_count(text):
    expected = [len(LIBRARY.encode(text[:i])) for i in range(len(text) + 1)]
    assert COUNTER.prefixes(text).tolist() == expected
    assert COUNTER.total(text) == expected[-1]


def test_tokens_of_every_document_and_hard_ones(spark, hard, no_rows):
    texts = dict(documents(spark).select("doc_id", "text").collect())
    for row in queries.op3_tokens(spark, DIRECTORY).collect():
        own = texts[row.doc_id] or ""
        n = len(LIBRARY.encode(own))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(own.encode()), n, n > 4096)
    for row in tokens.counted(hard).collect():
        assert row.n_tokens == len(LIBRARY.encode(row.text or ""))
    assert tokens.counted(no_rows).count() == 0


def test_truncation_takes_the_longest_prefix(spark, hard):
    for row in tokens.truncated(hard.where("length(text) < 1000"), 5).collect():
        fitting = [i for i in range(len(row.text) + 1) if len(LIBRARY.encode(row.text[:i])) <= 5]
        assert row.truncated == row.text[: max(fitting)]


# ---- Sharding ----


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4097])
def test_the_permutation_is_one_and_can_be_inverted(n):
    numbers = np.arange(n)
    image = sharding.permuted(numbers, n)
    assert sorted(image) == list(range(n))
    assert (sharding.permuted(image, n, inverse=True) == numbers).all()


def test_permutation_follows_the_definition():
    n, half = 1000, sharding.half_bits(1000)
    mask = (1 << half) - 1

    def once(x):
        left, right = x >> half, x & mask
        for key in sharding.round_keys(sharding.SEED):
            v = (right + key) % 2**32 * 2654435761 % 2**32
            v = (v ^ v >> 15) * 2246822519 % 2**32
            left, right = right, left ^ ((v ^ v >> 13) & mask)
        return left << half | right

    for x in range(n):
        y = once(x)
        while y >= n:
            y = once(y)
        assert y == sharding.permuted(np.array([x]), n)[0]


def test_shards_of_every_document(spark):
    texts = dict(documents(spark).select("doc_id", "text").collect())
    rows = queries.op4_sharding(spark, DIRECTORY).collect()
    assert len(rows) == len(texts)
    slots = collections.defaultdict(list)
    for row in rows:
        own = (texts[row.doc_id] or "").encode()
        assert (row.size, row.text_crc32, row.law, row.grown_shard) == (len(own) + 16, zlib.crc32(own), "rows", None)
        slots[row.shard].append(row.slot)
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_shards_don_t_depend_on_partitions(spark, hard, no_rows):
    def placed(docs):
        rows = sharding.sharded(sharding.sized(docs.select("doc_id", "text", "shard")), ties=["doc_id", "text_crc32", "size"], shards=4)
        return sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rows.collect())

    once = placed(hard)
    assert len(once) == len(HARD_TEXTS) + 3 and once == placed(hard.repartition(7)) == placed(hard.coalesce(1))
    assert placed(no_rows) == []


def test_numbers_span_buckets(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then null else 's' end as g")
    rows = common.numbered(docs, "n", F.col("doc_id"), ["doc_id"], F.col("g")).collect()
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row.g].append((row.n, hashlib.md5(str(row.doc_id).encode()).hexdigest()))
    for own in groups.values():
        own.sort()
        assert [n for n, _ in own] == list(range(len(own)))
        assert [d for _, d in own] == sorted(d for _, d in own)


# ---- Languages ----


def test_language_of_held_out_documents(spark):
    rows = queries.op5_langid(spark, DIRECTORY).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_out_of_place_distance():
    rows = [("a", g, i) for i, g in enumerate(["x", " x", "y"])] + [("b", g, i) for i, g in enumerate(["y", "x"])]
    profiles = langid.Profiles(rows)
    assert [langid.spelled(g) for g in langid.ranked("x")] == [" x", " x ", "x", "x "]
    # a: " x" 1 - 0, "x" 0 - 2, two unknown; b: "x" 1 - 2, three unknown.
    assert profiles.nearest("x") == ("a", pytest.approx(1 - (1 + 2 + 2 * langid.PROFILE) / (4 * langid.PROFILE)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbÉß1 .\n語\u0301\U0001d4d0")), max_size=40))
def test_ranked_n_grams_follow_the_definition(text):
    counts = collections.Counter()
    for word in regex.findall(r"\p{L}+", text.lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    del counts[" "]
    expected = sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]
    assert [langid.spelled(g) for g in langid.ranked(text)] == expected
    assert all(langid.spelled(langid.numbered(g)) == g for g in expected)


def test_language_of_hard_texts(spark, hard, no_rows):
    profiles = langid.learned(documents(spark))
    rows = langid.predicted(hard, profiles).collect()
    assert len(rows) == len(HARD_TEXTS) + 3
    for row in rows:
        lettered = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred != "und") == lettered and 0 <= row.score <= 1
    nothing = langid.learned(no_rows)
    assert {r.lang_pred for r in langid.predicted(hard, nothing).collect()} == {"und"}
    assert langid.predicted(no_rows, profiles).count() == 0


# ---- SimHash ----


def test_fingerprints_and_groups_of_every_document(spark):
    docs = documents(spark).select("doc_id", "text").orderBy("doc_id").collect()
    own = [fingerprint(d.text) for d in docs]
    low = roots(len(docs), close_pairs(own, 2))
    rows = {r.doc_id: r for r in queries.op9_simhash(spark, DIRECTORY).collect()}
    assert len(rows) == len(docs)
    for k, doc in enumerate(docs):
        assert rows[doc.doc_id].fingerprint == f"{own[k]:016x}"
        assert rows[doc.doc_id].component_id == docs[low[k]].doc_id


def test_groups_of_hard_documents(spark, hard, no_rows):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == len(HARD_TEXTS) + 3
    zero = {r.doc_id: r.component_id for r in rows if r.fp == 0}
    assert zero == {0: 0, 1: 0, 2: 0, 3: 0}
    same = {r.component_id for r in rows if r.doc_id in (6, 7, 8)}
    assert same == {6}
    assert simhash.near_duplicates(no_rows).count() == 0


@pytest.mark.parametrize("shard_rows", [40, 300, 100_000])
def test_tree_shards_lose_no_link(spark, shard_rows):
    random.seed(5)
    near = [0]
    for _ in range(400):  # a dense ball that no vantage point splits
        near.append(random.choice(near) ^ 1 << random.randrange(12))
    far = [random.getrandbits(64) for _ in range(1500)]
    chain = [far[0]]
    for k in range(60):
        chain.append(chain[-1] ^ 1 << (k % 64) ^ 1 << ((k * 7 + 3) % 64))
    values = sorted({*near, *far, *chain, *(x ^ 1 for x in far[::3]), 2**64 - 1})
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.component for r in simhash.groups_within(frame, 2, shard_rows).collect()}
    low = roots(len(values), close_pairs(values, 2))
    smallest = {}
    for k, root in enumerate(low):
        smallest[root] = min(smallest.get(root, 2**63), signed[k])
    for k, root in enumerate(low):
        assert found.get(signed[k], signed[k]) == smallest[root]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- Toxicity ----


def test_toxicity_of_held_out_documents(spark):
    labels = dict(spark.read.parquet(f"{DIRECTORY}/labels.parquet").select("doc_id", "toxic").collect())
    rows = queries.op10_toxicity(spark, DIRECTORY).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert sum(pairs) / len(pairs) > 0.9


def test_toxicity_learns_from_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNED_ROWS", 50)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    many = spark.range(2000).selectExpr("1 + id % 2 as doc_id", "if(id < 1000, 'same words', concat('words ', id)) as text")
    assert 50 <= toxicity.sampled(many, labels).count() <= 150
    few = many.where("text = 'same words' or text like '%99'")
    rows = toxicity.sampled(few, labels).collect()
    assert len(rows) == len(set(rows)) == 12
    score = [r.score for r in toxicity.scored(many, toxicity.fitted(many, labels)).collect()]
    assert len(score) == 2000 and all(0 <= x <= 1 for x in score)


def test_toxicity_without_labels_and_of_hard_texts(spark, hard, no_rows):
    labels = spark.createDataFrame([(6, 1), (9, 0), (9, 0), (99, 1), (None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    for learned in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.fitted(hard, learned)
        rows = toxicity.scored(hard, model).collect()
        assert len(rows) == len(HARD_TEXTS) + 3 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(no_rows, toxicity.fitted(no_rows, labels)).count() == 0


def test_features_of_long_texts_are_those_of_their_parts(monkeypatch):
    text = HARD_TEXTS[14][:5000]
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "CHUNK", 97)
    assert (toxicity.features(text) == whole).all()


def plain_buckets(text: str | None) -> set[int]:
    """Buckets of a text's n-grams, one by one."""
    codes = [ord(c) for c in f" {re.sub(r'\s+', ' ', (text or '').lower()).strip()} "]
    factor, whole = int(toxicity._FACTOR), 2**64 - 1
    mixed = [(c + 1) * factor & whole for c in codes]
    mixed = [m ^ m >> 29 for m in mixed]
    found = set()
    for n in toxicity.SIZES:
        for at in range(len(codes) - n + 1):
            value = n
            for m in mixed[at : at + n]:
                value = (value ^ m) * factor & whole
                value ^= value >> 32
            found.add(value % toxicity.BUCKETS)
    return found


@pytest.mark.parametrize("chunk", [7, 97, 32_768])
def test_kept_features_of_texts_hashed_together(monkeypatch, chunk):
    """No text gets n-grams of the next one, nor loses those at a border of two chunks."""
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    texts = ["one text", None, "", "a", "another\u3000 text\x1c", "ends with on", "e text", "longer " * 40, "one text"]
    each = [plain_buckets(text) for text in texts]
    buckets = np.array(sorted(set().union(*each))[::2])
    table = toxicity.Model(buckets, np.zeros(len(buckets)), 0.0).lookup()
    assert table.nbytes == 2 * toxicity.BUCKETS
    for text, own, found in zip(texts, each, toxicity.kept_features(texts, table), strict=True):
        assert set(toxicity.features(text).tolist()) == own
        assert buckets[found].tolist() == sorted(own & set(buckets.tolist()))


@pytest.mark.parametrize("tests, bits", [(0, 24), (3, 24), (12, 64)])
def test_similar_sets_meet_whatever_the_tests(monkeypatch, tests, bits):
    """Every link of two blocks is found, by single tests or by comparing with all rows at once."""
    monkeypatch.setattr(simhash, "TESTS", tests)
    monkeypatch.setattr(simhash, "SIMILAR_BITS", bits)
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(12):
        base = rng.choice(2**32, 120, replace=False).astype(np.uint32)
        for n in rng.integers(0, 30, 9):
            sets.append(np.unique(np.concatenate([base[n:], rng.choice(2**32, n).astype(np.uint32)])))
    fps = np.array([simhash.fingerprint_of(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in sets]).view(np.uint64)
    order = rng.permutation(len(sets))
    fps, sets = fps[order], [sets[k] for k in order]
    rows = np.arange(len(sets))
    pairs = [(a, b) for a in rows for b in rows[:a] if simhash._jaccard(sets[a], sets[b]) >= 0.8]
    groups = simhash.Groups(len(sets))
    for left, right in ((rows[:50], rows[50:]), (rows[:50],) * 2, (rows[50:],) * 2):
        simhash.link_similar(fps, sets, 0.8, groups, left, right)
    assert groups.root.tolist() == roots(len(sets), pairs)
