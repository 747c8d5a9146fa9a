"""Nothing is left out: exhausted sources, repeated phrases, benchmark items of any form."""

from __future__ import annotations

import collections
import random

import corpus_pipeline as pipeline
from hindcast.llm import decontam, simhash

from brute import roots, shingles


def test_mixing_stage_keeps_every_row_in_the_order_of_the_weights(spark):
    sizes = {**{f"s{k}": 800 for k in range(5)}, "big": 4_000, "tiny": 1, None: 1}
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = pipeline.source_mixing(spark, docs, "").collect()
    assert sorted(r.doc_id for r in mixed) == list(range(len(rows)))
    weight = {s: n**0.75 for s, n in sizes.items()}
    taken = collections.Counter()
    for k, row in enumerate(mixed[:6_000]):
        taken[row.source] += 1
        if k % 500 == 499:
            going = {s: w for s, w in weight.items() if sizes[s] > 1}
            for s, w in going.items():
                assert abs(taken[s] - w / sum(going.values()) * k) < 4 * len(sizes) + 0.01 * k


def test_similar_texts_are_found_whatever_phrase_they_repeat(spark):
    random.seed(11)
    texts = []
    for k in range(12):
        common = " ".join(f"w{random.randrange(10**6)}" for _ in range(1_000))
        for own in range(2):
            phrase = " ".join(f"p{random.randrange(10**6)}" for _ in range(5))
            texts.append(f"{common} " + f"{phrase} " * (40 if k % 2 or own else 1))
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = {r.k: r.group for r in simhash.similar_groups(frame, "k").collect()}
    sets = [set(shingles(t, 5)) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) == 12
    assert [found.get(k, k) for k in range(len(texts))] == roots(len(texts), pairs)


def test_close_fingerprints_are_compared_without_a_common_sketch_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SKETCH_KEYS", 0)
    random.seed(12)
    texts = []
    for _ in range(6):
        common = [f"w{random.randrange(10**6)}" for _ in range(20_000)]
        texts += [" ".join(common), " ".join([*common, "end"]), " ".join(common[:1_000])]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = {r.k: r.group for r in simhash.similar_groups(frame, "k").collect()}
    fps = [simhash.fingerprint_of(simhash.np.unique(simhash.shingle_hashes(t, 5))) for t in texts]
    near = [k for k in range(0, 18, 3) if ((fps[k] ^ fps[k + 1]) & (2**64 - 1)).bit_count() <= simhash.RADIUS]
    assert near and found == {k + own: k for k in near for own in (0, 1)}


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}


NOISE = "some other words that stand before it and say nothing at all, "
TRAIN = "A train leaves Boston at 40 km per hour and reaches Denver after 7 hours of travel on the old line"


def test_items_of_mostly_slots_are_found_as_they_are(spark):
    items = [
        "What is 12 + 45 - 7 * 3 / 9 + 16",
        "The Old Man And The Sea Was Written By Ernest Hemingway In Cuba",
        "Compute 12 45 7 3 9 16 8 4 11 2 then write the sum of them down",
    ]
    texts = [NOISE + x + ", and so on" for x in items]
    texts += [NOISE + "What is 1 + 4 - 8 * 2 / 5 + 6", NOISE + items[2].replace("16", "17").replace("11", "31")]
    assert leaks(spark, texts, items) == {(0, 0), (1, 1), (2, 2), (4, 2)}


def test_verbatim_items_are_found_in_any_case_and_layout(spark):
    items = [TRAIN, "What is the capital of Peru"]
    texts = [NOISE + form(x) + " and so on" for x in items for form in (str.lower, str.upper, lambda x: x.replace(" ", "\n"))]
    texts += ["They asked What is the capital of Peru then"]
    assert leaks(spark, texts, items) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)}


def test_one_changed_slot_does_not_hide_a_copy(spark):
    items = ["Alice gave Bob 12 apples and later Bob gave Carol 12 apples from the same old wooden crate"]
    changed = items[0].replace("Carol 12", "Carol 8")
    mixed = changed.replace("gave Bob 12", "gave Dan 9").replace("later Bob", "later Tom")
    assert leaks(spark, [NOISE + changed, NOISE + mixed], items) == {(0, 0)}
