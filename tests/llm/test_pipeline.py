"""The pipeline's stages against brute force, and on hard rows."""

from __future__ import annotations

import collections

import corpus_pipeline as pipeline
from hindcast.llm import decontam, quality

from brute import roots, shingles, words

DIRECTORY = "/root/testdata/sf0.01"


def kept_by_similarity(docs):
    """Documents that are the first of their group of five-word similarity 0.8."""
    sets = [frozenset(shingles(d.text, 5)) for d in docs]
    order = sorted(range(len(docs)), key=lambda k: (docs[k].doc_id is not None, docs[k].doc_id or 0))
    by_shingle = collections.defaultdict(list)
    for k, own in enumerate(sets):
        for shingle in own:
            by_shingle[shingle].append(k)
    common = collections.Counter()
    for rows in by_shingle.values():
        common.update((a, b) for i, a in enumerate(rows) for b in rows[:i])
    pairs = [
        (a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8
    ]
    group = roots(len(docs), pairs)
    first = {}
    for k in order:
        first.setdefault(group[k] if sets[k] else -k - 1, k)
    return sorted(docs[k].doc_id for k in first.values())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    good = pipeline.quality_rules(spark, docs, DIRECTORY)
    rows = good.collect()
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in rows) == sorted(
        r.doc_id for r in quality.judged(docs).where("kept").select("doc_id").collect()
    )
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, good, DIRECTORY).collect()) == kept_by_similarity(rows)
    clean = pipeline.decontamination(spark, good, DIRECTORY)
    items = spark.read.parquet(f"{DIRECTORY}/benchmark.parquet")
    leaked = {r.doc_id for r in decontam.leaks(good, items).collect()}
    assert leaked and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in rows if r.doc_id not in leaked)
    mixed = pipeline.source_mixing(spark, clean, DIRECTORY)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= clean.count()


def test_run_gives_gapless_shards(spark):
    result = pipeline.run(spark, DIRECTORY)
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    rows = result.collect()
    slots = collections.defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert len({r.doc_id for r in rows}) == len(rows)


def test_hard_rows_pass_every_stage(spark, hard, no_rows):
    for name, stage in pipeline.STAGES:
        for docs in (hard, no_rows):
            out = stage(spark, docs, DIRECTORY)
            expected = docs.columns if name != "sharding" else [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
            assert out.columns == expected, name
            n = out.count()
            assert n <= docs.count()
            if docs is hard and name in ("benchmark decontamination", "sharding"):
                assert n == docs.count()
            # Columns of the names that the stages use inside come through as they were.
            assert {(r.k, r.row[0], r.h, r.group) for r in out.select("k", "row", "h", "group").collect()} <= {(2, 1, 1, "g")}


def test_near_duplicates_of_hard_rows(spark, hard):
    kept = pipeline.near_duplicates(spark, hard, DIRECTORY).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    # Three texts of the same three words, two long ones of nearly the same, three equal rows.
    assert 6 in ids and 7 not in ids and 8 not in ids
    assert 14 in ids and 15 not in ids
    assert ids.count(3) == 1 and all(i in ids for i in (0, 1, 2))
    assert all(words(r.text) or r.doc_id in (0, 1, 2, 3) for r in kept)
