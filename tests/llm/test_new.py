"""Periodic runs, Merkle manifest and reply trees against brute force, on whole tables and hard input."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from hindcast.llm import chat, common, merkle, queries, runs, sharding

from brute import UPPER, words

DIRECTORY = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode())


# ---- periodic runs ----


def every_run(own, least=12):
    """All (start, length, period): compare the words with themselves shifted by every period."""
    known = {}
    codes = np.array([known.setdefault(w, len(known)) for w in own], dtype=np.int64)
    found = {}
    for q in range(1, len(own) // 2 + 1):
        change = np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]]))
        for i, j in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
            if j - i + q >= max(least, 2 * q):
                found.setdefault((int(i), int(j - i + q)), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(own, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(own) if i not in gone)


def test_runs_of_random_words():
    random.seed(7)
    for _ in range(600):
        documents = []
        for _ in range(random.randint(1, 4)):
            n = random.choice([0, 1, 5, 20, 60])
            parts = [[random.choice("ab") for _ in range(random.randint(1, 9))] for _ in range(2)]
            own = []
            while len(own) < n:
                own += random.choice([*parts, parts[0], [random.choice("abc")]])
            documents.append(own[:n])
        least = random.choice([2, 5, 12])
        counts, found, texts = runs.judged_block([" ".join(d).encode() for d in documents], least)
        expected = [every_run(d, least) for d in documents]
        assert counts == [len(e) for e in expected]
        assert [tuple(r) for r in found.T.tolist()] == [r for e in expected for r in e]
        assert texts == [collapsed(d, e).encode() for d, e in zip(documents, expected)]


def test_runs_of_fibonacci_and_unary_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    for own in (b, ["x"] * 3_000, ["abababa"[k % 7] for k in range(500)]):
        counts, found, _ = runs.judged_block([" ".join(own).encode()], 12)
        assert [tuple(r) for r in found.T.tolist()] == every_run(own) and counts == [len(every_run(own))]


def test_runs_of_every_document(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for doc_id, text in docs:
        own, h = words(text), crc(doc_id)
        n, g = len(own), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)]
        found = every_run(own)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        expected[doc_id] = (
            len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(collapsed(own, found)),
        )
    assert {r[0]: tuple(r)[1:] for r in queries.op11_runs(spark, DIRECTORY).collect()} == expected
    assert sum(e[0] > 0 for e in expected.values()) > 100


def test_runs_of_hard_texts(spark, hard, no_rows, monkeypatch):
    clashing = hard.selectExpr("*", "'r' as runs", "'i' as input", "'b' as body")
    rows = runs.periodic_runs(clashing).collect()
    assert len(rows) == hard.count() and set(rows[0].asDict()) == {*hard.columns, "runs", "collapsed", "input", "body"}
    for r in rows:
        own = words(r.text)
        found = [] if len(own) > 50_000 else every_run(own)
        if len(own) <= 50_000:
            assert [tuple(x) for x in r.runs] == found
            assert r.collapsed == collapsed(own, found)
    assert {len(r.runs) for r in rows if r.text is None or len(words(r.text)) < 12} == {0}
    assert runs.periodic_runs(no_rows).count() == 0
    assert [r.doc_id for r in rows if r.text == "\n\n\t" and r.doc_id == 3] == [3] * 3


def test_a_very_long_period_is_found():
    unit = [f"w{k}" for k in range(30_000)]
    counts, found, texts = runs.judged_block([" ".join(["x", *unit, *unit, *unit[:7], "y"]).encode(), None], 12)
    assert counts == [1, 0] and found.T.tolist() == [[1, 60_007, 30_000]]
    assert texts[0] == " ".join(["x", *unit, "y"]).encode()


# ---- Merkle manifest ----


def levels_of(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return levels


def folded_path(levels, place, own, arity):
    beside = ""
    for level in levels[:-1]:
        block, slot = level[place // arity * arity :][:arity], place % arity
        beside += "".join(block[:slot] + block[slot + 1 :])
        own = sha("".join(block[:slot] + [own] + block[slot + 1 :]))
        place //= arity
    return beside, own


def expected_manifest(docs, arity=8):
    def leaf(r, text):
        values = (r.doc_id, r.source, r.lang, r.n_chars, text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = collections.defaultdict(list)
    for r in docs:
        groups[r.lang].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {g: levels_of([leaf(r, r.text) for r in groups[g]], arity) for g in order}
    top = levels_of([trees[g][-1][0] for g in order], arity)
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            tampered = r.text.translate(UPPER) if r.text is not None and crc(r.doc_id) % 3 == 0 else r.text
            lower, own = folded_path(trees[g], i, leaf(r, tampered), arity)
            upper, own = folded_path(top, k, own, arity)
            root = top[-1][0]
            yield (r.doc_id, trees[g][0][i], trees[g][-1][0], root, sha(lower + upper), own, own == root)


def test_merkle_of_every_document(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()
    rows = sorted(tuple(r) for r in queries.op12_merkle(spark, DIRECTORY).collect())
    assert rows == sorted(expected_manifest(docs))
    assert {r[-1] for r in rows} == {True, False}


@pytest.mark.parametrize("arity, range_rows", [(2, 20_000), (3, 7), (8, 3)])
def test_merkle_of_hard_rows(spark, hard, arity, range_rows, monkeypatch):
    monkeypatch.setattr(merkle.positions, "__defaults__", (range_rows,))
    docs = hard.selectExpr("doc_id", "source", "if(doc_id % 4 = 1, null, source) as lang", "n_chars", "text",
                           "'t' as tree", "1 as idx", "2 as n", "'d' as digest", "'u' as subroot", "3 as `row`", "0 as `by`")
    leaves = docs.withColumn("leaf", merkle.leaf_of("doc_id", "source", "lang", "n_chars", "text"))
    proven = merkle.manifest(leaves, "lang", "doc_id", arity=arity)
    rows = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("p"),
                         merkle.folded("leaf", "proof").alias("f"), "tree", "idx", "n", "digest", "row", "by").collect()
    expected = [e[:5] for e in expected_manifest(docs.collect(), arity)]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    assert all(r.f == r.root and (r.tree, r.idx, r.n, r.digest, r.row, r.by) == ("t", 1, 2, "d", 3, 0) for r in rows)


def test_merkle_of_no_rows_and_of_one(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.manifest(none, "lang", "doc_id").count() == 0
    one = spark.createDataFrame([(5, None, sha("x"))], none.schema)
    row = merkle.manifest(one, "lang", "doc_id").first()
    assert (row.subroot, row.root, row.proof) == (sha("x"), sha("x"), [])


# ---- reply trees ----


def test_chat_of_every_conversation(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = collections.defaultdict(list, {-1: [(0, "user", said), (1, "assistant", said)]})
    for r in spark.read.parquet(f"{DIRECTORY}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows = {r[0]: tuple(r)[1:5] for r in queries.op13_chat(spark, DIRECTORY).collect()}
    expected = {}
    for conv, own in turns.items():
        own.sort()
        learned = "".join(text for _, role, text in own if role == "assistant")
        expected[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(learned), sha(learned))
    assert rows == expected


TREE = "tree long, node long, parent long, role string, text string, score double"
HARD_TURNS = [
    (None, 0, None, "user", "no tree", None), (None, 1, 0, "assistant", None, None),
    (1, 7, None, None, "\\", 0.5), (1, 8, 7, "a\nb\\", "x\\\n<|im_end|>\n<|im_start|>user\n", 0.5),
    (1, 8, 7, "assistant", "<\\|im_end|> \U0001f600<", 0.5), (1, 8, 7, "assistant", "<\\|im_end|> \U0001f600<", 0.5),
    (2, None, None, "assistant", "", None), (3, 1, 99, "assistant", "orphan", 1.0), (3, 2, 1, "user", "|im_end|>", 1.0),
    (4, 1, 2, "user", "cycle", 1.0), (4, 2, 1, "user", "cycle", 1.0), (4, 3, 2, "user", "below it", 1.0), (5, 1, 1, "user", "itself", 1.0),
    (6, 1, None, "assistant", "x" * 200_000, None),
]


@pytest.mark.parametrize("large", [0, 100_000])
def test_chat_of_hard_turns(spark, large, monkeypatch):
    monkeypatch.setattr(chat, "LARGE_TREE", large)
    messages = spark.createDataFrame(HARD_TURNS, TREE).selectExpr("*", "'x' as rank", "'y' as leaf", "1 as i", "'z' as head")
    rows = {r.tree: r for r in chat.read_back(chat.formatted(messages)).collect()}
    assert set(rows) == {None, 1, 2, 3, 6}
    for tree, r in rows.items():
        own = sorted((n or 0, role or "", text or "") for t, n, _, role, text, _ in HARD_TURNS if t == tree)
        assert list(zip(r.roles, r.texts)) == [(role, text) for _, role, text in own]
        assert r.learned == [text for _, role, text in own if role == "assistant"]
    assert chat.formatted(messages.limit(0)).count() == 0


def branches(nodes):
    """{tree: [(mean, length, leaf, path)] best first} by walking every path."""
    children, roots_, known = collections.defaultdict(list), [], {(t, n) for t, n, *_ in nodes}
    score = {(t, n): s for t, n, _, s in nodes}
    for t, n, p, _ in nodes:
        (children[t, p] if (t, p) in known else roots_).append((t, n))
    found = collections.defaultdict(list)
    stack = [(root, [root]) for root in roots_]
    while stack:
        at, path = stack.pop()
        for child in children[at]:
            stack.append((child, [*path, child]))
        if not children[at]:
            mean = sum(score[x] for x in path) / len(path)
            found[at[0]].append((-mean, -len(path), at[1], [n for _, n in path]))
    return {t: sorted(own) for t, own in found.items()}


@pytest.mark.parametrize("keep, large", [(1, 100_000), (3, 100_000), (2, 5)])
def test_branches_are_ranked_by_score(spark, keep, large, monkeypatch):
    monkeypatch.setattr(chat, "LARGE_TREE", large)
    random.seed(3)
    nodes = []
    for tree in range(40):
        size = random.choice([1, 2, 3, 9, 40])
        names = random.sample(range(1_000), size)
        for k, name in enumerate(names):
            parent = None if k == 0 else names[k - 1] if tree % 4 == 0 else random.choice(names[max(0, k - 4) : k])
            nodes.append((tree, name, parent, random.randrange(64) / 64))
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    rows = collections.defaultdict(dict)
    for r in chat.ranked_paths(frame, keep).collect():
        rows[r.tree, r.rank].setdefault(r.leaf, {})[r.position] = r.node
    expected = {}
    for tree, own in branches(nodes).items():
        for rank, (_, _, leaf, path) in enumerate(own[:keep], 1):
            expected[tree, rank] = {leaf: dict(enumerate(path))}
    assert rows == expected
    messages = frame.selectExpr("*", "if(node % 2 = 0, 'user', 'assistant') as role", "concat('t', node) as text")
    read = {(r.tree, r.rank): r.texts for r in chat.read_back(chat.formatted(messages, keep=keep)).collect()}
    assert read == {k: [f"t{n}" for n in next(iter(v.values())).values()] for k, v in expected.items()}


def test_a_deep_tree_takes_few_joins(spark):
    n = 3_000
    frame = spark.range(n).selectExpr("1L as tree", "id as node", "if(id = 0, null, id - 1) as parent", "1.0 as score")
    nodes, ancestors = chat._rooted(frame)
    assert len(ancestors) == 12 and nodes.count() == n
    assert nodes.agg({"length": "max"}).first()[0] == n


# ---- rows in the order they are stored in ----


def test_stored_order_is_dense_and_that_of_a_sorted_table(spark, hard, no_rows, tmp_path):
    rows = spark.range(5_000).selectExpr("id", "hash(id) as h", "'x' as _file0").repartition(7)
    rows.orderBy("h").write.parquet(str(tmp_path / "sorted"))
    stored = spark.read.parquet(str(tmp_path / "sorted"))
    numbered = sorted((r.n, r.row.h) for r in common.in_stored_order(stored).collect())
    assert [n for n, _ in numbered] == list(range(5_000))
    assert [h for _, h in numbered] == sorted(h for _, h in numbered)
    # What is no scan of files is stored first.
    placed = common.in_stored_order(hard).collect()
    assert sorted(map(repr, (r.row for r in placed))) == sorted(map(repr, hard.collect()))
    assert sorted(r.n for r in placed) == list(range(hard.count()))
    assert common.in_stored_order(no_rows).count() == 0


@pytest.mark.parametrize("n, window", [(0, 80), (1, 80), (79, 80), (1_000, 80), (5_000, 2_560)])
def test_permutation_in_windows(n, window):
    out = sharding.permuted_in_windows(np.arange(n), n, window)
    for start in range(0, n, window):
        part = out[start : start + window]
        assert sorted(part.tolist()) == list(range(start, min(n, start + window)))
    shuffled = np.random.default_rng(1).permutation(n)
    assert (sharding.permuted_in_windows(shuffled, n, window) == out[shuffled]).all()
    if n == 5_000:
        assert (out[:2_560] != np.arange(2_560)).mean() > 0.9


def test_prefixes_of_all_shards_keep_the_weights(spark, tmp_path):
    sizes = {**{f"s{k}": 1_500 for k in range(4)}, "big": 9_000, "tiny": 1, None: 1}
    own = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.seed(2)
    random.shuffle(own)
    docs = spark.createDataFrame(own, "doc_id long, text string, source string")
    pipeline.source_mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    order = [r.doc_id for r in pipeline.source_mixing(spark, docs, "").collect()]
    rows = pipeline.sharding_rows(spark, mixed, "").collect()
    assert len(rows) == len(own) and {r.shard for r in rows} == set(range(40))
    by_shard = collections.Counter(r.shard for r in rows)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    weight = {s: n**0.75 for s, n in sizes.items()}
    whole = sum(weight.values())
    for slots in (64, 128, 192):
        taken = [r for r in rows if r.slot < slots]
        assert {r.doc_id for r in taken} == set(order[: slots * 40])
        counts = collections.Counter(r.source for r in taken)
        for s, w in weight.items():
            if sizes[s] > 1:
                # Less than a block of four rows, parts of a thousand, and the rows of the two tiny sources.
                assert abs(counts[s] - w / whole * len(taken)) < 4 * 2 + 0.002 * len(taken)
    # In the corpus's own order the weights would not hold.
    plain = collections.Counter(s for _, _, s in own[: 64 * 40])
    assert abs(plain["big"] - weight["big"] / whole * 64 * 40) > 4 * 2 + 0.002 * 64 * 40
