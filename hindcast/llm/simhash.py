"""SimHash fingerprints and near-duplicate groups, found through vantage-point trees.

Search within a Hamming radius (`groups_within`). A tree is fitted on a bounded sample of the
fingerprints: a node holds a vantage point v and a radius m, its inner side is d(x, v) <= m. A
fingerprint lives in one leaf. By the triangle inequality, two fingerprints at most r apart that a
node separates have the outer one within m + r of v, so copying outer ones with d <= m + r into the
inner side keeps every pair together in some leaf. Leaves are the shards: each compares its own
rows, with the same pruning inside, and returns only which rows belong together, so output is linear
in the rows however dense a shard is. Shards meet in their common rows, joined by connected
components. A shard that the tree can't split to the wanted size (rows closer to each other than the
radius) is cut into blocks, and every two blocks are compared in a task of their own.

Search for word-shingle similarity (`similar_groups`). The tree comes first: rows whose fingerprints
link up within its radius meet in one shard, so no pair of similar sets that close is ever missed. At a
Jaccard similarity of 0.8, though, 64-bit fingerprints differ in 10 bits on average and up to 20, where
triangle bounds prune nothing. Further shards for these pairs come from the smallest shingle hashes,
which similar sets share (see SKETCH_KEYS). Inside a shard rows of close fingerprints are compared
first, and whole sets decide on every pair.

Texts without words have fingerprint zero and no shingle; NULL counts as empty. Repeated rows share
a fingerprint and so a group. NULL ids never are the smallest id; a group of only NULL ids has
component NULL. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import components
from hindcast.session import cut_lineage

SEED = 42
RADIUS = 2
# Rows a shard should hold, sampled rows per wanted shard, and most sampled rows (8 bytes each).
SHARD_ROWS = 8_192
SAMPLE_PER_SHARD = 128
SAMPLE_ROWS = 2_000_000
# Inside a shard: rows compared without a further split.
SMALL = 256

SIMILARITY = 0.8
SIMILAR_WORDS = 5
# Two sets of similarity s share none of their k smallest hashes with a chance of about (1 - s)^k:
# one in 15,000 at 0.8 and k = 6.
SKETCH_KEYS = 6
# Fingerprints of sets of similarity 0.8 differ in 9.7 bits, standard deviation 2.9. Up to 24 bits (five
# deviations) rows are tested one by one; the others are counted all at once.
SIMILAR_BITS = 24
# A block of a shard holds at most so many rows and shingles (of four bytes), or one row.
BLOCK_ROWS = 1_024
BLOCK_SHINGLES = 1_000_000
# Single tests of a row before it is compared with all other rows of its cell at once.
TESTS = 12


# Fingerprints of texts

def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; only A-Z are lower-cased, as bytes."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True))
    return np.fromiter(hashes, dtype=np.uint64, count=len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit number whose bits are set where over half the hashes have them set."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536]).astype("<u8").view(np.uint8)
        votes += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprinted(docs: DataFrame, words: int, text: str = "text", name: str = "fp") -> DataFrame:
    """`docs` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return docs.withColumn(name, simhash(F.coalesce(F.col(text), F.lit(""))))


# Groups inside one task

def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Groups:
    """Union of rows by their positions, on arrays."""

    def __init__(self, rows: int):
        self.root = np.arange(rows)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            left, right = root[a], root[b]
            differ = left != right
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            high = np.maximum(left[differ], right[differ])
            np.minimum.at(root, high, np.minimum(left[differ], right[differ]))
            while (root != (up := root[root])).any():
                root[:] = up


@dataclass
class Split:
    vantage: np.uint64
    limit: int
    inner: object = None
    outer: object = None


def best_split(rows: np.ndarray, radius: int, seed: int) -> Split | None:
    """The (vantage, limit) whose two sides, copies included, cost least; None if none helps."""
    rng = np.random.default_rng(seed)
    picked = rows[rng.integers(0, len(rows), 8)]
    tried = rows if len(rows) <= 4_096 else rows[rng.integers(0, len(rows), 4_096)]
    best, found = 0.8, None
    for vantage in picked:
        upto = np.cumsum(np.bincount(_distance(tried, vantage), minlength=65)) / len(tried)
        wide = upto[np.minimum(np.arange(65) + radius, 64)]
        cost = wide**2 + (1 - upto) ** 2
        at = int(np.argmin(cost))
        if cost[at] < best:
            best, found = cost[at], Split(vantage, at)
    return found


def link_within(rows: np.ndarray, at: np.ndarray, radius: int, groups: Groups, depth: int = 0) -> None:
    """Unites all rows[at] that are at most `radius` apart, splitting as the tree does."""
    split = best_split(rows[at], radius, depth) if len(at) > SMALL else None
    if split is not None:
        far = _distance(rows[at], split.vantage)
        link_within(rows, at[far <= split.limit + radius], radius, groups, depth + 1)
        link_within(rows, at[far > split.limit], radius, groups, depth + 1)
        return
    link_between(rows, at, at, radius, groups)


def link_between(rows, left: np.ndarray, right: np.ndarray, radius: int, groups: Groups) -> None:
    step = max(1, 2_000_000 // max(len(right), 1))
    for k in range(0, len(left), step):
        i, j = np.nonzero(_distance(rows[left[k : k + step], None], rows[None, right]) <= radius)
        groups.unite(left[k + i], right[j])


# The tree over shards

def fit_tree(sample: np.ndarray, wanted: int, radius: int, depth: int = 0):
    """Nested Splits down to leaves of at most `wanted` sampled rows; a leaf is its number, set later."""
    split = best_split(sample, radius, depth) if len(sample) > wanted else None
    if split is None:
        return None
    far = _distance(sample, split.vantage)
    split.inner = fit_tree(sample[far <= split.limit + radius], wanted, radius, depth + 1)
    split.outer = fit_tree(sample[far > split.limit], wanted, radius, depth + 1)
    return split


def leaves_of(tree, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, leaf) of every row and leaf it lives in or is copied to. A leaf is named by its path."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def walk(node, at: np.ndarray, path: int) -> None:
        if not len(at):
            return
        if node is None:
            found.append((at, np.full(len(at), path, dtype=np.int64)))
            return
        far = _distance(rows[at], node.vantage)
        walk(node.inner, at[far <= node.limit + radius], 2 * path)
        walk(node.outer, at[far > node.limit], 2 * path + 1)

    walk(tree, np.arange(len(rows)), 1)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def groups_within(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(node, component) of the fingerprints in `distinct` (fp) that are linked to another one.

    `distinct` should be a stored table. The driver holds the sample (SAMPLE_ROWS at most), the tree
    fitted on it, and one count per leaf.
    """
    total = distinct.count()
    shards = -(-total // shard_rows)
    sample_rows = min(SAMPLE_ROWS, SAMPLE_PER_SHARD * shards)
    if shards > 1:
        share = int(2**31 * min(1.0, sample_rows / total))
        picked = distinct.where((F.xxhash64("fp").bitwiseAND(2**31 - 1)) < share).toPandas()
        sample = picked["fp"].to_numpy().astype(np.int64).view(np.uint64)
        tree = fit_tree(sample, max(1, len(sample) * shard_rows // total), radius)
    else:
        tree = None
    spread = distinct.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["fp"].to_numpy().astype(np.int64)
            at, leaf = leaves_of(spread.value, rows.view(np.uint64), radius)
            yield pd.DataFrame({"fp": rows[at], "leaf": leaf})

    routed = distinct.select("fp").mapInPandas(route, "fp long, leaf long")
    sizes = {
        row["leaf"]: row["count"]
        for row in routed.groupBy("leaf").count().where(F.col("count") > 2 * shard_rows).collect()
    }

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a large leaf go to every pair of blocks that has theirs."""
        for batch in batches:
            large = batch["leaf"].isin(list(sizes))
            yield batch[~large].assign(i=0, j=0)[["fp", "leaf", "i", "j"]]
            for leaf, part in batch[large].groupby("leaf"):
                blocks = -(-sizes[leaf] // shard_rows)
                own = (part["fp"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = (own % np.uint64(blocks)).astype(np.int64)
                for other in range(blocks):
                    yield part.assign(i=np.minimum(own, other), j=np.maximum(own, other))

    def linked(cell: pd.DataFrame) -> pd.DataFrame:
        rows = np.unique(cell["fp"].to_numpy().astype(np.int64)).view(np.uint64)
        groups = Groups(len(rows))
        link_within(rows, np.arange(len(rows)), radius, groups)
        signed = rows.view(np.int64)
        found = groups.root != np.arange(len(rows))
        return pd.DataFrame({"a": signed[found], "b": signed[groups.root[found]]})

    celled = routed.mapInPandas(cells, "fp long, leaf long, i long, j long")
    edges = celled.groupBy("leaf", "i", "j").applyInPandas(linked, "a long, b long")
    return components(edges)


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = RADIUS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id): the group of every document whose fingerprints link up."""
    marked = cut_lineage(fingerprinted(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), words, "t").drop("t"))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    roots = groups_within(distinct.select("fp"), radius)
    placed = cut_lineage(
        distinct.join(roots, distinct.fp == roots.node, "left").select(
            "fp", "lowest", F.coalesce("component", "fp").alias("root")
        )
    )
    lowest = placed.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# Similarity of shingle sets

def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if common else 0.0


class Overlaps:
    """How many shingles each row of a cell shares with one of them, all rows at once."""

    def __init__(self, sets: list[np.ndarray]):
        owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        known, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        self.owners = owners[np.argsort(self.at, kind="stable")]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(self.at, minlength=len(known)))))
        self.rows = len(sets)

    def with_row(self, k: int) -> np.ndarray:
        own = self.at[self.starts[k] : self.starts[k + 1]]
        counts = self.bounds[own + 1] - self.bounds[own]
        ends = np.cumsum(counts)
        spots = np.arange(ends[-1]) + np.repeat(self.bounds[own] - ends + counts, counts)
        return np.bincount(self.owners[spots], minlength=self.rows)


def link_similar(fps: np.ndarray, sets: list[np.ndarray], similarity: float, groups: Groups,
                 left: np.ndarray, right: np.ndarray) -> None:
    """Unites rows of similar sets, of which one is in `left` and one in `right`.

    Close fingerprints are tried first, and rows that are together already are not tried again, so
    tests stay few in a dense group. All rows that are left, near or far, are compared at once:
    fingerprints only order the tests.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    overlaps = None
    for k in left:
        fits = groups.root[right] != groups.root[k]
        if left is right:
            fits &= right > k
        fits &= (sizes[right] >= similarity * sizes[k]) & (sizes[right] * similarity <= sizes[k])
        others = right[fits]
        if not len(others):
            continue
        away = _distance(fps[others], fps[k])
        others = others[np.argsort(away, kind="stable")]
        singly = min(TESTS, len(others) if len(others) <= 2 else int((away <= SIMILAR_BITS).sum()))
        for other in others[:singly]:
            if groups.root[other] != groups.root[k] and _jaccard(sets[k], sets[other]) >= similarity:
                groups.unite(np.array([k]), np.array([other]))
        others = others[singly:]
        others = others[groups.root[others] != groups.root[k]]
        if len(others):
            overlaps = overlaps or Overlaps(sets)
            common = overlaps.with_row(k)[others]
            alike = others[common / (sizes[k] + sizes[others] - common) >= similarity]
            groups.unite(np.full(len(alike), k), alike)


def similar_groups(
    docs: DataFrame, key: str, text: str = "text", words: int = SIMILAR_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, group): rows of `docs` that have a similar one, by a long `key` that equal texts may share.

    group is the smallest key reachable over links of Jaccard similarity >= `similarity` between
    sets of word shingles. Rows equal as sets are linked by one key of the whole set; of each such
    class one goes on to the tree and the comparison. 32 bits of a hash stand for a shingle.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, whole in zip(batch["k"], batch["t"], strict=True):
                hashes = shingle_hashes(whole, words)
                if len(hashes):
                    members = np.unique((hashes >> np.uint64(32)).astype("<u4"))
                    # Mixed again, so that the smallest are not those first in the set's own order.
                    mixed = np.sort(members * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995))
                    packed = members.tobytes()
                    whole_set = xxhash.xxh64_intdigest(packed, SEED) - 2**63
                    keys = mixed[:SKETCH_KEYS].astype(np.int64).tolist()
                    out.append((own, whole_set, fingerprint_of(np.unique(hashes)), keys, len(members), packed))
            yield pd.DataFrame(out, columns=["k", "whole", "fp", "keys", "size", "packed"])

    narrow = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sets = cut_lineage(
        narrow.mapInPandas(sketch, "k long, whole long, fp long, keys array<long>, size long, packed binary")
    )
    classes = cut_lineage(sets.groupBy("whole").agg(F.min("k").alias("first")))
    equal = sets.select("k", "whole").join(classes, "whole").where("k <> first")
    equal = equal.select(F.col("k").alias("a"), F.col("first").alias("b"))
    firsts = classes.select(F.col("first").alias("k"))
    distinct = cut_lineage(sets.select("k", "fp", "keys", "size").join(firsts, "k", "left_semi"))
    # Rows of equal fingerprints, or of ones that the tree links, meet in one shard, named by the group.
    close = groups_within(cut_lineage(distinct.select("fp").distinct()))
    close = close.select(F.col("node").alias("fp"), "component")
    from_tree = distinct.join(close, "fp", "left").select(
        "k", "size", F.concat(F.lit("tree "), F.coalesce("component", "fp")).alias("shard")
    )
    from_keys = distinct.select("k", "size", F.explode(F.col("keys").cast("array<string>")).alias("shard"))
    shards = cut_lineage(from_tree.union(from_keys).distinct())
    members = (
        shards.groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.sum("size").alias("shingles"), F.min("k").alias("low"),
            F.max("k").alias("high"), F.bit_xor(F.xxhash64("k")).alias("mark"),
        )
        .where("rows > 1")
    )
    # Similar rows share most of their keys: of shards with the same members one is compared.
    counts = members.groupBy("rows", "shingles", "low", "high", "mark").agg(F.min("shard").alias("shard"))
    blocks = F.greatest(
        F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)
    ).cast("int")
    shared = shards.join(counts.select("shard", blocks.alias("blocks")), "shard")
    own = F.pmod(F.xxhash64("k"), F.col("blocks"))
    cells = shared.select("k", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    cells = cells.select("k", "shard", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own")

    def linked(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("k")
        ks = cell["k"].to_numpy()
        fps = cell["fp"].to_numpy().astype(np.int64).view(np.uint64)
        lists = [np.frombuffer(p, dtype="<u4") for p in cell["packed"]]
        groups = Groups(len(ks))
        own, i, j = (cell[name].to_numpy() for name in ("own", "i", "j"))
        left = np.flatnonzero(own == i)
        right = left if i[0] == j[0] else np.flatnonzero(own == j)
        link_similar(fps, lists, similarity, groups, left, right)
        found = groups.root != np.arange(len(ks))
        return pd.DataFrame({"a": ks[found], "b": ks[groups.root[found]]})

    once = sets.groupBy("k").agg(F.first("fp").alias("fp"), F.first("packed").alias("packed"))
    full = cells.join(once, "k").select("k", "fp", "packed", "shard", "i", "j", "own")
    edges = full.groupBy("shard", "i", "j").applyInPandas(linked, "a long, b long")
    found = components(edges.union(equal))
    return found.select(F.col("node").alias(key), F.col("component").alias("group"))


def first_of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of `rows` (k, doc_id), the k to keep: each without a group, and that of the smallest doc_id,
    NULL first, of every group in `groups` (k, group)."""
    placed = rows.distinct().join(groups, "k", "left")
    best = F.min_by("k", F.struct("doc_id", "k")).alias("k")
    return placed.groupBy(F.coalesce("group", "k").alias("root")).agg(best).select("k")
