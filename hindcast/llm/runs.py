"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
2q words long, that neither neighbouring word extends. The words of a block of documents stand in one
array, with a separator of its own after each document, so that no run crosses a border.

The dictionary names the factors of length m = 1, 2, 4, ... at every position; equal factors share a
name, and a factor that occurs once in its document has none to share. Take a run from s with period
q, and m with m <= q < 2m: its factor at s occurs again at s + q, less than twice its length away.
Occurrences of a factor at most m / 2 apart form one arithmetic progression, whose difference is the
factor's own period; between two progressions lie more than m / 2 positions, so at most three later
ones begin within 2m. Were s neither the first of its progression nor s + q the first of its own, the
run would go on to the left of s. So the period is proposed by pairs of an occurrence and the first
of another progression, linear in number for each length. Proposals whose previous words are equal
start further left and go; the others are extended with the dictionary, word stretches doubling.
Stretches found with several periods keep the smallest.

Work is n log n for n words of a document; memory is four bytes a word and length, for a block of
BLOCK_WORDS words or one longer document.

NULL and empty texts have no runs. Repeated rows are judged each for itself. There are no ties:
runs of a document come by start, then period. An empty table gives no rows. Columns `runs` and
`collapsed` of the input are replaced; all others come through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MIN_WORDS = 12
BLOCK_WORDS = 400_000

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


class Factors:
    """Names of the factors of power-of-two length of an array whose last entry occurs once.

    `names[k][i]` stands for the 2^k entries from i: equal factors have equal names, and a factor
    without equals has the negative name -i - 1.
    """

    def __init__(self, names: np.ndarray) -> None:
        self.names = [names]
        self.groups = [self._grouped(names, np.flatnonzero(names >= 0))]
        while len(self.groups[-1][0]):
            self._double()

    @staticmethod
    def _grouped(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of equal keys side by side, ascending, and whether each goes on with its group."""
        order = np.argsort(keys[at], kind="stable")
        at = at[order]
        same = np.zeros(len(at), dtype=bool)
        np.equal(keys[at[1:]], keys[at[:-1]], out=same[1:])
        return at, same

    def _double(self) -> None:
        half, m = self.names[-1], 1 << (len(self.names) - 1)
        n = len(half)
        at = self.groups[-1][0]
        at = np.sort(at[at + m < n])
        at = at[half[at + m] >= 0]
        keys = half[at].astype(np.int64) * n + half[at + m]
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        same = np.zeros(len(at) + 1, dtype=bool)
        np.equal(keys[1:], keys[:-1], out=same[1 : max(1, len(at))])
        shared = same[:-1] | same[1:]
        at, same = at[shared], same[:-1][shared]
        whole = -np.arange(1, n + 1, dtype=half.dtype)
        whole[at] = np.cumsum(~same) - 1
        self.names.append(whole)
        self.groups.append((at, same))

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) pairs among which are those of every run."""
        words = self.names[0]
        starts, periods = [], []

        def propose(x: np.ndarray, y: np.ndarray, m: int) -> None:
            q = y - x
            near = (q >= m) & (q < 2 * m)
            x, q = x[near], q[near]
            inside = np.flatnonzero(x > 0)
            goes_on = np.zeros(len(x), dtype=bool)
            goes_on[inside] = words[x[inside] - 1] == words[x[inside] + q[inside] - 1]
            starts.append(x[~goes_on])
            periods.append(q[~goes_on])

        for k, (at, same) in enumerate(self.groups):
            if not len(at):
                continue
            m = 1 << k
            close = np.zeros(len(at), dtype=bool)
            close[1:] = same[1:] & (2 * (at[1:] - at[:-1]) <= m)
            own = np.cumsum(~close) - 1
            first = at[~close]
            name = np.cumsum(~same)[~close]
            for step in (1, 2, 3):
                later = np.flatnonzero(own + step < len(first))
                later = later[name[own[later] + step] == name[own[later]]]
                propose(at[later], first[own[later] + step], m)
                # Firsts of two progressions were paired just now.
                inner = np.flatnonzero(close & (own >= step))
                inner = inner[name[own[inner] - step] == name[own[inner]]]
                propose(first[own[inner] - step], at[inner], m)
        return np.concatenate(starts or [at]), np.concatenate(periods or [at])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from positions `a` and `b`, a < b."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            length[self.names[k][a + length] == self.names[k][b + length]] += 1 << k
        return length


def find_runs(names: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of at least `least` entries, by start, then period.

    `names` are those of `Factors.names[0]`.
    """
    factors = Factors(names)
    start, period = factors.proposals()
    common = factors.common(start, start + period)
    long = (common >= period) & (common + period >= least)
    start, period, length = start[long], period[long], (common + period)[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    again = np.zeros(len(start), dtype=bool)
    again[1:] = (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    start, length, period = start[~again], length[~again], period[~again]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def named(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of the documents, a separator after each, and where each document begins.

    A word shares its name with its equals in the same document only.
    """
    sizes = np.array([len(words) + 1 for words in documents], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    n = int(begins[-1])
    known: dict[bytes, int] = {}
    ids = np.empty(n, dtype=np.int64)
    for k, words in enumerate(documents):
        ids[begins[k] : begins[k + 1] - 1] = [known.setdefault(w, len(known)) for w in words]
    ids[begins[1:] - 1] = len(known)
    keys = np.repeat(np.arange(len(documents)), sizes) * (len(known) + 1) + ids
    order = np.argsort(keys, kind="stable")
    same = np.zeros(n + 1, dtype=bool)
    np.equal(keys[order][1:], keys[order][:-1], out=same[1:n])
    shared = same[:-1] | same[1:]
    names = -np.arange(1, n + 1, dtype=np.int32 if n < 2**31 - 1 else np.int64)
    names[order[shared]] = np.cumsum(~same[:-1][shared]) - 1
    return names, begins


def judged_block(texts: list[bytes | None], least: int) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Per text its number of runs, all runs as rows (start, length, period), and its collapsed form."""
    # bytes.split takes the blank and U+0009 to U+000D for white space, nothing else.
    documents = [(text or b"").split() for text in texts]
    names, begins = named(documents)
    start, length, period = find_runs(names, least)
    owner = np.searchsorted(begins, start, side="right") - 1
    depth = np.zeros(len(names) + 1, dtype=np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth[:-1]) == 0
    counts = np.bincount(owner, minlength=len(documents))
    collapsed = [
        b" ".join(words if not counts[k] else [
            w for w, keep in zip(words, kept[begins[k] : begins[k + 1] - 1]) if keep
        ])
        for k, words in enumerate(documents)
    ]
    return counts.tolist(), np.stack([start - begins[owner], length, period]), collapsed


def _blocks(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Consecutive texts of at most about BLOCK_WORDS words (six bytes each), or one longer text."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text or b"") > 6 * BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text or b"")
    if block:
        yield block


def periodic_runs(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """`docs` with `runs` and `collapsed`.

    runs: array of (start, length, period) in words, all runs of at least `least` words. collapsed:
    the words joined by one blank, without those that a run contains after its first period. Every
    text is read whole. One pass, no exchange.
    """
    own = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = T.StructType(
        [docs.schema[c] for c in own]
        + [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    )
    # The text travels under a position of its own, as a struct beside the input row.
    packed = docs.selectExpr("struct(*) as input", f"cast(`{text}` as binary) as body")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bodies = batch.column(0), batch.column(1)
            done = 0
            for block in _blocks(bodies.to_pylist()):
                counts, found, collapsed = judged_block(block, least)
                runs = pa.StructArray.from_arrays(
                    [pa.array(column, pa.int64()) for column in found], ["start", "length", "period"]
                )
                borders = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                part = rows.slice(done, len(block)).flatten()
                names = [f.name for f in rows.type]
                yield pa.RecordBatch.from_arrays(
                    [part[names.index(c)] for c in own]
                    + [pa.ListArray.from_arrays(borders, runs), pa.array(collapsed, pa.binary()).view(pa.string())],
                    names=[*own, "runs", "collapsed"],
                )
                done += len(block)

    return packed.mapInArrow(judge, schema)
