"""Hard texts, and brute-force forms of what the operators compute."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"word{i % 997} and the" for i in range(60_000))
HARD_TEXTS = [
    None, "", " ", "\n\n\t", "a", "A b", "one two three", "one two three", "ONE TWO THREE",
    "the cat sat on the mat. " * 12, "x" * 100_000, "Ünï çødé – 日本語 \U0001f600 e\u0301 " * 20,
    "# % & | < > * $ " * 30, "line\nline\nline\n\nline", LONG, LONG + " end", "\x00\x01 \x7f \ue000x",
]


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    own = words((text or "").translate(UPPER))
    return [" ".join(own[i : i + n]) for i in range(max(1, len(own) - n + 1))] if own else []


def fingerprint(text, n=3):
    own = shingles(text, n)
    votes = [0] * 64
    for shingle in own:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            votes[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if votes[bit] * 2 > len(own))


def roots(n, pairs):
    """Smallest position reachable from each."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def close_pairs(fingerprints, radius):
    values = np.array(fingerprints, dtype=np.uint64)
    return np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
