"""Language by rank-order n-gram profiles.

A language's profile is its PROFILE most frequent character n-grams (1 to 3, words padded with a
blank) in order. A document's own ranking is compared with every profile by the out-of-place
distance: the sum of rank differences, PROFILE for an n-gram the profile lacks. The nearest profile
wins, the smaller name on ties. The score is one minus the distance as a part of the largest
possible one.

Whole texts are ranked. NULL texts and texts without a letter are `und` with score 0, as is any text
if nothing could be learned. Documents with NULL lang are not learned from. Repeated rows count as
often as they occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
PROFILE = 400
# Profiles are counted on about so many documents of each language, chosen by a hash of the id.
LEARNED_DOCS = 4_000
# Tables with one row per language are broadcast up to this many rows.
BROADCAST_LANGS = 1_000

# An n-gram is one number: up to three code points of 21 bits, the first highest, zeros after a
# shorter one. So numbers are ordered as the n-grams are as strings.
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000
    )


def grams(text: str | None) -> np.ndarray:
    """All n-grams of the text's words, each word padded with a blank on either side."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a gap between words the first character stays, as its blank
    kept[0] = True
    codes, letter = np.where(letter, codes, 32)[kept].astype(np.int64), letter[kept]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    first = codes << 2 * _BITS
    second = first[:-1] | codes[1:] << _BITS
    third = second[:-1] | codes[2:]
    # A blank alone is no n-gram, and none reaches over the blank between two words.
    return np.concatenate([first[letter], second, third[letter[1:-1]]])


def spelled(gram: int) -> str:
    codes = (gram >> 2 * _BITS, gram >> _BITS & (1 << _BITS) - 1, gram & (1 << _BITS) - 1)
    return "".join(chr(c) for c in codes if c)


def numbered(gram: str) -> int:
    return sum(ord(c) << _BITS * (2 - i) for i, c in enumerate(gram))


def ranked(text: str | None, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order of the n-gram where counts are equal."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:most]]


def learned(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(lang, gram, rank): the profile of every non-null language in `docs`."""
    known = docs.where(F.col(lang).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")
    )
    sizes = known.groupBy("lang").count()
    share = sizes.select("lang", (F.lit(LEARNED_DOCS) / F.col("count")).alias("share"))
    if sizes.count() <= BROADCAST_LANGS:
        share = F.broadcast(share)
    draw = F.xxhash64(F.coalesce(F.col("k"), F.lit(0)), F.lit(1)).bitwiseAND(2**31 - 1) / 2.0**31
    chosen = known.join(share, "lang").where(draw < F.col("share")).select("lang", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, text in zip(batch["lang"], batch["t"], strict=True):
                found, counts = np.unique(grams(text), return_counts=True)
                total = totals.setdefault(name, {})
                for gram, n in zip(found.tolist(), counts.tolist(), strict=True):
                    total[gram] = total.get(gram, 0) + n
        for name, total in totals.items():
            yield pd.DataFrame(
                {"lang": name, "gram": [spelled(g) for g in total], "n": list(total.values())}
            )

    partial = chosen.mapInPandas(count, "lang string, gram string, n long")
    summed = partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return summed.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE).drop("n")


class Profiles:
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([numbered(gram) for _, gram, _ in rows], dtype=np.int64))
        column = {lang: i for i, lang in enumerate(self.langs)}
        # The last row stands for n-grams that no profile has.
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, numbered(gram)), column[lang]] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        own = ranked(text)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = self.ranks[np.where(self.grams[at] == own, at, -1)]
        away = np.abs(theirs - np.arange(len(own))[:, None])
        away[theirs < 0] = PROFILE
        distance = away.sum(0)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def predicted(docs: DataFrame, profiles: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score. The profiles, PROFILE rows a language, go to every task."""
    rows = [(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Profiles(shared.value)
        for texts in batches:
            yield pd.DataFrame([own.nearest(t) for t in texts], columns=["lang_pred", "score"])

    judged = docs.withColumn("_judged", judge(F.coalesce(F.col(text), F.lit(""))))
    return judged.withColumns(
        {"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}
    ).drop("_judged")
