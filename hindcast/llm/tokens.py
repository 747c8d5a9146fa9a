"""Exact token counts at every prefix of a text, by dynamic programming over the last token.

In byte-pair encoding a sequence of tokens is the encoding of its text if and only if every two
neighbours are the encoding of theirs. So the last token of a prefix is the one vocabulary suffix
that fits the last token of the prefix before it, and one pass gives the count of every prefix:
count[i] = count[i - len(last)] + 1. Truncation and budget questions are look-ups in that array.

No piece of the vocabulary has a white-space mark after another character, so encodings never cross
the border before a mark: a text is the chain of its marked words, and counts add up. Words of usual
length are kept with their counts. NULL and empty texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece.sentencepiece_model_pb2 import ModelProto

MODEL = "piece_bpe_32k.model"
LIMIT = 4_096

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_KEPT_CHARS = 48
_KEPT_WORDS = 400_000


class PrefixCounter:
    """Counts of one vocabulary; `word(s)[i]` is the count of the first i characters of a word."""

    def __init__(self, model: str):
        own = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(own.get_piece_size())
        plain = [i for i in ids if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))]
        self.pieces = {i: own.id_to_piece(i) for i in plain}
        if any(MARK in piece.lstrip(MARK) for piece in self.pieces.values()):
            raise ValueError("a piece has a white-space mark inside, words can't be split before marks")
        # Gives all pieces that end at a character, the longest first.
        self._suffixes = ahocorasick.Automaton()
        for i, piece in self.pieces.items():
            self._suffixes.add_word(piece, (i, len(piece)))
        self._suffixes.make_automaton()
        # The same vocabulary without the mark before a text, to ask how two neighbours encode.
        bare = ModelProto.FromString(own.serialized_model_proto())
        bare.normalizer_spec.add_dummy_prefix = False
        self._pairs = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self._totals: dict[str, int] = {}
        self._fits: dict[int, bool] = {}

    def _fit(self, left: int, right: int) -> bool:
        if len(self._fits) > _KEPT_WORDS:
            self._fits.clear()
        pair = [left, right] if left else [right]
        text = "".join(self.pieces[i] for i in pair)
        known = self._fits[left << 32 | right] = self._pairs.encode(text) == pair
        return known

    def _counts(self, text: str) -> list[int]:
        fits = self._fits
        count, last, done = [0] * (len(text) + 1), [0] * (len(text) + 1), 0

        def alone(until: int, done: int) -> int:
            # A character outside the vocabulary stays alone and falls back to its bytes. Last token
            # 0 (unknown) lets anything follow it.
            for i in range(done + 1, until + 1):
                count[i] = count[i - 1] + len(text[i - 1].encode())
            return max(done, until)

        for end, (piece, size) in self._suffixes.iter(text):
            if end < done:
                continue
            if end > done:
                done = alone(end, done)
            before = last[end + 1 - size]
            fit = fits.get(before << 32 | piece)
            if self._fit(before, piece) if fit is None else fit:
                done = end + 1
                last[done], count[done] = piece, count[done - size] + 1
        alone(len(text), done)
        return count

    def word(self, text: str) -> np.ndarray:
        return np.array(self._counts(text), dtype=np.int64)

    def _total(self, word: str) -> int:
        known = self._totals.get(word)
        if known is None:
            known = self._counts(word)[-1]
            if len(word) <= _KEPT_CHARS:
                if len(self._totals) >= _KEPT_WORDS:
                    self._totals.clear()
                self._totals[word] = known
        return known

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def total(self, text: str | None) -> int:
        return sum(map(self._total, self.words(text or "")))

    def prefixes(self, text: str) -> np.ndarray:
        """Count of every prefix: entry i for the first i characters, 0 for none."""
        parts, before = [np.zeros(1, dtype=np.int64)], 0
        for k, word in enumerate(self.words(text)):
            own = self.word(word)
            # The first mark is put before the text, not a character of it.
            parts.append(before + own[2 if k == 0 else 1 :])
            before += int(own[-1])
        return np.concatenate(parts)[: len(text) + 1]


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def counted(docs: DataFrame, text: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(public_tokenizers.path(model))
        for texts in batches:
            yield pd.Series([own.total(t) for t in texts], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(whole).cast("long"))
        .withColumn("n_tokens", n_tokens(whole))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def truncated(docs: DataFrame, budget: int, text: str = "text", model: str = MODEL) -> DataFrame:
    """`docs` with `truncated`: the longest prefix of the text that takes at most `budget` tokens."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(public_tokenizers.path(model))
        for texts in batches:
            yield pd.Series([t[: int(np.flatnonzero(own.prefixes(t) <= budget)[-1])] for t in texts])

    return docs.withColumn("truncated", cut(F.coalesce(F.col(text), F.lit(""))))
