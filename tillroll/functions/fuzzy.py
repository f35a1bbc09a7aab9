"""F-39 and its uses: Ratcliff-Obershelp similarity, which Spark lacks, as Arrow-batched functions.

Exact matches are native.  A similarity needs that many equal letters in one order, so letters are counted and common subsequences
are found for a whole batch at once, and only stretches with enough of them are compared.  Each different text of a batch is looked at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=50_000)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def alike(a: str, b: str, least: float) -> bool:
    """Whether the similarity is ``least`` or more; lengths and letters rule most pairs out."""
    need = least * (len(a) + len(b)) / 2
    if min(len(a), len(b)) < need:
        return False
    letters = set(b)
    return sum(c in letters for c in a) >= need and ratio(a, b) >= least


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text ends."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in texts], dtype=np.int64)


def in_order(stretches: np.ndarray, word: str) -> np.ndarray:
    """For an array (m, n) of code points: how many letters the longest common subsequence of each row and a word of at most 64 letters has."""
    letters, place = np.unique(np.array([ord(c) for c in word], np.uint32), return_inverse=True)
    bits = np.zeros(len(letters) + 1, np.uint64)
    for i, k in enumerate(place.tolist()):
        bits[k] |= np.uint64(1 << i)
    at = np.minimum(np.searchsorted(letters, stretches), len(letters) - 1)
    masks = bits[np.where(letters[at] == stretches, at, len(letters))]
    # Hyyro's recurrence: a zero bit for each letter of the subsequence
    held = np.full(len(stretches), ~np.uint64(0))
    for mask in masks.T:
        hit = held & mask
        held = (held + hit) | (held - hit)
    return np.bitwise_count(~held)


def near_coded(texts: list[str], codes: np.ndarray, ends: np.ndarray, word: str, least: float) -> set[int]:
    """:func:`near_texts` of texts whose :func:`coded` is known."""
    n = len(word)
    if len(codes) < n:
        return set()
    hits = np.concatenate([[0], np.cumsum(np.isin(codes, [ord(c) for c in set(word)]))])
    at = np.flatnonzero(hits[n:] - hits[:-n] >= least * n)
    text = np.searchsorted(ends, at, side="right")
    inside = at + n <= ends[text]
    at, text = at[inside], text[inside]
    if len(at) and n <= 64:
        fit = in_order(np.lib.stride_tricks.sliding_window_view(codes, n)[at], word) >= least * n
        at, text = at[fit], text[fit]
    found: set[int] = set()
    for i, begin in zip(text.tolist(), (at - ends[text]).tolist(), strict=True):
        begin += len(texts[i])
        if i not in found and ratio(texts[i][begin : begin + n], word) >= least:
            found.add(i)
    return found


def near_texts(texts: list[str], word: str, least: float) -> set[int]:
    """Which of ``texts`` hold some stretch of the word's length that is at least that similar to it."""
    return near_coded(texts, *coded(texts), word, least)


def by_text(held: pa.Array, of: Callable[[list[str]], pa.Array]) -> pa.Array:
    """For an array of arrays of texts the value of each text, where ``of`` gives those of different texts."""
    encoded = held.flatten().dictionary_encode()
    values = of(encoded.dictionary.to_pylist()).take(encoded.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values, mask=held.is_null())


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def first_near(words: list[str], least: float):
    """A function of an array of texts: for each the number of the first of ``words`` that it nearly holds, or null."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def of(texts: list[str]) -> pa.Array:
            first: list[int | None] = [None] * len(texts)
            codes, ends = coded(texts)
            for i in range(len(words) - 1, -1, -1):
                for j in near_coded(texts, codes, ends, words[i], least):
                    first[j] = i
            return pa.array(first, pa.int32())

        for batch in batches:
            yield by_text(batch, of)

    return run


def any_word_like(words: list[str], least: float, pattern: str):
    """A function of an array of texts: for each whether one of the matches of ``pattern`` in it is that similar to one of ``words``."""

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, known = re.compile(pattern), lru_cache(maxsize=50_000)(lambda t: any(alike(t, w, least) for w in words))
        for batch in batches:
            yield by_text(batch, lambda texts: pa.array([any(map(known, tokens.findall(t))) for t in texts], pa.bool_()))

    return run


def text_like(words: list[str], least: float):
    """A function of an array of texts: for each whether it is that similar to one of ``words``."""

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def of(texts: list[str]) -> pa.Array:
            codes, ends = coded(texts)
            size = np.diff(ends, prepend=0)
            found = np.zeros(len(texts), bool)
            for word in words:
                need = least * (size + len(word)) / 2
                hits = np.concatenate([[0], np.cumsum(np.isin(codes, [ord(c) for c in set(word)]))])
                for i in np.flatnonzero(~found & (np.minimum(size, len(word)) >= need) & (hits[ends] - hits[ends - size] >= need)).tolist():
                    found[i] = alike(texts[i], word, least)
            return pa.array(found)

        for batch in batches:
            yield by_text(batch, of)

    return run
