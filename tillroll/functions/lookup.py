"""Many words at once: which of thousands of keywords a text holds exactly or nearly, at a cost that hardly grows with their number.

Exact words are found by an automaton.  A near word is a stretch of the keyword's length n with a similarity of ``least`` or
more (``fuzzy.ratio``), so keyword and stretch have a common subsequence of n - d letters, where d is the number of letters that may differ.

* d of 1 or 2: the keyword without any d of its letters equals the stretch without some d of its letters.  Hashes of all these
  are a sorted index of the keywords of each length; the stretches of a batch look them up in arrays.
* d of 3 or more (15 letters on at 0.8): of the n - 1 pairs of neighbouring letters, at most 2d lose a letter and d are parted, so the others
  are pairs of the stretch too.  An index from pairs to keywords counts what a piece of text shares with each keyword, and a
  common subsequence of keyword and piece, computed for many of them at once, must have n - d letters.

Whatever these let pass is compared by its similarity itself, so the result is that of comparing everything.  A length of fewer
than ``FEW`` keywords has no index, as comparing them is cheaper.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import ahocorasick
import numpy as np

from tillroll.functions.fuzzy import near_texts, ratio

BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters of text that are looked at together; bounds the memory of a batch.
PIECE = 1 << 14
FEW = 32
#: Entries of the index of pairs that are counted together, and no letter's code.
COUNTS, NO_LETTER = 1 << 20, 0xFFFFFFFF


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def may_differ(n: int, least: float) -> int:
    """How many of n letters may be unmatched at a similarity of ``least``."""
    return n - next(m for m in range(n + 1) if 2.0 * m / (2 * n) >= least)


def shortened(columns: np.ndarray, d: int):
    """For an array (n, m) of m words of n letters: hashes (m,) of the words without d letters, for each choice of 1 or 2 letters."""
    n = len(columns)
    power = np.cumprod(np.full(n, BASE, np.uint64))
    # sums of letters that have moved 0, 1, ... places to the front
    sums = []
    for moved in range(d + 1):
        own = np.zeros_like(columns)
        own[moved:] = columns[moved:] * power[: n - moved, None]
        sums.append(np.concatenate([np.zeros((1, columns.shape[1]), np.uint64), np.cumsum(own, axis=0, dtype=np.uint64)]))
    for gone in combinations(range(n), d):
        edges = (-1, *gone, n)
        yield sum((sums[k][edges[k + 1]] - sums[k][edges[k] + 1] for k in range(d + 1)), np.zeros(columns.shape[1], np.uint64)) * SPREAD


class Keywords:
    """An index of distinct, non-empty keywords; answers are their numbers."""

    def __init__(self, words: tuple[str, ...], least: float | None, few: int = FEW):
        self.words, self.least = words, least
        self.automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            self.automaton.add_word(word, i)
        if words:
            self.automaton.make_automaton()
        self.tables, self.few, long = {}, [], []
        lengths: dict[int, list[int]] = {}
        for i, word in enumerate(words if least is not None else ()):
            lengths.setdefault(len(word), []).append(i)
        for n, ids in lengths.items():
            d = may_differ(n, least)
            if d and len(ids) < few:
                self.few += ids
            elif d > 2:
                long += ids
            elif d:
                self.tables[n] = (d, *self._table(np.array(ids), d))
        self.long = np.array(long, np.int64)
        if long:
            self._pairs()

    def _table(self, ids: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        hashes = list(shortened(np.stack([codes_of(self.words[i]) for i in ids], axis=1), d))
        flat, owner = np.concatenate(hashes), np.tile(ids, len(hashes))
        order = np.argsort(flat, kind="stable")
        bits = min(26, max(12, int(len(flat) * 16).bit_length()))
        marks = np.zeros(1 << bits, bool)
        marks[(flat >> np.uint64(64 - bits)).astype(np.int64)] = True
        return flat[order], owner[order], marks, bits

    def _pairs(self) -> None:
        held = [codes_of(self.words[i]) for i in self.long]
        pairs = [c[:-1] << np.uint64(32) | c[1:] for c in held]
        flat, owner = np.concatenate(pairs), np.repeat(np.arange(len(held), dtype=np.int32), [len(p) for p in pairs])
        order = np.argsort(flat, kind="stable")
        self.pair, first = np.unique(flat[order], return_index=True)
        # the keywords of a pair, one as often as it has the pair
        self.begin, self.held = np.append(first, len(flat)), owner[order]
        self.letters = [len(c) for c in held]
        self.need = np.array([n - 1 - 3 * may_differ(n, self.least) for n in self.letters], np.int64)
        self.common = np.array([n - may_differ(n, self.least) for n in self.letters], np.int64)
        self.longest = max(self.letters)
        self.spelled = np.full((len(held), min(self.longest, 64)), NO_LETTER, np.uint32)
        for k, c in enumerate(held):
            self.spelled[k, : len(c)] = c[:64]

    def exact(self, text: str) -> set[int]:
        return {i for _, i in self.automaton.iter(text)} if self.words else set()

    def near(self, texts: list[str]) -> list[set[int]]:
        """For each text the keywords that it nearly holds; of those that allow no differing letter, none."""
        found: list[set[int]] = [set() for _ in texts]
        begin, size = 0, 0
        for i, text in enumerate(texts):  # groups of texts of about PIECE characters
            size += len(text)
            if size >= PIECE or i + 1 == len(texts):
                group = texts[begin : i + 1]
                compared = ((j, k) for k in self.few for j in near_texts(group, self.words[k], self.least))
                for j, keyword in [*compared, *self._short(group), *self._long(group)]:
                    found[begin + j].add(keyword)
                begin, size = i + 1, 0
        return found

    def _short(self, texts: list[str]):
        joined = "".join(texts)
        codes, ends = codes_of(joined), np.cumsum([len(t) for t in texts])
        for n, (d, hashes, owner, marks, bits) in self.tables.items():
            for left in range(0, len(codes) - n + 1, PIECE):
                own = codes[left : left + PIECE + n - 1]
                windows = np.lib.stride_tricks.sliding_window_view(own, n).T
                seen: set[tuple[int, int]] = set()
                for h in shortened(np.ascontiguousarray(windows), d):
                    at = np.flatnonzero(marks[(h >> np.uint64(64 - bits)).astype(np.int64)])
                    first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
                    real = np.flatnonzero(last > first)
                    seen.update((int(at[r]) + left, int(k)) for r in real for k in owner[first[r] : last[r]])
                for at, k in seen:
                    text = int(np.searchsorted(ends, at, side="right"))
                    if at + n <= ends[text] and ratio(joined[at : at + n], self.words[k]) >= self.least:
                        yield text, k

    def _long(self, texts: list[str]):
        if not len(self.long):
            return
        step = self.longest
        # a stretch that begins in one piece of ``step`` characters ends in it or in the next one
        size = np.array([len(t) for t in texts])
        start, pieces = np.cumsum(size) - size, -(-size // step)
        before = np.cumsum(pieces) - pieces
        text_of = np.repeat(np.arange(len(texts)), pieces)
        left = (np.arange(len(text_of)) - before[text_of]) * step
        codes = codes_of("".join(texts))
        if len(codes) < 2:
            return
        pairs = codes[:-1] << np.uint64(32) | codes[1:]
        place = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        at = np.flatnonzero(self.pair[place] == pairs)
        text = np.searchsorted(start + size, at, side="right")
        number = before[text] + (at - start[text]) // step
        inner = number > before[text]
        both = np.unique(np.concatenate([number, number[inner] - 1]) * len(self.pair) + np.concatenate([place[at], place[at[inner]]]))
        piece, pair = both // len(self.pair), both % len(self.pair)
        chunk = max(1, COUNTS // len(self.long))
        for first in range(0, len(text_of), chunk):
            last = min(first + chunk, len(text_of))
            own = slice(*np.searchsorted(piece, [first, last]))
            counts = self._shared(piece[own] - first, pair[own], last - first)
            near_piece, keyword = np.nonzero(counts >= self.need)
            near_piece += first
            fit = self._in_order(codes, start[text_of[near_piece]] + left[near_piece], np.minimum(2 * step, size[text_of[near_piece]] - left[near_piece]), keyword)
            seen: set[tuple[int, int]] = set()
            for p, k in zip(near_piece[fit].tolist(), keyword[fit].tolist(), strict=True):
                i = int(text_of[p])
                if (i, k) not in seen and near_texts([texts[i][left[p] : left[p] + 2 * step]], self.words[self.long[k]], self.least):
                    seen.add((i, k))
                    yield i, int(self.long[k])

    def _shared(self, piece: np.ndarray, pair: np.ndarray, pieces: int) -> np.ndarray:
        """How many pairs of each keyword each piece has: (pieces, keywords)."""
        counts = np.zeros(pieces * len(self.long), np.int64)
        many = self.begin[pair + 1] - self.begin[pair]
        ends = np.cumsum(many)
        done = 0
        while done < len(many):  # about COUNTS entries at a time
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + COUNTS, side="right")))
            m = many[done:upto]
            shift = self.begin[pair[done:upto]] - (np.cumsum(m) - m)
            entry = self.held[np.repeat(shift, m) + np.arange(int(m.sum()))]
            counts += np.bincount(np.repeat(piece[done:upto] * len(self.long), m) + entry, minlength=len(counts))
            done = upto
        return counts.reshape(pieces, len(self.long))

    def _in_order(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, keyword: np.ndarray) -> np.ndarray:
        """Whether the stretch of ``codes`` and the keyword have a common subsequence that is long enough; of more than 64 letters, always."""
        out = np.ones(len(begin), bool)
        if self.longest > 64:
            return out
        wide = -(-self.spelled.shape[1] // 8) * 8
        group = max(1, (1 << 22) // (2 * self.longest * wide))
        for first in range(0, len(begin), group):
            own = slice(first, first + group)
            n = int(size[own].max())
            index = begin[own] + np.arange(n)[:, None]
            letters = np.where(np.arange(n)[:, None] < size[own], codes[np.minimum(index, len(codes) - 1)], NO_LETTER - 1).astype(np.uint32)
            same = np.packbits(letters[:, :, None] == self.spelled[keyword[own]], axis=2, bitorder="little")
            bits = np.zeros((*same.shape[:2], 8), np.uint8)
            bits[:, :, : same.shape[2]] = same
            # Hyyro's recurrence: a zero bit for each letter of the subsequence
            held = np.full(bits.shape[1], ~np.uint64(0))
            for mask in bits.view("<u8")[:, :, 0]:
                hit = held & mask
                held = (held + hit) | (held - hit)
            out[own] = np.bitwise_count(~held) >= self.common[keyword[own]]
        return out


@lru_cache(maxsize=4)
def keywords(words: tuple[str, ...], least: float | None) -> Keywords:
    """The index of a process; workers that are used again don't build it again."""
    return Keywords(words, least)
