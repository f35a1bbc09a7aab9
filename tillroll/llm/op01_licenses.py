"""Operator 1: licence scan by Dice coefficient over word bigrams.

Units of a text are its whole, each of its lines, and every window of consecutive words (so a notice
wrapped over lines, or inside a longer line, is found wherever it begins and ends).  A best window
begins and ends with a bigram of the template, so only such ones are compared; of overlapping windows
of one licence that which shares most bigrams is reported, then the next one that is free of it.  A unit's normalised words are lower-cased runs of letters and
digits.  Its set of bigrams is compared with each template's whose size fits: a Dice coefficient d
needs sizes between d/(2-d) and (2-d)/d of each other; a template that shares no bigram is never
looked at.  All bigrams of all texts are looked up at once as hashes; the few shared ones are
compared as words.

Edge cases: null and empty texts and texts of one word have no unit; equal units of one text are reported once for each place
(window, line or whole), windows first; of templates of one licence the best counts.
A match is left out where an overlapping one of another licence shares more bigrams with its template, among them
``DICE`` of those of the match (a GPL template fits an LGPL notice too).
Repeated rows give repeated matches.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces
from tillroll.llm.license_templates import TEMPLATES
from tillroll.llm.wordhash import LOWER, one_run, words

DICE = 0.8
_MATCH = pa.struct({"license": pa.string(), "kind": pa.string(), "score": pa.float64(), "unit": pa.string(), "begin": pa.int64(), "end": pa.int64()})


def bigrams(found: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(found, found[1:]))


class Templates:
    def __init__(self, templates: list[tuple[str, str, str]]) -> None:
        self.names = [(a, b) for a, b, _ in templates]
        split = words(pa.array([t for _, _, t in templates], pa.string()))
        low, bounds = LOWER[split.data].tobytes(), split.bounds()
        self.sets = [bigrams([low[split.begin[j] : split.end[j]] for j in range(bounds[i], bounds[i + 1])]) for i in range(len(templates))]
        holders: dict[int, list[int]] = {}
        for i in range(len(templates)):
            for h in {one_run(split.hash[j : j + 2]) for j in range(bounds[i], bounds[i + 1] - 1)}:
                holders.setdefault(h, []).append(i)
        self.hashes = np.array(sorted(holders), np.uint64)
        self.holders = [holders[int(h)] for h in self.hashes]
        self.sizes = np.array([len(x) for x in self.sets])
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in self.holders])]).astype(np.int64)
        self.flat = np.concatenate([np.array(x, np.int64) for x in self.holders])
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def best(self, unit: list[bytes], likely: set[int], least: float) -> list[tuple[float, int]]:
        """(score, template) of the templates within the size bounds that reach ``least``."""
        own, out = bigrams(unit), []
        for i in likely:
            size = len(self.sets[i])
            if least * len(own) <= (2 - least) * size and least * size <= (2 - least) * len(own):
                score = 2 * len(own & self.sets[i]) / (len(own) + size)
                if score >= least:
                    out.append((score, i))
        return out


class Hits:
    """The places in one text of one template's bigrams.

    ``before`` has for each bigram of the text the place of its last equal one (-1 for none), ``fresh`` the
    number of those without one; ``at`` are the places of the template's ``size`` bigrams.
    """

    def __init__(self, before: np.ndarray, fresh: np.ndarray, at: np.ndarray, size: int, least: float) -> None:
        self.before, self.at, self.size, self.least = before, at, size, least
        self.all = int((before[at] < 0).sum())
        self.most = (2 - least) / least * size + 1e-9
        need = math.ceil(least / (2 - least) * size - 1e-9)
        ends = at[need - 1 :]
        self.starts = np.flatnonzero(fresh[ends] - fresh[at[: len(ends)]] <= self.most).tolist() if self.all >= need else []

    def best(self, i: int, limit: int) -> tuple[int, float, int, int] | None:
        """(shared bigrams, score, begin, end) of the best window from hit ``i`` that ends before word ``limit``."""
        begin, span = int(self.at[i]), int(2 * self.most) + 2
        last = int(np.searchsorted(self.at, limit - 1))
        if last <= i:
            return None
        while True:
            stop = min(last, int(np.searchsorted(self.at, begin + span)))
            ends = self.at[i:stop]
            own = np.cumsum(self.before[begin : ends[-1] + 1] < begin)[ends - begin]
            shared = np.cumsum(self.before[ends] < begin)
            if stop == last or own[-1] > self.most or shared[-1] == self.all:
                break
            span *= 2
        score = 2 * shared / (own + self.size)
        j = int(score.argmax())
        return (int(shared[j]), float(score[j]), begin, int(ends[j]) + 2) if score[j] >= self.least else None


def windows(hits: list[tuple[int, Hits]], end: int) -> list[tuple[float, int, int, int]]:
    """(score, begin, end, template) of the best windows of one licence's templates that have no word in common."""
    heap = []

    def push(i: int, k: int, limit: int) -> None:
        if found := hits[k][1].best(i, limit):
            shared, score, begin, stop = found
            heapq.heappush(heap, (-shared, -score, begin, stop, k, i))

    for k, (_, held) in enumerate(hits):
        for i in held.starts:
            push(i, k, end)
    taken: list[tuple[int, int]] = []
    out = []
    while heap:
        _, score, begin, stop, k, i = heapq.heappop(heap)
        at = bisect_right(taken, (begin, end + 1))
        if at and taken[at - 1][1] > begin:
            continue
        if at < len(taken) and taken[at][0] < stop:
            push(i, k, taken[at][0])
            continue
        insort(taken, (begin, stop))
        out.append((-score, begin, stop, hits[k][0]))
    return sorted(out, key=lambda x: x[1])


def _windows_of(row_hashes: np.ndarray, at: np.ndarray, template: np.ndarray, held: Templates, least: float) -> list[tuple[float, int, int, int]]:
    """:func:`windows` of each licence in one text, from its bigrams and from the (place, template) of its hits."""
    order = np.argsort(row_hashes, kind="stable")
    before = np.full(len(order), -1, np.int64)
    same = row_hashes[order[1:]] == row_hashes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    fresh = np.cumsum(before < 0)
    by: dict[str, list[tuple[int, Hits]]] = {}
    order = np.argsort(template, kind="stable")
    cuts = np.flatnonzero(np.diff(template[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        t = int(template[order[a]])
        by.setdefault(held.names[t][0], []).append((t, Hits(before, fresh, at[order[a:b]], int(held.sizes[t]), least)))
    return [x for name in sorted(by) for x in windows(by[name], len(row_hashes) + 1)]


def _best_of_overlapping(found: list[tuple[int, int, int]], text: list[bytes], low: int, held: Templates, least: float) -> list[bool]:
    """Whether each match (begin, end, template) is kept beside the overlapping ones of other licences."""
    shared = [bigrams(text[a - low : b - low]) & held.sets[t] for a, b, t in found]
    rank = [(len(x), len(x) / (b - a)) for x, (a, b, _) in zip(shared, found, strict=True)]
    order = sorted(range(len(found)), key=lambda k: found[k][:2])
    rivals: dict[int, list[int]] = {}
    for n, x in enumerate(order):
        for y in order[n + 1 :]:
            if found[y][0] >= found[x][1]:
                break
            if held.names[found[x][2]][0] != held.names[found[y][2]][0] and rank[x] != rank[y]:
                worse, better = sorted((x, y), key=rank.__getitem__)
                rivals.setdefault(worse, []).append(better)
    keep = [True] * len(found)
    for x in sorted(rivals, key=rank.__getitem__, reverse=True):
        for y in rivals[x]:
            begin, end = max(found[x][0], found[y][0]), min(found[x][1], found[y][1])
            if keep[y] and len(bigrams(text[begin - low : end - low]) & shared[x] & shared[y]) >= least * len(shared[x]):
                keep[x] = False
                break
    return keep


def scan_batch(column: pa.Array, held: Templates, least: float) -> list[list[dict]]:
    """The matches of each text."""
    split = words(column)
    out: list[list[dict]] = [[] for _ in range(len(column))]
    n = len(split.hash)
    if n < 2:
        return out
    from tillroll.llm.wordhash import shingles

    at, hashes = shingles(split, 2)
    near = np.flatnonzero(held.filter[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(held.hashes, hashes[near]), len(held.hashes) - 1)
    same = held.hashes[place] == hashes[near]
    hit, place = at[near[same]], place[same]
    if not len(hit):
        return out
    bounds, base, raw = split.bounds(), split.offsets, split.data
    breaks = np.flatnonzero(raw == 10)
    low = LOWER[raw].tobytes()
    count = held.first[place + 1] - held.first[place]
    which = np.repeat(np.arange(len(hit)), count)
    template = held.flat[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(held.first[place], count)]
    # a text with fewer hits than the least number of shared bigrams has no window of that template
    key, back, times = np.unique(split.row[hit[which]] * len(held.sizes) + template, return_inverse=True, return_counts=True)
    enough = times >= least / (2 - least) * held.sizes[key % len(held.sizes)] - 1e-9
    live = np.flatnonzero(enough[back])
    rows = split.row[hit[which[live]]]
    told: set[tuple[int, int, int, str]] = set()
    places: dict[int, list[tuple[int, int, int]]] = {}

    def tell(row: int, kind: str, score: float, i: int, first: int, last: int) -> None:
        name, template_kind = held.names[i]
        if (row, first, last, name) not in told:
            told.add((row, first, last, name))
            places.setdefault(row, []).append((first, last, i))
            out[row].append({"license": name, "kind": template_kind, "score": score, "unit": kind, "begin": int(split.begin[first] - base[row]), "end": int(split.end[last - 1] - base[row])})

    cuts = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        row, some = int(rows[a]), live[a:b]
        low_word = int(bounds[row])
        mine = hashes[np.searchsorted(at, low_word) : np.searchsorted(at, bounds[row + 1])]
        for score, first, last, i in _windows_of(mine, hit[which[some]] - low_word, template[some], held, least):
            tell(row, "window", score, i, low_word + first, low_word + last)

    units: dict[tuple[int, int, int], tuple[str, set]] = {}

    def unit(kind: str, row: int, first: int, last: int, likely: set) -> None:
        known = units.setdefault((row, first, last), (kind, set()))
        known[1].update(likely)

    line_row, line_end, first = -1, 0, 0
    for place_, word in zip(place.tolist(), hit.tolist(), strict=True):
        row, likely = int(split.row[word]), set(held.holders[place_])
        unit("text", row, int(bounds[row]), int(bounds[row + 1]), likely)
        if row != line_row or word >= line_end:
            edge = np.searchsorted(breaks, split.begin[word])
            begin = max(base[row], breaks[edge - 1] + 1 if edge else 0)
            end = min(base[row + 1], breaks[edge] if edge < len(breaks) else len(raw))
            line_row, first, line_end = row, int(np.searchsorted(split.begin, begin)), int(np.searchsorted(split.begin, end))
        unit("line", row, first, line_end, likely)
    longest = max(map(len, held.sets)) * (2 - least) / least
    for (row, first, last), (kind, likely) in sorted(units.items()):
        # distinct bigrams may be fewer than words, so only units of very many words need the count
        if last - first > 50 * longest:
            distinct = len(np.unique(hashes[np.searchsorted(at, first) : np.searchsorted(at, last - 1)]))
            if distinct > longest:
                continue
        found = held.best([low[split.begin[j] : split.end[j]] for j in range(first, last)], likely, least)
        best: dict[str, tuple[float, int]] = {}
        for score, i in found:
            name = held.names[i][0]
            if name not in best or (score, -i) > (best[name][0], -best[name][1]):
                best[name] = score, i
        for name, (score, i) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
            tell(row, kind, score, i, first, last)
    for row, found in places.items():
        if len({m["license"] for m in out[row]}) > 1:
            keep = _best_of_overlapping(found, [low[a:b] for a, b in zip(split.begin[bounds[row] : bounds[row + 1]], split.end[bounds[row] : bounds[row + 1]], strict=True)], int(bounds[row]), held, least)
            out[row] = [m for m, kept in zip(out[row], keep, strict=True) if kept]
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, *, least: float = DICE) -> DataFrame:
    """(doc_id, matches) of each row; ``begin`` and ``end`` of a match are byte offsets in the text.  Narrow."""
    held = Templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scan_batch(part.column("text"), held, least), pa.list_(_MATCH))], ["doc_id", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, matches array<struct<license:string,kind:string,score:double,unit:string,begin:bigint,end:bigint>>")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its licences with their best scores, and the places."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license)))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(names, ",").alias("licenses"), best.alias("best_score"), "matches")


def brute_force(text: str | None, templates: list[tuple[str, str, str]] = TEMPLATES, least: float = DICE) -> set[tuple[str, str]]:
    """(licence, unit) of lines and whole text, by comparing each with each template."""
    import re

    def split(part):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in part))

    out = set()
    lines = (text or "").split("\n")
    others = [(name, set(zip(found, found[1:]))) for name, _, template in templates for found in [split(template)]]
    for kind, part in [("text", text or ""), *(("line", line) for line in lines if len(lines) > 1)]:
        own = set(zip(split(part), split(part)[1:]))
        for name, other in others:
            if own and 2 * len(own & other) / (len(own) + len(other)) >= least:
                out.add((name, part))
    return out


def brute_windows(text: str, templates: list[tuple[str, str, str]] = TEMPLATES, least: float = DICE) -> dict[str, float]:
    """Each licence that any window of words reaches, with the best score of all windows."""
    held, out = Templates(templates), {}
    split = words(pa.array([text], pa.string()))
    low = LOWER[split.data].tobytes()
    found = [low[a:b] for a, b in zip(split.begin, split.end, strict=True)]
    for (name, _), other in zip(held.names, held.sets, strict=True):
        for i in range(len(found)):
            own, shared = set(), 0
            for pair in zip(found[i:], found[i + 1 :]):
                shared += pair in other and pair not in own
                own.add(pair)
                if least * len(own) > (2 - least) * len(other):
                    break
                if (score := 2 * shared / (len(own) + len(other))) >= least:
                    out[name] = max(score, out.get(name, 0.0))
    return out


QUERIES = {"op1_licenses": op1_licenses}
ORACLES: dict[str, str] = {}
