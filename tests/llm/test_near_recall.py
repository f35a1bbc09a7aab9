"""Near-duplicates against all links of whole tables; hot shingles are split without a change of pairs."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import op09_probminhash as op9


def all_links(texts: dict[int, str]) -> tuple[list[tuple[int, int]], set[int]]:
    """Pairs of texts that share 0.8 or more of their 5-word shingles, each text against all; and the ids with words."""
    sets, holders = {}, {}
    for k, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        n = min(5, len(w))
        sets[k] = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for s in sets[k]:
            holders.setdefault(s, []).append(k)
    out = []
    for k, own in sets.items():
        shared = Counter(o for s in own for o in holders[s] if o > k)
        out += [(k, o) for o, n in shared.items() if n >= 0.8 * (len(own) + len(sets[o]) - n)]
    return out, {k for k, s in sets.items() if s}


@pytest.mark.parametrize("weight", ["set", "count"])
def test_links_of_a_whole_table(spark, weight):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    links, _ = all_links({r.doc_id: r.text for r in docs.collect()})
    of = {r.doc_id: r.class_id for r in op9.near_duplicates(docs, weight=weight).collect()}
    assert len(links) > 50
    found = [of[a] == of[b] for a, b in links]
    assert sum(found) >= 0.99 * len(found)
    asked = [of[a] == of[b] for a, b in links if a % 50 == 0 or b % 50 == 0]
    assert sum(asked) >= 0.9 * len(asked)


def test_split_shingles_give_the_same_pairs(spark):
    rng, rows = np.random.default_rng(3), []
    for node in range(120):  # a few shingles are in most sets
        own = np.unique(np.concatenate([rng.choice(40, 30, replace=False), rng.choice(10_000, 3)])).astype("<u4") * np.uint32(0x9E3779B1)
        rows.append((node, node % 7 if node < 60 else node, np.sort(own).tobytes(), b""))
    residue = spark.createDataFrame(rows, "node bigint, root bigint, elements binary, weights binary")
    pairs = {s: sorted(map(tuple, op9.off_star_pairs(residue, 0.6, s).collect())) for s in (2, 5, 4096)}
    assert len(pairs[4096]) > 100 and pairs[2] == pairs[5] == pairs[4096]


def test_counters_stay_small_in_the_driver(spark):
    rng = np.random.default_rng(5)
    held = [np.unique(rng.integers(0, 1 << 32, 200_000, np.uint32)) for _ in range(6)]
    held += [held[0], held[0][:7], np.zeros(0, np.uint32)]
    sets = spark.createDataFrame([(x.astype("<u4").tobytes(),) for x in held], "elements binary").repartition(3)
    tracemalloc.start()
    got = op9.frequencies(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, np.bincount(np.concatenate(held) >> np.uint32(32 - op9.COUNTERS), minlength=1 << op9.COUNTERS))
    assert (got > 0).sum() > 600_000  # rows of counters would take well over 100 MB here
    assert peak < 32 << 20
    assert not op9.frequencies(sets.filter("false")).any()
