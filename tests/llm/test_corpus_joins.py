"""Operators 11 to 13: against brute force, their SQL and the tokenizers' own libraries, and their edge cases."""

import hashlib
import random
import sys
from collections import Counter
from itertools import accumulate

import duckdb
import public_tokenizers
import pytest

from tillroll.llm import op11_jaccard, op12_importance, op13_alignment
from tillroll.llm.common import written

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, node string, size string, rank string"


def table(spark, texts):
    """Documents of ``texts``, (doc_id, text), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "n", "s", "r") for i, t in texts], SCHEMA)


def equals_sql(spark, module, name, path=DATA):
    held = duckdb.connect()
    for t in ("documents", "benchmark"):
        held.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df, want = module.QUERIES[name](spark, path), held.sql(module.ORACLES[name])
    assert df.columns == want.columns
    return sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("module, name", [(op11_jaccard, "op11_jaccard"), (op12_importance, "op12_importance")])
def test_equals_sql(spark, module, name):
    assert equals_sql(spark, module, name)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in words).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts, percent):
    """What operator 11 has to return, from all pairs."""
    held, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(held)):
        for j in range(i):
            if held[i] and 100 * len(held[i] & held[j]) >= percent * len(held[i] | held[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, (doc, _) in enumerate(texts):
        groups.setdefault(top(i), []).append(doc)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(doc, len(held[i]), low[top(i)]) for i, (doc, _) in enumerate(texts)]


def variants(r, n, edits):
    """``n`` texts made from a few of different lengths by up to ``edits`` changed, added or dropped words; a passage is shared by all."""
    shared, word = " ".join(f"s{i}" for i in range(12)), lambda: f"w{r.randint(0, 400)}"
    bases = [[word() for _ in range(k)] for k in (8, 30, 60, 60, 200)]
    out = []
    for i in range(n):
        text = list(r.choice(bases))
        for _ in range(r.randint(0, edits)):
            at = r.randrange(len(text))
            text[at : at + r.randint(0, 1)] = [word()] * r.randint(0, 2)
        out.append((i * 7 % n, " ".join(text) + (f" {shared}" if r.random() < 0.5 else "")))
    return out


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 80), (3, 60)])
def test_jaccard_equals_all_pairs(spark, seed, percent):
    texts = variants(random.Random(seed), 260, 6)
    got = op11_jaccard.jaccard_components(table(spark, texts), percent=percent).collect()
    want = components(texts, percent)
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({c for *_, c in want}) > 20


def test_jaccard_off_the_star(spark):
    """A chain of texts, each near its neighbours only, and pairs whose common neighbour isn't near them."""
    r = random.Random(5)
    chain, text = [], [f"a{i}" for i in range(100)]
    for i in range(40):
        chain.append((i, " ".join(text)))
        text[(at := r.randrange(90)) : at + 2] = [f"b{i}", f"c{i}"]
    base = [f"x{i}" for i in range(100)]
    for i in range(20):
        far = base[: 75 + i % 3] + [f"y{i // 2}-{k}" for k in range(25)]
        chain += [(100 + 2 * i, " ".join(far)), (101 + 2 * i, " ".join([*far[:-1], f"z{i}"]))]
    got = op11_jaccard.jaccard_components(table(spark, chain)).collect()
    assert sorted(map(tuple, got)) == sorted(components(chain, 80))


def test_jaccard_salts_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(op11_jaccard, "SALT", 3)
    texts = variants(random.Random(8), 150, 9)
    assert sorted(map(tuple, op11_jaccard.jaccard_components(table(spark, texts)).collect())) == sorted(components(texts, 80))


def test_jaccard_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (5, "other words of the same number here"), (6, "a\x0bb"), (None, "a b"), (None, "none but this"), (7, long), (8, long + " end"), (8, long + " end"), (9, "a b c d e"), (10, "b\x00 é 漢")]
    got = sorted(map(repr, map(tuple, op11_jaccard.jaccard_components(table(spark, texts)).collect())))
    assert got == sorted(map(repr, components(texts, 80)))
    assert op11_jaccard.jaccard_components(table(spark, [])).count() == 0


def test_importance_edge_cases(spark):
    twenty = " ".join(["Word"] * 20)
    texts = [(1, None), (2, ""), (3, "?!"), (4, twenty), (4, twenty), (4, twenty), (None, twenty), (5, "a " * 30_000), (6, "é漢 b-c_d"), (7, twenty + " more")]
    target = spark.createDataFrame([("word word",), (None,)], "text string")
    rows = op12_importance.resample(table(spark, texts), target, percent=60).collect()
    assert sorted((r.doc_id or 0, r.n_features) for r in rows) == [(0, 20), (1, 0), (2, 0), (3, 0), (4, 20), (4, 20), (4, 20), (5, 30_000), (6, 4), (7, 21)]
    assert sorted(r.rank for r in rows if r.rank) == [1, 2, 3]
    assert all(r.weight == 0 for r in rows if not r.n_features)
    drawn = sorted((r for r in rows if r.n_features >= 20), key=lambda r: (-r.score, r.doc_id or 0))
    assert [r.rank for r in drawn] == [1, 2, 3, None, None, None]
    assert op12_importance.resample(table(spark, []), target).count() == 0
    assert op12_importance.resample(table(spark, texts), target.limit(0)).filter("rank IS NOT NULL").count() == 0
    two = op12_importance.resample(table(spark, [(1, "a b c")]), target, most=2).first()
    assert two.n_features == 5


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
def test_ranks_by_ranges(spark, range_rows):
    """Many ties, repeated rows and ranges of any size give the numbers of one sort."""
    r = random.Random(range_rows)
    rows = [(r.choice([None, *range(40)]), r.randint(-5, 30) * 10, r.random() < 0.8) for _ in range(700)]
    df, _ = written(spark.createDataFrame(rows, "doc_id bigint, score bigint, eligible boolean"), "rows")
    for n in (0, 1, 50, sum(e for *_, e in rows)):
        got = [(x.doc_id, x.score, x.rank) for x in op12_importance.ranked(df, n, range_rows=range_rows).collect()]
        order = sorted(((d, s) for d, s, e in rows if e), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:n]
        want = [(d, s, k + 1) for k, (d, s) in enumerate(order)]
        assert sorted((g for g in got if g[2]), key=lambda g: g[2]) == want
        assert Counter(g[:2] for g in got) == Counter((d, s) for d, s, _ in rows)


def files():
    out = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as file:
            out.append(file.read())
    return out


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def aligned(text, a, b):
    """(A's ids, B's ids, groups, links) of a text by comparing byte ranges, or None."""
    if not text:
        return None
    alphabet = op13_alignment.byte_alphabet()
    x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    spelled = [[bytes(alphabet[c] for c in a.id_to_token(i)) for i in x], [bytes.fromhex(p[3:-1]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, map(b.id_to_piece, y), strict=True)]]
    if any(b"".join(s) != f" {text}".encode() for s in spelled):
        return None
    ranges = []
    for s in spelled:
        ends = list(accumulate(map(len, s)))
        ranges.append(list(zip([0, *ends], ends, strict=False)))
    links = [(p, q) for p, (i, j) in zip(x, ranges[0], strict=True) for q, (k, m) in zip(y, ranges[1], strict=True) if i < m and k < j]
    cuts = [0, *sorted({j for _, j in ranges[0]} & {j for _, j in ranges[1]})]
    inside = lambda ids, r, i, j: ",".join(str(t) for t, (k, m) in zip(ids, r, strict=True) if i <= k and m <= j)
    groups = [f"{inside(x, ranges[0], i, j)}|{inside(y, ranges[1], i, j)}" for i, j in zip(cuts, cuts[1:], strict=False)]
    return x, y, groups, links


@pytest.mark.parametrize("top", [0, 40, 1 << 18])
def test_alignment_equals_ranges(spark, top):
    """With all, some or no counts sent to the tasks."""
    texts = [(r.doc_id, r.text[:300]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    texts += [(-1, None), (-2, ""), (-3, " "), (-4, "a▁b"), (-5, "<s> <|endoftext|> x\x00y é漢🙂\n\n  z"), (-5, "<s> twice"), (None, "ff ﬁ"), (None, None), (-6, "xyz" * 100), (-6, "xyz" * 100)]
    a, b = tokenizers()
    found = [(doc, aligned(t, a, b)) for doc, t in texts]
    count = Counter(p for _, x in found if x for p in set(x[3]))
    best = {}
    for (p, _), n in count.items():
        best[p] = max(n, best.get(p, 0))
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest()
    want = [(doc, len(x[0]), len(x[1]), len(x[2]), len(x[3]), digest(x[2]), ";".join(x[2]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3])) if x else (doc, 0, 0, 0, 0, "", "", 0, 0) for doc, x in found]
    rows, _ = written(op13_alignment.align(table(spark, texts), files()[0], public_tokenizers.PATTERN, files()[1], with_groups=True), "aligned")
    assert sorted(map(repr, map(tuple, op13_alignment.with_counts(rows, top).collect()))) == sorted(map(repr, want))


def test_alignment_of_nothing_and_of_long_texts(spark):
    run = lambda texts: op13_alignment.with_counts(written(op13_alignment.align(table(spark, texts), files()[0], public_tokenizers.PATTERN, files()[1]), "aligned")[0])
    assert run([]).count() == 0 and run([(1, None)]).first().n_links == 0
    row = run([(1, "word " * 300_000)]).first()
    assert row.n_a == 300_001 and row.n_links == row.n_a + row.n_b - row.n_groups


def test_encoder_of_the_json_file_on_all_code_points():
    a, _ = tokenizers()
    encode, held = op13_alignment.encoder_a(files()[0], public_tokenizers.PATTERN)
    for low in range(0, sys.maxunicode + 1, 1 << 16):
        texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}\n" for c in range(low, low + (1 << 16), 3) if not 0xD800 <= c < 0xE000]
        assert [e.ids for e in a.encode_batch(texts, add_special_tokens=False)] == [encode(t) for t in texts]
    with pytest.raises(ValueError):
        op13_alignment.encoder_a(b'{"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}}', public_tokenizers.PATTERN)
