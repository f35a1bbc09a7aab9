"""The ten operators against brute force, round trips and held-out accuracy, and their edge cases."""

import base64
import hashlib
import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tillroll.llm import op01_licenses, op02_decontaminate, op03_language, op04_spans, op05_bytebpe, op06_chat, op07_media, op08_warc, op09_probminhash, op10_extract
from tillroll.llm.common import scratch

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "é", "Hello world. " * 40, "Hello world. " * 40, "x" * 3000, "one two three four five six seven. " * 9]


def odd_docs(spark):
    rows = [(i, t, None if i % 2 else "en", "s", 0, "extra") for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 0, "extra"), (None, "b", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")


def small(spark, n=120):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").limit(n).collect()
    return {r.doc_id: r.text for r in rows}


def test_licenses(spark):
    texts = small(spark) | {-1: "x\nLicensed under the  APACHE license - version 2.0!\ny", -2: "Released under\nthe MIT License."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.matches for r in op01_licenses.scan(docs).collect()}
    for doc, text in texts.items():
        assert {n for n, _ in op01_licenses.brute_force(text)} <= {m.license for m in got[doc]}
        assert all(m.score >= 0.8 for m in got[doc])
    assert got[-1][0].license == "Apache-2.0" and {m.license for m in got[-2]} == {"MIT"}
    assert op01_licenses.scan(odd_docs(spark)).count() == len(ODD) + 2


def test_licenses_in_windows(spark):
    r, long = random.Random(6), {}
    short = [t for t in op01_licenses.TEMPLATES if len(t[2].split()) < 250]
    for name, _, text in short:
        if 60 < len(text.split()):
            long.setdefault(name, text)
    filler = lambda n: " ".join(r.choice("the of software license under is a by in red terms".split()) for _ in range(n))
    cases = {0: ("Licensed under the MIT License. See the License file for more details.", {"MIT"}), 1: ("Licensed under the MIT License. Licensed under CC BY 4.0.", {"MIT", "CC-BY-4.0"}), 2: (long["MIT"] + "\n" + long["ISC"], {"MIT", "ISC"})}
    for name, text in long.items():
        for cut in (0.2, 0.5, 0.8):
            w = text.split()
            k = int(len(w) * cut)
            w[k : k + 4] = ["alpha", "beta", "gamma", "delta"]
            w[len(w) // 2] += "\n"
            cases[len(cases)] = (f"{filler(40)}\n{' '.join(w)}\n{filler(40)}", {name})
    out = op01_licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id bigint, text string"))
    for row in out.collect():
        text, names = cases[row.doc_id]
        got = {m.license for m in row.matches}
        brute = op01_licenses.brute_windows(text, short)
        assert names == got <= set(brute), (text, got)
        assert all(0.8 <= m.score <= brute[m.license] + 1e-12 for m in row.matches)
    twice = op01_licenses.scan(spark.createDataFrame([(1, "x Licensed under the MIT License, y. " * 3)], "doc_id bigint, text string")).first().matches
    assert [m.unit for m in twice].count("window") == 3


def test_licenses_are_the_best_of_overlapping_ones():
    held = op01_licenses.Templates(op01_licenses.TEMPLATES)
    texts = [f"one two\n{text}\nthree" for _, _, text in op01_licenses.TEMPLATES] + [op01_licenses.TEMPLATES[4][2].replace("THE SOFTWARE IS", "Licensed under CC BY 4.0. THE SOFTWARE IS")]
    got = [{m["license"] for m in x} for x in op01_licenses.scan_batch(pa.array(texts), held, 0.8)]
    assert got == [{name} for name, _, _ in op01_licenses.TEMPLATES] + [{"MIT", "CC-BY-4.0"}]
    assert {"BSD-3-Clause", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "Unlicense", "Zlib", "EPL-2.0", "GPL-3.0-only"} <= set().union(*got)


def test_decontamination(spark):
    docs, items = small(spark, 60), {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(12).collect()} | {98: "", 99: "Tiny Item"}
    some = list(items.values())
    docs |= {-1: f"start {some[0]} end", -2: some[1].upper(), -3: "tiny ITEM!", -4: None, -5: "tiny", -6: some[0] + some[1]}
    want = op02_decontaminate.brute_force(docs, items)
    for block in (10**6, 200):
        out = op02_decontaminate.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string"), block=block)
        got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect()}
        assert got == want
    nulls = spark.createDataFrame([(None, some[0]), (None, "none of it"), (3, some[0])], "doc_id bigint, text string")
    for block in (10**6, 200):
        out = op02_decontaminate.decontaminate(nulls, spark.createDataFrame(list(items.items()), "item_id bigint, text string"), block=block).collect()
        assert sorted((r.doc_id or 0, r.contaminated) for r in out) == [(0, False), (0, True), (3, True)]
    assert op02_decontaminate.decontaminate(nulls, spark.createDataFrame([], "item_id bigint, text string")).filter("contaminated").count() == 0


def test_decontamination_of_repetitive_texts(spark):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["a", "b", "Cc"]) for _ in range(n))
    docs, items = {i: text(r.randint(0, 120)) for i in range(60)}, {i: text(r.choice([0, 1, 2, 3, 5, 9, 14, 30])) for i in range(20)}
    items |= {100: items[3], 101: docs[1][:40], 102: docs[2], 103: docs[3].upper()}
    want = op02_decontaminate.brute_force(docs, items)
    out = op02_decontaminate.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect()} == want


def test_windows_of_a_whole_block_are_cheap():
    import time

    r = random.Random(1)
    pool = [f"w{i}" for i in range(50_000)]
    rows = [(i, " ".join(r.choices(pool, k=150))) for i in range(4500)]
    begin = time.time()
    found = op02_decontaminate.windows_of(rows, 13)
    assert len(found.first) == 4500 * 138 and time.time() - begin < 30


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op03_language.op3_language(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    model = op03_language.learn(docs)
    got = {(r.doc_id): (r.lang_pred, r.score) for r in op03_language.predict(odd_docs(spark), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[4][0] in model.labels
    assert op03_language.predict(odd_docs(spark).limit(0), op03_language.learn(docs.limit(0))).count() == 0


def test_repeated_spans(spark):
    passage = "First here is a sentence with words enough. Then another one follows it with some more words. Last comes a third sentence that ends it all."
    texts = {1: f"Own start one.\n{passage}\nOwn end.", 2: f"Something else. {passage} And more.", 3: passage, 4: "short. short. short.", 5: None, 6: ""}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id bigint, text string, removed_words string")
    got = {r.doc_id: r for r in op04_spans.deduplicate(docs).collect()}
    assert got[1].text == texts[1] and got[2].text == "Something else. And more." and got[3].text == "" and got[4].text == texts[4] and got[5].text is None
    assert got[3].removed == [passage] and op04_spans.deduplicate(odd_docs(spark)).count() == len(ODD) + 2


def brute_spans(rows, least=20, sentences=2):
    """Texts after removal, by comparing all runs of sentences with the places before them."""
    import re

    order, split = sorted({r for r in rows if r[0] is not None and r[1]}), {}
    for doc, text in order:
        cuts, parts = [0, *(m.end() for m in re.finditer(r"[.!?][\"')\]]*\s+|\n\s*", text) if m.end() < len(text))], []
        for i, j in zip(cuts, [*cuts[1:], len(text)]):
            found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text[i:j]))
            if found:
                parts.append([i, j, found])
            elif parts:
                parts[-1][1] = j
        split[doc, text] = parts
    runs = []
    for (doc, text), parts in split.items():
        for i in range(len(parts)):
            for e in range(i + sentences, len(parts) + 1):
                words = sum((p[2] for p in parts[i:e]), [])
                if len(words) >= least and (e == i + sentences or len(words) - len(parts[e - 1][2]) < least or len(words) - len(parts[i][2]) < least):
                    runs.append((doc, text, i, e, tuple(words)))
    return order, split, runs


def test_repeated_spans_by_brute_force(spark):
    r = random.Random(11)
    pool = [" ".join(r.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(r.randint(2, 12))) + "." for _ in range(14)]
    rows = [(d, " ".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for d in range(60)]
    got = {(x.doc_id, x.was): (x.text, x.removed) for x in op04_spans.deduplicate(spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id bigint, text string, was string")).collect()}
    order, split, runs = brute_spans(rows)
    first, covered = {}, set()
    for doc, text, i, e, words in sorted(runs, key=lambda x: (x[0], split[x[0], x[1]][x[2]][0])):
        if first.setdefault(words, (doc, i)) != (doc, i):
            covered |= {(doc, text, k) for k in range(i, e)}
    assert covered
    for doc, text in order:
        keep = "".join(text[a:b] for k, (a, b, _) in enumerate(split[doc, text]) if (doc, text, k) not in covered)
        assert got[doc, text][0] == keep


def test_repeated_spans_of_one_doc_id_and_clashing_names(spark):
    passage = "First here is a sentence with words enough. Then another one follows it with some more words. Last comes a third sentence that ends it all."
    rows = [(5, "Own line here. " + passage, "x", 1), (5, "x" + "é" * 400, "x", 1), (7, passage, "x", 1), (None, passage, "x", 1), (7, passage, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, cuts string, key int").withColumnRenamed("key", "o`dd").withColumn("begin", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit(3))
    out = op04_spans.deduplicate(docs)
    assert out.columns == [*docs.columns, "removed"]
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert got == sorted([(0, passage), (5, rows[0][1]), (5, rows[1][1]), (7, ""), (7, "")])
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi."
    alone = op04_spans.deduplicate(spark.createDataFrame([(1, long), (2, long)], "doc_id bigint, text string")).collect()
    assert all(r.text == long for r in alone)  # one sentence is no run of several
    assert op04_spans.deduplicate(docs.limit(0)).count() == 0


def test_hot_spans(spark, monkeypatch):
    monkeypatch.setattr(op04_spans, "FEW", 3)
    monkeypatch.setattr(op04_spans, "HOT", 1 << 16)
    passage = "First here is a sentence with words enough. Then another one follows it with some more words than the first one has."
    docs = spark.createDataFrame([(i, f"Own{i} line. {passage}" + " Rare words stand here and nowhere else but once more in a text that is the next one. So it is." * (i < 2)) for i in range(30)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in op04_spans.deduplicate(docs).collect()}
    assert got[0].endswith("So it is.") and got[1] == "Own1 line. " and all(got[i] == f"Own{i} line. " for i in range(2, 30))


def test_bpe(spark):
    raw = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*small(spark).values(), "á 你好 \x1c x \n\n  y '’s'LL I'll 12²٣ 😀", " \n a", "=" * 400, *(t for t in ODD if t)]
    coder = op05_bytebpe.Encoder(raw, public_tokenizers.PATTERN)
    for text in texts:
        ids = coder.encode(text)
        assert ids == want.encode_ordinary(text) and coder.decode(ids) == text.encode()
    out = op05_bytebpe.encode_documents(odd_docs(spark), raw, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == len(ODD) + 2 and next(r for r in out if r.doc_id == 0).n_tokens == 0
    r, table = random.Random(5), op05_bytebpe.PrefixTable(coder.pairs)
    for _ in range(30):
        new = bytes(r.choice(b"theonaing ") for _ in range(r.randint(0, 6)))
        if r.random() < 0.5:
            table.append(new)
        else:
            a = r.randint(0, len(table.piece))
            table.replace(a, min(len(table.piece), a + r.randint(0, 4)), new)
        assert table.ids() == op05_bytebpe.PrefixTable(coder.pairs, table.piece).ids() == coder.pairs.merged(table.piece)


def brute_cost(roles):
    """The least cost of a repair, from the rules as the docstring has them and not from the operator's tables."""
    legal = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, cost in list(best.items()):
                for role in set(legal[state]) - {"system"}:
                    best[role] = min(best.get(role, 10**9), cost + 2)
        return best

    best = {"": 0}
    for role in roles:
        change = 3 if role in legal else 1
        new = {}
        for state, cost in inserted(best).items():
            for to in legal[state]:
                new[to] = min(new.get(to, 10**9), cost + (0 if to == role else change))
            if state:  # into the turn before
                new[state] = min(new.get(state, 10**9), cost + 1 + (0 if state == role else change))
        best = new
    return inserted(best)["assistant"]


def test_chat(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["hi", "", None, "<|im_end|>"])) for c in range(20) for t in range(r.randint(1, 9))]
    rows += [(99, t, r.choice(["user", "assistant"]), f"t{t}") for t in range(400)] + [(None, 1, "user", "x"), (99, 5, "user", "t5"), (99, 5, "user", "t5")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    by = {}
    for row in op06_chat.format_chats(turns).orderBy("place").collect():
        by.setdefault(row.conv_id, []).append(row)
    assert sum(map(len, by.values())) == len(rows)
    for conv in by.values():
        roles = [x.role for x in conv]
        text = "".join(x.segment for x in conv)
        found = [line for part in text.split("<|im_start|>")[1:] for line in [part.split("\n")[0]]]
        body = found[1:] if found[0] == "system" else found
        assert body == ["user", "assistant"] * (len(body) // 2) and body and text.count("<|im_end|>") == len(found)
        final = op06_chat.CLOSING[1 + op06_chat.ROLES.index(conv[-1].new_role)]
        assert sum(x.cost for x in conv) + 2 * len(final) == brute_cost(roles)
    assert op06_chat.format_chats(turns.limit(0)).count() == 0


def test_media(spark):
    folder = scratch(spark, "media")
    docs = odd_docs(spark)
    rows = op07_media.addressed(op07_media.store(docs, folder))
    got = op07_media.with_payload(rows, folder).collect()
    texts = dict(enumerate(ODD)) | {None: "b"}
    for r in got:
        payload = op07_media.padded((texts[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.digest == r.read_digest and r.feature == op07_media.feature(payload)
    assert len(got) == len(ODD) + 2 and len({(r.shard, r.offset) for r in got}) == len({r.digest for r in got})
    assert {(r.width, r.bits) for r in op07_media.with_header(rows, folder).collect()} == {(64, 8)}


def test_warc(spark):
    folder = scratch(spark, "warc")
    rows = [(1, "u", "<p>a"), (2, "u2", "<p>a"), (3, None, None), (4, "u\r\nx: y", "<p>b\r\n\r\nc"), (5, "u", "")]
    got = op08_warc.read_archives(op08_warc.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), folder), folder, payloads=True).collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got} == {("1", "response", None, 4), ("2", "revisit", "1", 4), ("3", "response", None, 0), ("4", "response", None, 9), ("5", "revisit", "3", 0)}
    r = random.Random(9)
    pages = [(i, "u", r.choice([None, "", "a", "b", "é" * 9, f"own {i}"])) for i in range(60)]
    firsts, want = {}, set()
    for i, _, html in pages:
        data = (html or "").encode()
        first = firsts.setdefault(data, i)
        want.add((str(i), "response" if first == i else "revisit", None if first == i else str(first), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()))
    folder = scratch(spark, "warc")
    got = op08_warc.read_archives(op08_warc.archive(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5), folder), folder).collect()
    assert {(x.page_id, x.record_type, x.refers_to, x.payload_bytes, x.payload_digest) for x in got} == want and len(got) == 60
    twice = [(1, "u", "<p>a"), (1, "u", "<p>a"), (1, None, "<p>a"), (1, None, "<p>a"), (1, "v", "b"), (2, "u", "<p>a"), (None, "u", "<p>a")]
    folder = scratch(spark, "warc")
    got = op08_warc.read_archives(op08_warc.archive(spark.createDataFrame(twice, "page_id bigint, url string, html string").repartition(3), folder), folder, strict=True).collect()
    assert sorted(map(str, ((x.page_id, x.record_type, x.refers_to) for x in got))) == sorted(map(str, [("1", "response", None), ("1", "response", None), *[("1", "revisit", "1")] * 3, ("2", "revisit", "1"), (None, "revisit", "1")]))
    bodies = [b"body %d " % i * 50 for i in range(6)]
    plain = [op08_warc.page_record(i, "u", b, len(b), op08_warc.digest(b), None) for i, b in enumerate(bodies)]
    for packed in ([op08_warc.member(p) for p in plain], plain):
        data = bytearray(b"".join(packed))
        hurt = len(packed[0]) + len(packed[1]) // 2
        data[hurt] ^= 0xFF
        records, gaps = op08_warc.salvage(bytes(data[: -len(packed[5]) // 2]))
        assert [f["x-page-id"] for _, f, _ in records] == ["0", "2", "3", "4"]
        assert gaps[0][:2] == (len(packed[0]), len(packed[0]) + len(packed[1])) and len(gaps) == 2


def test_near_duplicates(spark):
    texts = small(spark, 60)
    long = next(t for t in texts.values() if len(t) > 1200)
    words = long.split()
    texts |= {9001: long, 9002: " ".join(words[:50] + ["changed"] + words[51:]), 9003: "".join(c.upper() if c.isascii() else c for c in long), 9004: "", 9005: None, 9006: None, 9007: "two words", 9008: "two, words", 9009: "!!", 9010: "!!"}
    got = {r.doc_id: r.class_id for r in op09_probminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else None
    for a in texts:
        for b in texts:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b]):
                assert got[a] == got[b]
    assert got[9001] == got[9002] == got[9003] and got[9005] != got[9006] and got[9007] == got[9008] and got[9009] == got[9010] != got[9004]
    assert op09_probminhash.near_duplicates(odd_docs(spark)).count() == len(ODD) + 2


def test_near_duplicates_of_short_texts(spark):
    r, texts = random.Random(4), {}
    for family in range(200):
        size, base = r.choice([8, 8, 10, 12, 16]), [f"w{family}x{i}" for i in range(54)]
        for i in range(4):
            texts[family * 10 + i] = " ".join(base[: size + 4])
            size = min(50, size * 5 // 4)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in texts.items())}
    close = [(a, b) for a in texts for b in texts if a < b and a // 10 == b // 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(len(sets[a] & sets[b]) <= 0.88 * len(sets[a] | sets[b]) for a, b in close) > 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    root = {k: k for k in texts}
    for a, b in close:
        root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    least = {}
    for k, v in sorted(root.items()):
        least.setdefault(v, k)
    assert {x.doc_id: x.class_id for x in op09_probminhash.near_duplicates(docs).collect()} == {k: least[v] for k, v in root.items()}


def test_extraction():
    field = op10_extract.default_field()
    right = total = 0
    for page, main in op10_extract.labelled_pages(100, 5):
        features, labels = op10_extract.labels_of(page, main)
        right += sum(a == b for a, b in zip(field.viterbi([field.score(f) for f in features]), labels))
        total += len(labels)
    assert right >= 0.97 * total
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three.</p></article><footer>&copy; x</footer></body></html>"
    assert op10_extract.extract_text(page, field) == "A & B\nOne two.\nThree."
    assert op10_extract.extract_text(None, field) == op10_extract.extract_text("", field) == ""
    for broken in ("<", "<p", "a < b", "<div><p>x", "</p></p>x", "<!-- x", "<script>", "<a href='x>y"):
        op10_extract.extract_text(broken, field)


def test_extraction_of_unclosed_elements():
    field = op10_extract.default_field()
    for part in (
        "<datalist id=d><option value=a><option value=b></datalist>", "<select><option>a<optgroup label=x><option>b</select>", "<button>x", "<object data=x>", "<canvas>", "<video src=x>", "<svg><path d=x>",
        "<button><p>x</p></button>", "<select><option>a<select>", "<template><div><p>x</div></template>", "<object data=x><object data=y>z</object>", "<button>x<button>y</button>", "<canvas><ul><li>x",
    ):
        page = f"<html><head><title>T</title><body><div class=search>{part}</div><article><h1>Title here</h1><p>Long <button><div>no</div></button> prose stands here.<p>It has an end.</article><div class=ad><video></video><object></object></div>"
        assert op10_extract.extract_text(page, field) == "Title here\nLong prose stands here.\nIt has an end.", part
    for rest in ("<p>x</p><script>y", "<p>x</p><style>y", "<p>x</p><textarea>y"):
        assert [t for t, _ in op10_extract.blocks(rest)] == ["x"]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 100 and all(len(r.ids) == r.n_tokens for r in rows)
    assert corpus_pipeline.language(spark, odd_docs(spark), DATA).columns == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("k", [1, 5])
def test_word_hashes_are_those_of_words(k):
    from tillroll.llm.wordhash import shingles, words

    found = words(pa.array(["A b c", None, "a B c d", "é9 x"]))
    assert found.row.tolist() == [0, 0, 0, 2, 2, 2, 2, 3, 3]
    assert found.hash[:3].tolist() == found.hash[3:6].tolist()
    assert all(found.row[i] == found.row[i + k - 1] for i in shingles(found, k)[0])
