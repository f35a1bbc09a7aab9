"""What the stages of the corpus pipeline take away and keep; pages and archives in bad shape."""

import hashlib
import time

import pytest

from tillroll.llm import op02_decontaminate, op08_warc, op10_extract


def test_clean_by_text_not_by_id(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(5, f"before {item} after"), (5, "a clean text of the same id"), (None, f"x {item}"), (None, "clean without an id"), (6, f"before {item} after"), (7, None), (8, ""), (5, f"before {item} after")]
    df = spark.createDataFrame([(i, t, "d") for i, t in docs], "doc_id bigint, text string, digest string")
    for items, block in (([item], 1 << 22), ([item, "other " * 20, "third " * 30], 10)):
        benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
        left = op02_decontaminate.clean(df, benchmark, block=block)
        assert left.columns == df.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "clean without an id"), (5, "a clean text of the same id"), (7, ""), (8, "")]
    assert op02_decontaminate.clean(df.limit(0), benchmark).count() == 0 and op02_decontaminate.clean(df, benchmark.limit(0)).count() == len(docs)


@pytest.mark.parametrize("piece, tail", [("<div>", ""), ("<div class=x>t", ""), ("a<b ", ""), ("<a ", ""), ("<a \">\" ", ""), ("<iframe/>x", ""), ("<head>", "</head>"), ("</script", ">"), ("<p>a<table>", ""), ("<ul><li>x", ""), ("<select><option>", ""), ("<b>", "</i>" * 99_999)])
def test_a_page_of_one_megabyte_is_read_in_linear_time(piece, tail):
    field, took = op10_extract.default_field(), []
    for n in (100_000, 1_000_000):
        begin = time.process_time()
        op10_extract.extract_text(piece * (n // len(piece)) + tail, field)
        took.append(time.process_time() - begin)
    assert took[1] < 15 and took[1] < 30 * max(took[0], 0.05)


def test_formulas_stay_and_scores_are_sums_over_distinct_features():
    page = "<body><article class='post post'><p>Let <math><mi>x</mi></math> be <svg><text>no</text></svg> one.<div class='post ad'>b"
    assert [t for t, _ in op10_extract.blocks(page)] == ["Let x be one.", "b"]
    field = op10_extract.default_field()
    for (text, _, node), own, (_, features) in zip(found := op10_extract._leaves(page), op10_extract._own(found), op10_extract.blocks(page), strict=True):
        assert len(set(features)) == len(features)
        assert abs(field.score(features) - field.score(own) - node.score(field.weights)) < 1e-9


def page(i, body, block_digest=None, folded=False):
    fields = {"WARC-Type": "resource", "X-Page-ID": str(i)} | ({"WARC-Block-Digest": block_digest} if block_digest else {})
    made = op08_warc.record(fields, body)
    return made.replace(b"X-Page-ID: ", b"X-Note: one\r\n two\r\n\tthree\r\nX-Page-ID: ") if folded else made


def test_salvage_keeps_sound_records():
    body = b"some body"
    digests = [f"sha256:{hashlib.sha256(body).hexdigest()}", f"MD5:{hashlib.md5(body).hexdigest().upper()}", f"sha1:{hashlib.sha1(body).hexdigest()}", f"sha1:{op08_warc.digest(body).lower()}", "crc99:whatever", None]
    data = b"".join(page(i, body, d, folded=i % 2 == 0) for i, d in enumerate(digests))
    for whole in (data, op08_warc.member(data)):
        records, gaps = op08_warc.salvage(whole)
        assert [f["x-page-id"] for _, f, _ in records] == list("012345") and not gaps and records[0][1]["x-note"] == "one two three"
    wrong = [f"sha256:{'0' * 64}", f"md5:{'0' * 32}", f"sha1:{'A' * 32}"]
    records, gaps = op08_warc.salvage(b"".join(page(i, body, d) for i, d in enumerate([*wrong, None])))
    assert [f["x-page-id"] for _, f, _ in records] == ["3"] and len(gaps) == 1


@pytest.mark.parametrize("packed", [False, True])
def test_records_inside_a_damaged_payload_are_marked(packed):
    embedded = page(77, b"not a page of this archive")
    outer = [page(0, b"a"), page(1, b"before " + embedded + b" behind"), page(2, b"b"), page(3, b"c")]
    pack = (lambda parts: b"".join(map(op08_warc.member, parts))) if packed else b"".join
    assert [f["x-page-id"] for _, f, _ in op08_warc.salvage(pack(outer))[0]] == list("0123")
    # a wrong length: what is found in the payload is marked, the records behind it are not
    cut = list(outer)
    cut[1] = cut[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    records, gaps = op08_warc.salvage(pack(cut))
    assert {f["x-page-id"]: op08_warc.DOUBTFUL in f for _, f, _ in records} == {"0": False, "77": True, "2": False, "3": False} and gaps
    # a wrong digest: the stated end is the end, and nothing of the payload is read
    cut[1] = page(1, b"before " + embedded + b" behind", f"sha1:{'A' * 32}")
    records, gaps = op08_warc.salvage(pack(cut))
    assert [f["x-page-id"] for _, f, _ in records] == list("023") and len(gaps) == 1
