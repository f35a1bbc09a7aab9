"""From OCR boxes or lines to receipt records: totals, merchants, items, rules, and the whole record.

Lines stay arrays of one row, so extraction needs no shuffle.  Similarity runs as small Arrow-batched
functions (``functions.fuzzy``); everything else is native.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.fuzzy import any_word_like, by_text, first_near, ratio, text_like
from tillroll.functions.parsing import B, amounts, best_amount, find_date, find_time, let, lowered, receipt_no
from tillroll.functions.sums import arithmetic
from tillroll.operators.merchants import identify_by

# Words of receipts, most specific first.
TOTAL_KEYWORDS = [
    "รวมทั้งสิ้น", "ยอดสุทธิ", "ยอดรวมสุทธิ", "จำนวนเงินรวม", "ยอดชำระ", "grand total", "net total", "total amount", "amount due", "balance due",
    "sale amount", "จำนวนเงิน", "รวมเงิน", "ยอดรวม", "total",
]
NOT_FINAL = ["subtotal", "sub total", "sub-total", "ยอดก่อน", "ก่อนภาษี", "ไม่รวมภาษี", "ก่อนหักส่วนลด", "ส่วนลด", "discount", "change", "เงินทอน", "cash", "เงินสด"]
SUBTOTAL = ["subtotal", "sub total", "ยอดรวมย่อย", "รวมย่อย"]
VAT = ["vat", "uat", "ภาษีมูลค่าเพิ่ม", "ภ.พ.", "ภพ."]
PAYMENT = ["cash", "change", "เงินสด", "เงินทอน", "ทอน", "balance"]
SLIP = ["balance", "baiance", "ยอดคงเหลือ", "คงเหลือ"]
END_OF_ITEMS = ["total", "tota", "subtotal", "sub total", "ยอดรวม", "รวมทั้งสิ้น", "รวมเงิน", "รวมรายการ", "cash", "change", "เงินสด", "เงินทอน", "เงินสก", "คงเหลือ"]
NOT_AN_ITEM = ["cash", "change", "balance", "baiance", "เงินสด", "เงินทอน", "ทอน", "ส่วนลด", "disc"]
AMBIGUOUS_END = ["balance", "baiance", "คงเหลือ"]
HEADER = [
    "tax", "1ax", "iax", "fax", "jax", "invoice", "inuoice", "inv0ice", "invoce", "pos", "reg id", "host", "server", "guest", "table", "cashier", "tid", "vid", "mer",
    "stan", "batch", "trace", "appr", "pm", "vat", "uat", "included", "includ", "ภาษี", "ภาษ", "ใบกำกับ", "ใบกากับ", "www", ".com", ".co.th", "http",
]
BOILERPLATE = [
    "tax invoice", "tax id", "reg id", "receipt", "abb", "vat included", "vat", "thank you", "customer copy", "merchant copy", "sale (pos)", "qr promptpay",
    "ใบกำกับภาษี", "ใบเสร็จ", "อย่างย่อ", "ขอบคุณ", "ราคารวมภาษี", "เลขประจำตัว", "www.", "http", ".com", ".co.th",
]
MONEY_WORDS = ["total", "amt", "cash", "change", "balance", "subtotal", "รวม", "ยอด", "เงินสด", "เงินทอน", "บาท", "ราคา", "ส่วนลด"]
PROVIDERS = ["bangkok bank", "ธนาคารกรุงเทพ", "kasikorn", "กสิกร", "scb", "ไทยพาณิชย์", "krungthai", "กรุงไทย", "krungsri", "กรุงศรี", "ttb", "promptpay", "visa", "mastercard"]
LABELS = ["invoice", "inv", "trans", "trace", "stan", "appr", "ref", "เลขที่"]
#: (code, name, tax id, keywords) in the order of priority.
MERCHANTS = [
    ("kfc", "KFC", "0105532021090", ["kfc"]), ("dq", "Dairy Queen", "0105525046201", ["talktodq", "minor dq", "dq cashier"]), ("sizzler", "Sizzler", "0105551088013", ["sizzler"]),
    ("the-pizza-company", "The Pizza Company", "0735560089449", ["pizza"]), ("vsquare", "V-Square Department Store", "0605545000024", ["v-square", "vsquare", "vsquareplaza"]),
    ("bigc-foodpark", "BIG C FOODPark", "0107536000633", ["foodpark", "supercenter"]),
]


def holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def whole_word(low: Column, words: list[str]) -> Column:
    """ASCII words with no a-z beside them, others anywhere."""
    plain, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    # a search for words is cheaper than a pattern, which few lines need
    out = holds(low, plain) & low.rlike(f"(?<![a-z])(?:{'|'.join(map(re.escape, plain))})(?![a-z])")
    return out | holds(low, other) if other else out


def box_lines(boxes: Column, least: float = 0.5, confidence: bool = False) -> Column:
    """F-01, O-07, P-09: lines of text boxes (text, x1, y1, x2, y2, and confidence if so told).

    Boxes without text or of a confidence under ``least`` go.  The others are taken by their vertical centre; one joins the current row if it overlaps the row's first box
    by half of the smaller height.
    """
    at = lambda b: (b["y1"] + b["y2"]) / 2
    full = lambda b: F.coalesce(b["text"].rlike(r"(?U)\S"), F.lit(False))
    boxes = F.filter(boxes, lambda b: full(b) & (F.coalesce(b["confidence"], F.lit(1.0)) >= least) if confidence else full(b))
    ordered = F.array_sort(F.transform(boxes, lambda b, i: F.struct(at(b).alias("c"), i.alias("i"), b.alias("b"))))

    def height(b: Column) -> Column:
        return F.greatest(b["y2"] - b["y1"], F.lit(1))

    def same(a: Column, b: Column) -> Column:
        overlap = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        return overlap >= 0.5 * F.least(height(a), height(b))

    one = "array<struct<x1:int,i:int,text:string>>"

    def put(rows: Column, x: Column) -> Column:
        b = x["b"]
        cell = F.struct(b["x1"].cast("int").alias("x1"), x["i"].cast("int").alias("i"), b["text"].alias("text"))
        box = F.struct(b["y1"].cast("int").alias("y1"), b["y2"].cast("int").alias("y2"))
        last = F.try_element_at(rows, F.lit(-1))
        grown = F.concat(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), F.concat(last["cells"], F.array(cell)).alias("cells"))))
        fresh = F.concat(rows, F.array(F.struct(box.alias("first"), F.array(cell).alias("cells"))))
        return F.when((F.size(rows) > 0) & F.coalesce(same(last["first"], b), F.lit(False)), grown).otherwise(fresh)

    rows = F.aggregate(ordered, F.array().cast(f"array<struct<first:struct<y1:int,y2:int>,cells:{one}>>"), put)
    return F.transform(rows, lambda r: F.array_join(F.transform(F.array_sort(r["cells"]), lambda c: c["text"]), " "))


def find_total(df: DataFrame) -> DataFrame:
    """F-05 to F-11 over a column ``lines``: adds total (value, score, reason) and keyword_total."""
    look = lambda s: F.translate(s, "1058|!", "losbll")
    least_first = TOTAL_KEYWORDS[::-1]
    # the shortest words of which each keyword holds one; ``look`` leaves letters as they are
    parts = [re.escape(k) for k in {min((w for w in ("total", "amount", "due", "เงิน", "ยอด", "รวม") if w in k), key=len, default=k) for k in TOTAL_KEYWORDS}]
    ascii_first = [(i, k) for i, k in enumerate(least_first) if k.isascii()]
    near_keyword, negative = first_near([k for _, k in ascii_first], 0.80), any_word_like(["subtotal", "discount", "change"], 0.82, "[a-z]{5,}")
    df = df.withColumn("low", F.transform("lines", F.lower)).withColumn("found", F.transform("lines", amounts)).withColumn("best", F.transform("found", best_amount))
    df = df.withColumn("looked", F.transform("low", look))
    df = df.withColumns({"near": near_keyword("low"), "negative": negative("looked")})
    negatives = F.zip_with(F.transform("low", lambda s: holds(s, NOT_FINAL)), "negative", lambda a, b: a | b)

    def exact(s: Column, v: Column) -> Column:
        begins = lambda x, k: x.contains(k) & x.rlike(B + k)
        cases = F.coalesce(*(F.when((begins(s, k) | begins(v, k)) if k.isascii() else s.contains(k), i) for i, k in enumerate(least_first)))
        return F.when(v.rlike("|".join(parts)), cases)

    inexact = F.transform("near", lambda j: F.element_at(F.array(*(F.lit(i) for i, _ in ascii_first)), j + 1))
    ranks = F.zip_with(F.zip_with("low", "looked", exact), inexact, lambda a, b: F.struct(F.least(a, b).alias("rank"), F.coalesce(a <= F.coalesce(b, F.lit(99)), F.lit(False)).alias("exact")))

    # F-07, W-02: an amount on the line or on the two lines behind it, up to a negative one
    def value(r: Column, i: Column, negative: Column) -> Column:
        ahead = [F.try_element_at("best", i + k) for k in (2, 3)]
        stops = [F.coalesce(F.try_element_at(negative, i + k), F.lit(True)) for k in (2, 3)]
        later = F.when(~stops[0], F.coalesce(ahead[0], F.when(~stops[1], ahead[1])))
        v = F.coalesce(F.try_element_at("best", i + 1), later)
        fits = r["rank"].isNotNull() & ~F.try_element_at(negative, i + 1) & v.isNotNull()
        return F.when(fits, F.struct(r["rank"].alias("rank"), i.alias("i"), v.alias("value"), r["exact"].alias("exact")))

    # values that are used more than once are bound, as Spark would compute them at each use
    keyword = let(negatives, lambda n: F.array_max(F.filter(F.transform(ranks, lambda r, i: value(r, i, n)), lambda x: x.isNotNull())))
    flat = F.flatten("found")
    decimals = F.array_sort(F.array_distinct(F.transform(F.filter(flat, lambda x: x["has_decimals"]), lambda x: x["value"])))
    df = df.withColumn("decimals", decimals)
    printed = F.transform(F.filter(flat, lambda x: x["has_decimals"]), lambda x: x["value"])
    footer = F.try_element_at(F.filter(F.zip_with("low", "best", lambda s, v: F.when(s.contains("rd") & s.rlike(r"c\w?rd\s*n[o0]"), v)), lambda v: v.isNotNull()), F.lit(1))
    text = F.array_join("low", " ")
    is_slip = sum((F.regexp_count(text, F.lit(w)) for w in SLIP[1:]), F.regexp_count(text, F.lit(SLIP[0]))) >= 2
    sums = arithmetic(F.col("decimals"), F.when(is_slip, printed).otherwise(F.array().cast("array<double>")))
    df = df.withColumn("sums", sums)
    marked = F.flatten(F.zip_with("low", "found", lambda s, f: F.when(~holds(s, PAYMENT), F.transform(F.filter(f, lambda x: x["has_currency"] & x["has_decimals"]), lambda x: x["value"])).otherwise(F.array().cast("array<double>"))))
    single = let(F.array_distinct(marked), lambda m: F.when(F.size(m) == 1, m[0]))
    subtotal = F.array_max(F.zip_with("low", "best", lambda s, v: F.when(holds(s, SUBTOTAL), v)))
    has_vat = F.coalesce(F.exists(F.zip_with("low", "best", lambda s, v: holds(s, VAT) & v.isNotNull()), lambda x: x), F.lit(False))
    df = df.withColumn("is_slip", is_slip)
    math, slip = F.col("sums.taxed"), F.col("sums.spent")
    pick = lambda v, score, why: F.struct(v.alias("value"), F.lit(score).alias("score"), F.lit(why).alias("reason"))
    known = lambda value, score, why: let(value, lambda v: F.when(v.isNotNull(), pick(v, score, why)))

    def decided(k: Column) -> Column:
        key = k["value"]
        slips = F.coalesce(known(slip, 80, "balance difference"), known(footer, 85, "card footer"), F.when(key.isNotNull() & k["exact"], pick(key, 45, "keyword")))
        by_key = F.when(F.abs(key - math) <= 0.05, pick(key, 100, "keyword and arithmetic")).when(math.isNotNull(), pick(math, 70, "arithmetic")).otherwise(pick(key, 50, "keyword"))
        by_sum = F.coalesce(known(math, 60, "arithmetic"), known(single, 40, "only marked amount"), F.when(~has_vat, known(subtotal, 30, "subtotal")))
        return F.struct(F.when(F.col("is_slip"), slips).when(key.isNotNull(), by_key).otherwise(by_sum).alias("total"), key.alias("key"))

    df = df.withColumn("decided", let(keyword, decided))
    return df.withColumns({"total": F.col("decided.total"), "keyword_total": F.col("decided.key")}).drop("near", "looked", "negative", "decimals", "sums", "is_slip", "decided")


# How codes are cut, and which characters are read for others.
_SPLIT, _HEAD, _FUSED, _TRIM = re.compile(r"[\s()\[\]:,]+"), re.compile("[A-Za-zก-๙]+"), re.compile(r"([A-Za-z.#]{2,})(\d{5,}.*)"), " .:#-_*"
_LOOK = str.maketrans({"0": "o", "1": "i", "5": "s", "8": "b", "|": "i", "!": "i", "u": "v"})


@lru_cache(maxsize=50_000)
def _is_label_word(word: str) -> bool:
    return any(label.isascii() and (word == label or (len(label) >= 4 and abs(len(word) - len(label)) <= 2 and ratio(word, label) >= 0.80)) for label in LABELS)


def _is_label(token: str) -> bool:
    head = _HEAD.match(token)
    word = head[0].lower().translate(_LOOK) if head else ""
    return bool(word) and (any(label in token for label in LABELS if not label.isascii()) or _is_label_word(word))


def _code(raw: str) -> str | None:
    value = raw.strip(_TRIM)
    fused = _FUSED.match(value)
    value = fused[2].strip(_TRIM) if fused else value
    n = sum(c.isdigit() for c in value)
    return value if n >= 5 and not (n == 13 == len(value)) else None


def _codes(text: str) -> list[str]:
    if sum(map(str.isdigit, text)) < 5:
        return []
    out: list[str] = []
    tokens = [t for t in _SPLIT.split(text) if t]
    for i, token in enumerate(tokens):
        if not _is_label(token):
            continue
        fused = _FUSED.match(token)
        code = _code(fused[2]) if fused else None
        follow = (c for t in tokens[i + 1 : i + 4] if any(x.isdigit() for x in t) and (c := _code(t)))
        code = code or next(follow, None)
        if code:
            out.append(code)
    return out


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _line_codes(lines: pa.Array) -> pa.Array:
    return by_text(lines, lambda texts: pa.array(map(_codes, texts), pa.list_(pa.string())))


def reference_codes(lines: Column | str) -> Column:
    """F-14: codes behind transaction labels, in the order of their first occurrence."""
    lines = F.col(lines) if isinstance(lines, str) else lines
    return F.array_distinct(F.flatten(F.array_compact(_line_codes(F.coalesce(lines, F.array().cast("array<string>"))))))


def line_items(lines: Column, total: Column) -> Column:
    """F-21, W-03: array of (name, price) between the last header line and the first end marker."""
    # fixed values in the next three: an item list's end, its header lines, and the price at a line's end
    ended = lambda s: lowered(s, lambda low: (low.contains("ทธ") & low.rlike("ยอ.{0,3}ทธ")) | whole_word(low, END_OF_ITEMS) | (holds(low, AMBIGUOUS_END) & best_amount(amounts(s)).isNotNull()))
    head = lambda s: s.rlike(r"^[\s*\-=_.~#]+$") | (holds(s, [":", "/", "-"]) & s.rlike(r"\d{1,2}:\d{2}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}")) | lowered(s, lambda low: whole_word(low, HEADER))
    tail = r"[\s.]*([\d,]+(?:[.,\-]\d{2})?)(?:\s+\d{1,2})?\s*[^\d\s]{0,2}\s*$"

    def item(s: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(s, tail, ""), r"^[ \t.:*\-=#|,]+|[ \t.:*\-=#|,]+$", "")
        price = let(let(F.regexp_extract(s, tail, 1), lambda x: best_amount(amounts(x))), lambda v: F.when(F.coalesce(v <= total, F.lit(True)), v))
        return F.struct(name.alias("name"), price.alias("price"))

    def before(end: Column) -> Column:
        begin = F.greatest(end - 40, F.lit(1))
        return F.when(end > 1, F.slice(lines, begin, end - begin)).otherwise(F.array().cast("array<string>"))

    def behind_header(part: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(part, lambda s, i: F.when(head(s), i + 1))), F.lit(0))
        return let(last, lambda n: F.slice(part, n + 1, F.greatest(F.size(part) - n, F.lit(0))))

    end = F.array_position(F.transform(lines, ended), F.lit(True)).cast("int")
    rows = F.filter(let(let(end, before), behind_header), lambda s: lowered(s, lambda low: ~holds(low, NOT_AN_ITEM)))
    return F.filter(F.transform(rows, item), lambda x: F.length(F.regexp_replace(x["name"], r"[^\p{L}]", "")) >= 2)


def items_match(items: Column, total: Column) -> Column:
    """A-06: the priced items sum to the total; without priced items there is no evidence."""
    prices = F.filter(F.transform(items, lambda x: x["price"]), lambda p: p.isNotNull())
    return (F.size(prices) > 0) & (F.abs(F.aggregate(prices, F.lit(0.0), lambda a, b: a + b) - total) <= 0.05)


def find_merchant(df: DataFrame) -> DataFrame:
    """F-18, W-05, W-04: adds merchant_text, the best header line and its branch."""
    texts = F.transform(F.slice("lines", 1, 8), lambda s: F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    df = df.withColumn("head", texts).withColumn("bank", text_like(PROVIDERS, 0.70)(F.transform(texts, F.lower)))

    def scored(t: Column, i: Column) -> Column:
        return let(F.lower(t), lambda low: weighed(t, low, i))

    def weighed(t: Column, low: Column, i: Column) -> Column:
        pays = holds(low, PROVIDERS) | t.contains("ธนา") | F.try_element_at("bank", i + 1)
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        could = F.length(t).between(3, 60) & ~holds(low, BOILERPLATE) & ~holds(low, MONEY_WORDS) & ~t.rlike(rf"\d+[.,]\d{{2}}(?![\p{{L}}\p{{N}}_])") & (letters >= 0.3 * F.length(t))
        upper = (F.upper(t) == t) & (low != t)
        score = F.lit(10) - i * 2 - F.when(t.rlike(r"\p{Nd}"), 1).otherwise(0) + F.when(upper, 2).otherwise(0)
        made = lambda p: F.struct((score - F.when(p, 12).otherwise(0)).alias("score"), (-i).alias("i"), t.alias("text"), p.alias("pays"))
        return F.when(could, let(pays, made))

    def named(found: Column, top: Column) -> Column:
        branch = F.try_element_at(F.filter(found, lambda x: (x["i"] == top["i"] - 1) & ~x["pays"]), F.lit(1))["text"]
        return F.when(top.isNotNull(), F.concat_ws(" ", top["text"], branch))

    candidates = F.filter(F.transform("head", scored), lambda x: x.isNotNull())
    return df.withColumn("merchant_text", let(candidates, lambda c: let(F.array_max(c), lambda top: named(c, top)))).drop("head", "bank")


def identify(df: DataFrame) -> DataFrame:
    """F-19, F-20, J-05, J-06, U-01: adds merchant_code and merchant of the six known merchants; the list's order decides."""
    long = F.filter("lines", lambda s: s.rlike(r"(?:[0-9][\s\-]*+){13}"))
    ids = F.flatten(F.transform(long, lambda s: F.regexp_extract_all(F.regexp_replace(s, r"[\s\-]", ""), F.lit(r"([0-9]{13})"), 1)))
    words = [(code, w) for code, _, _, keywords in MERCHANTS for w in keywords]
    near_word = first_near([w for _, w in words], 0.80)
    text = F.lower(F.array_join("lines", " "))
    df = df.withColumns({"tax_ids": ids, "text": text, "folded": F.translate(text, "0158", "oisb")})
    df = df.withColumn("near_word", near_word(F.array("folded"))[0])
    nearly = lambda code: F.coalesce(F.col("near_word").isin([i for i, (c, _) in enumerate(words) if c == code]), F.lit(False))
    by_tax = F.coalesce(*(F.when(F.array_contains("tax_ids", t), code) for code, _, t, _ in MERCHANTS))
    by_word = F.coalesce(*(F.when(holds(F.col("text"), ws) | holds(F.col("folded"), ws) | nearly(code), code) for code, _, _, ws in MERCHANTS))
    df = df.withColumn("merchant_code", F.coalesce(by_tax, by_word))
    name = F.coalesce(*(F.when(F.col("merchant_code") == code, n) for code, n, _, _ in MERCHANTS), F.col("merchant_text"), F.lit("unknown"))
    return df.withColumn("merchant", name).drop("tax_ids", "text", "folded", "near_word")


def validate(items: Column, total: Column, date: Column, as_of: Column) -> Column:
    """F-22: (passed, failed, skipped) names of rules."""
    found = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: x["price"]), lambda p: p.isNotNull())))

    def of(prices: Column) -> Column:
        vat = F.exists(prices, lambda a: F.exists(prices, lambda b: (a > b) & (F.abs(a + b - total) <= 0.05)))
        outcomes = {
            "total_in_range": F.when(total.between(1, 500000), "p").otherwise("f"),
            "items_sum": F.when(F.size(prices) == 0, "s").when(items_match(items, total), "p").otherwise("f"),
            "subtotal_vat": F.when((F.size(prices) >= 2) & vat, "p").otherwise("s"),
            "date_not_in_future": F.when(date.isNull(), "s").when(date <= F.date_add(as_of, 1), "p").otherwise("f"),
            "date_not_too_old": F.when(date.isNull(), "s").when(F.datediff(as_of, date) <= 400, "p").otherwise("f"),
        }
        names = lambda x, o: F.array_compact(F.array(*(F.when(x[k] == o, k) for k in outcomes)))
        decided = F.struct(*(v.alias(k) for k, v in outcomes.items()))
        return let(decided, lambda x: F.struct(names(x, "p").alias("passed"), names(x, "f").alias("failed"), names(x, "s").alias("skipped")))

    return let(found, of)


def trusted(total: Column, rules: Column) -> Column:
    """F-33: a proposal counts if it has a total and no hard rule fails."""
    return total.isNotNull() & ~F.arrays_overlap(rules["failed"], F.array(F.lit("total_in_range"), F.lit("date_not_in_future")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores in even parts, where its source has fewer than four splits a core: the work for each byte is high, and splits are uneven.

    Sources that make their lines by rules do so behind this, as that work is spread then too.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def extract_receipts(df: DataFrame, as_of: str, registry: DataFrame | None = None) -> DataFrame:
    """F-23: the record of each row of ``lines``; ``rejected`` where no total above 0 was found (P-08).

    Merchants are those of ``registry`` (see ``merchants.identify_by``), without one the six known ones.
    """
    today = F.lit(as_of).cast("date")
    df = spread(df)
    df = find_merchant(find_total(df))
    df = identify(df) if registry is None else identify_by(df, registry)
    df = df.withColumns({"total_amount": F.col("total.value"), "receipt_date": find_date(F.col("lines"), today), "receipt_time_s": find_time(F.col("lines")), "receipt_no": receipt_no(F.col("lines")), "reference_codes": reference_codes("lines")})
    df = df.withColumn("items", line_items(F.col("lines"), F.col("total_amount")))
    df = df.withColumn("rules", validate(F.col("items"), F.col("total_amount"), F.col("receipt_date"), today))
    return df.withColumn("rejected", ~F.coalesce(F.col("total_amount") > 0, F.lit(False))).drop("low", "found", "best", "keyword_total")
