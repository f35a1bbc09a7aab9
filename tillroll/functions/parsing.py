"""Amounts, dates, times and codes of receipt lines, as native expressions over one line or all lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A letter, digit or underscore of any script; Java's \w is ASCII only.  BD and BL stand before a digit or an ASCII letter, which is the cheaper test.
W = r"\p{L}\p{N}_"
B, E = rf"(?<![{W}])", rf"(?![{W}])"
BD, BL = rf"(?=[0-9]){B}", rf"(?=[A-Za-z]){B}"
CURRENCY, MONEY_SIGNS = "(?i)(thb|บาท|฿)", ["thb", "บาท", "฿"]
_DATE = r"[/\-.][0-9]{1,2}[/\-.]"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_NUMBERED = "code id ref no tid stan batch trace inv pos reg q".split()
# What is no money, in the order in which it is blanked; only where the test before it holds, which all matches pass.
NOT_MONEY = [
    (lambda s, low: s.contains(":"), rf"{BD}[0-9]{{1,2}}:[0-9]{{2}}(?:[:.][0-9]{{2}})?{E}"),
    (lambda s, low: any_of(low, MONTHS), rf"(?i){BL}(?:{'|'.join(MONTHS)})[a-z]*\.?\s*[0-9]{{1,2}}\s*,?\s*[0-9]{{2,4}}{E}"),
    (lambda s, low: s.rlike(_DATE), rf"{BD}[0-9]{{1,2}}[/\-.][0-9]{{1,2}}[/\-.][0-9]{{2,4}}{E}"),
    (lambda s, low: any_of(low, ["#", *_NUMBERED]), rf"(?i)(?:#\s*[0-9]+|{BL}(?:{'|'.join(_NUMBERED)}){E}[#:.\s]*[0-9]+)"),
    (lambda s, low: s.rlike("[0-9]{7}"), rf"{BD}[0-9]{{7,}}{E}"),
    (lambda s, low: s.rlike(",[0-9]{2}(?![0-9])"), rf"{BD}[0-9]{{1,3}},[0-9]{{2}}(?![0-9])"),
]
# No line without a match of this has one of NOT_MONEY.
_SUSPECT = rf"[:#]|{_DATE}|[0-9]{{7}}|,[0-9]{{2}}(?![0-9])|(?i)(?:{'|'.join(_NUMBERED)})[#:.\s]*[0-9]|(?i)(?:{'|'.join(MONTHS)})[a-z]*\.?\s*[0-9]"
# How amounts, dates and times are written.
DECIMAL = rf"{BD}([0-9]{{1,3}}(?:[,\s][0-9]{{3}})+|[0-9]+)[.,\-]([0-9]{{2}})(?![0-9])"
WHOLE = rf"(?=[0-9])(?<![{W}.,\-])([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?![0-9.,\-])"
LOW, HIGH = 0.01, 1_000_000.0
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambdas, where Spark repeats common parts."""
    return F.transform(F.array(value), body)[0]


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of ``words``."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def lowered(text: Column, body) -> Column:
    """``body`` of the text in lower case, which is made once."""
    return let(F.lower(text), body)


def digits(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, THAI_DIGITS, "0123456789"))  # ASCII has none


def has_digit(text: Column) -> Column:
    return text.rlike(f"[0-9{THAI_DIGITS}]")


def strip_non_money(line: Column, low: Column) -> Column:
    """F-02 of a line without Thai digits and of its lower case; what is blanked becomes a space, so no word begins to match by it."""
    tests = [(lambda s, low: any_of(low, MONEY_SIGNS), rf"{B}{CURRENCY}(?=[0-9])", "$1 "), *((*x, " ") for x in NOT_MONEY)]
    blank = lambda test, pattern, by: lambda s: F.when(test(s, low), F.regexp_replace(s, pattern, by)).otherwise(s)
    return F.when(any_of(low, MONEY_SIGNS) | line.rlike(_SUSPECT), reduce(let, (blank(*x) for x in tests), line)).otherwise(line)


def amounts(line: Column) -> Column:
    """F-03: array of (value, has_decimals, has_currency), decimals before whole numbers."""
    def value(text: Column) -> Column:
        return text.try_cast("double")

    def made(found: Column, decimals: bool, currency: Column) -> Column:
        return F.transform(found, lambda v: F.struct(v.alias("value"), F.lit(decimals).alias("has_decimals"), currency.alias("has_currency")))

    def decimal(v: Column) -> Column:
        plain = lambda x: F.when(x.rlike("[^0-9]"), F.regexp_replace(x, "[^0-9]", "")).otherwise(x)
        return value(F.concat(let(F.substring(v, F.lit(1), F.length(v) - 3), plain), F.lit("."), F.right(v, F.lit(2))))

    def of(x: Column) -> Column:
        return let(F.regexp_extract_all(x["clean"], F.lit(DECIMAL), 0), lambda found: valued(x["clean"], found, x["currency"]))

    def valued(clean: Column, found: Column, currency: Column) -> Column:
        rest = F.when(F.size(found) > 0, F.regexp_replace(clean, DECIMAL, " ")).otherwise(clean)
        whole = F.transform(F.regexp_extract_all(rest, F.lit(WHOLE), 1), lambda a: value(F.replace(a, F.lit(","), F.lit(""))))
        return F.filter(F.concat(made(F.transform(found, decimal), True, currency), made(whole, False, currency)), lambda y: y["value"].between(LOW, HIGH))

    def marked(low: Column) -> Column:
        return let(F.struct(let(digits(line), lambda s: strip_non_money(s, low)).alias("clean"), (any_of(low, MONEY_SIGNS) & line.rlike(CURRENCY)).alias("currency")), of)

    # a line without a digit, as most headings are, has no amounts
    return F.when(line.isNull() | has_digit(line), lowered(line, marked)).otherwise(F.array().cast("array<struct<value:double,has_decimals:boolean,has_currency:boolean>>"))


def best_amount(found: Column) -> Column:
    """F-04: of :func:`amounts`, the most reliable, and of equals the rightmost."""
    ranked = F.transform(found, lambda x, i: F.struct((x["has_currency"].cast("int") * 2 + x["has_decimals"].cast("int")).alias("c"), i.alias("i"), x["value"].alias("v")))
    return F.array_max(ranked)["v"]


# Dates.
NUMERIC_DATE = r"(?=[0-9])(?<![0-9])([0-9]{1,2})([/\-.])([0-9]{1,2})\2([0-9]{2,4})(?![0-9])"
MONTH_FIRST = rf"(?i){BL}([a-z]{{3}})[a-z]*\.?\s+([0-9]{{1,2}})\s*,?\s*([0-9]{{4}}){E}"
DAY_FIRST = rf"(?i){BD}([0-9]{{1,2}})\s+([a-z]{{3}})[a-z]*\.?\s*,?\s*([0-9]{{4}}){E}"
DATE_KEYWORDS = "(?i)date|วันที่|วัน"


def _date(year: Column, month: Column, day: Column, as_of: Column) -> Column:
    """A plausible date or null: Buddhist years, two-digit years, and a window around ``as_of``."""
    def of(x: Column) -> Column:
        made = F.printf(F.lit("%04d-%02d-%02d"), x["y"], x["m"], x["d"]).try_cast("date")
        known = x["y"].isNotNull() & x["m"].isNotNull() & x["d"].isNotNull()
        return F.when(known & x["y"].between(F.year(as_of) - 5, F.year(as_of) + 1), made)

    y = year.try_cast("int")
    y = F.when(F.length(year) <= 2, F.when(y > 50, y + 2500).otherwise(y + 2000)).otherwise(y)
    y = let(y, lambda v: F.when(v > 2400, v - 543).otherwise(v))
    return let(F.struct(y.alias("y"), month.try_cast("int").alias("m"), day.try_cast("int").alias("d")), of)


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)), F.lit(0)).cast("string")


def find_date(lines: Column, as_of: Column) -> Column:
    """F-12: the date of the best score (month names 10, numbers 5, keywords 3 more), then of most repeats, then the first."""

    def first(line: Column, pattern: str, parts: tuple[int, int, int], named: bool) -> Column:
        found = [F.regexp_extract_all(line, F.lit(pattern), i) for i in parts]
        zipped = F.arrays_zip(*(x.alias(n) for x, n in zip(found, "ymd", strict=True)))
        dates = F.transform(zipped, lambda z: _date(z["y"], _month(z["m"]) if named else z["m"], z["d"], as_of))
        return F.when(line.rlike(pattern), F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1)))

    def scored(line: Column, i: Column) -> Column:
        named = F.coalesce(first(line, MONTH_FIRST, (3, 1, 2), True), first(line, DAY_FIRST, (3, 2, 1), True))
        by_name = F.when(lowered(line, lambda low: any_of(low, MONTHS)), named)
        by_number = F.when(line.rlike(_DATE), first(line, NUMERIC_DATE, (4, 3, 1), False))
        dates = F.struct(by_name.alias("name"), by_number.alias("number"))

        def of(x: Column) -> Column:
            return F.when(x["name"].isNotNull() | x["number"].isNotNull(), weighed(x))

        def weighed(x: Column) -> Column:
            score = F.when(x["name"].isNotNull(), 10).otherwise(5) + F.when(line.rlike(DATE_KEYWORDS), 3).otherwise(0)
            return F.struct(score.alias("s"), F.coalesce(x["name"], x["number"]).alias("d"), (-i).alias("i"))

        return let(dates, of)

    def best(found: Column) -> Column:
        return F.array_max(F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.size(F.filter(found, lambda y: y["d"] == x["d"])).alias("n"), x["i"].alias("i"), x["d"].alias("d"))))["d"]

    dated = F.filter(F.transform(lines, digits), lambda s: s.rlike(rf"{_DATE}|(?i)(?:{'|'.join(MONTHS)})"))  # few lines
    return let(F.filter(F.transform(dated, scored), lambda x: x["d"].isNotNull()), best)


# Times.
_MERIDIEM = rf"(?i)(?=[0-9])(?<![0-9])([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\s*([ap])[a-z]?{E}"
_PLAIN = r"(?=[0-9])(?<![0-9])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?![0-9])"
_SPACED = r"(?=[0-9])(?<![0-9])([0-9]{2})\s([0-9]{2})\s([0-9]{2})(?![0-9])"
_COMPACT = r"(?=[0-9])(?<![0-9])([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])"


def find_time(lines: Column) -> Column:
    """F-13: seconds of the day of the first line that has a time."""

    def first(line: Column, pattern: str, meridiem: bool = False) -> Column:
        parts = [F.regexp_extract_all(line, F.lit(pattern), i) for i in range(1, 5 if meridiem else 4)]

        def seconds(z: Column) -> Column:
            h, m, s = (z[str(i)].try_cast("int") for i in range(3))
            s = F.coalesce(s, F.lit(0))
            if meridiem:
                p = F.lower(z["3"])
                h = F.when((p == "p") & (h < 12), h + 12).when((p == "a") & (h == 12), 0).otherwise(h)
            return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)

        return F.when(line.rlike(pattern), F.try_element_at(F.filter(F.transform(F.arrays_zip(*parts), seconds), lambda t: t.isNotNull()), F.lit(1)))

    def of(line: Column) -> Column:
        dated = line.rlike(NUMERIC_DATE) | line.rlike(MONTH_FIRST) | line.rlike(DAY_FIRST)
        clock = F.when(line.contains(":"), F.coalesce(first(line, _MERIDIEM, True), first(line, _PLAIN)))
        return F.coalesce(clock, first(line, _SPACED), F.when(line.rlike(_COMPACT) & dated, first(line, _COMPACT)))

    timed = F.filter(F.transform(lines, digits), lambda s: s.rlike(r":[0-9]{2}|[0-9]{2}\s[0-9]{2}\s[0-9]{2}|[0-9]{6}"))  # few lines
    return F.try_element_at(F.filter(F.transform(timed, of), lambda t: t.isNotNull()), F.lit(1))


# Words before a receipt's number.
RECEIPT_NO = ["เลขที่", "เลขที่ใบเสร็จ", "receipt no", "invoice no", "no.", "bill no"]


def receipt_no(lines: Column) -> Column:
    """F-15: the first token behind a keyword on the first line that has one."""

    def of(line: Column) -> Column:
        low = F.lower(line)
        tails = [F.when(low.contains(k), F.substr(line, F.instr(low, k) + F.lit(len(k)))) for k in RECEIPT_NO]
        text = F.regexp_replace(F.coalesce(*tails), r"^[ :：#\-]+|[ :：#\-]+$", "")
        return F.nullif(F.regexp_extract(text, r"^\s*(\S+)", 1), F.lit(""))

    marked = F.filter(lines, lambda line: F.lower(line).rlike("|".join(k.replace(".", r"\.") for k in RECEIPT_NO)))
    return F.try_element_at(F.transform(marked, of), F.lit(1))
