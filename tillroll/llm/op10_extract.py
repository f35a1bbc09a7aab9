"""Operator 10: main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: the text between the edges of block-level elements.  A block's features
are the tags, class and id words of its ancestors, the edge between its last sectioning ancestors, its own tag,
its length, words, link share and punctuation.  The field has two labels (main text or not); it is
trained by stochastic gradient on labelled pages and decoded by Viterbi's algorithm, whole pages at a time.

Labelled pages come from :func:`labelled_pages`, a seeded generator of layouts (``TRAIN`` pages, a
bounded sample); other labelled pages may be passed to :func:`train`.  Markup, scripts, styles,
comments of the markup, forms' controls and what stands in the head is no block at all.

Edge cases: null and empty html, and pages without any main block, have the text ''.  Unclosed tags are closed by
their parents (elements of raw text only by their own end tag), stray end tags are ignored, a ``<`` that opens no tag is text.  A formula's text stays.
Reading takes time linear in the page, whatever its markup.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.common import pieces

TRAIN = 400
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>", re.DOTALL)
_OPEN = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
_OPEN_SIMPLE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
_TO_THE_END = re.compile(r"<!--|<!\[CDATA\[")
_HEAD_ENDS = re.compile("</head(?![a-zA-Z0-9])|<body", re.IGNORECASE)
#: Tags whose quotes may stay open up to the page's end; later ones end at their first ``>``, so that no page is read more often than this.
OPEN_QUOTES = 16
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")
# Elements of HTML by their content model.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SKIP = set("script style noscript template iframe svg object head title textarea select button option canvas audio video".split())
#: Those of SKIP whose content is raw text up to their own end tag; the others are nodes, hidden until closed.
RAW = set("script style noscript title textarea iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SECTION = set("article aside footer form header main nav section".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li", "legend", "summary"}
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTROLS = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "select": {"select"}, "button": {"button"}}
SCOPE = {"ul", "ol", "table", "dl", "menu"}


class _Node:
    """An open element.  ``new`` has the features that none of its ancestors has; ``block`` is the nearest visible block element."""

    __slots__ = ("block", "hidden", "names", "new", "parent", "section", "tag", "total")

    def __init__(self, tag: str, names: list[str], section: str, parent: _Node | None) -> None:
        self.tag, self.names, self.section, self.parent, self.total = tag, names, section, parent, None
        self.hidden = tag in SKIP or parent is not None and parent.hidden
        self.block = self if parent is None or tag in BLOCK and not self.hidden else parent.block
        self.new: list[str] = []

    def features(self) -> list[str]:
        chain, node = [], self
        while node:
            chain.append(node.new)
            node = node.parent
        return [f for new in reversed(chain) for f in new]

    def score(self, weights: dict[str, float]) -> float:
        """The sum of weights of all features, kept on each node, so that a page's nodes are summed once."""
        chain, node = [], self
        while node and node.total is None:
            chain.append(node)
            node = node.parent
        total = node.total if node else 0.0
        for x in reversed(chain):
            total += sum([weights.get(f, 0.0) for f in x.new])
            x.total = total
        return total


class _Stack:
    """The open elements of a page, with the places of each tag's elements and the number of open elements that have a feature."""

    def __init__(self) -> None:
        self.nodes = [_Node("", [], "-", None)]
        self.places: dict[str, list[int]] = {}
        self.skipped: list[int] = []
        self.count: dict[str, int] = {}
        self.links = 0

    def push(self, tag: str, attributes: str) -> None:
        parent = self.nodes[-1]
        section, names = parent.section, []
        if tag in BLOCK and tag not in ("html", "body", "div", "p"):
            names.append(f"in:{tag}")
        if tag in SECTION:
            names.append(f"edge:{section}>{tag}")
            section = tag
        if attributes:
            for match in _NAMES.finditer(attributes):
                names += [f"name:{w.lower()}" for w in _PART.findall(match[1] or match[2] or match[3] or "")]
        node = _Node(tag, names, section, parent)
        for name in names:
            n = self.count.get(name, 0)
            if not n:
                node.new.append(name)
            self.count[name] = n + 1
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in SKIP:
            self.skipped.append(len(self.nodes))
        self.links += tag == "a"
        self.nodes.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((held[-1] for t in tags if (held := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in SKIP:
                self.skipped.pop()
            self.links -= node.tag == "a"
            for name in node.names:
                self.count[name] -= 1


def _leaves(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters in links, block element) of a page's leaf blocks in order, in time linear in the page."""
    stack = _Stack()
    parts: list[str] = []
    found: list[tuple[str, int, _Node]] = []
    linked, quotes = 0, OPEN_QUOTES
    last_end = page.rfind(">")
    endless: set[str] = set()
    head_ends: int | None = None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, linked, stack.nodes[-1].block))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if stack.nodes[-1].hidden:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack.links:
            linked += len(text)

    at = look = 0
    while at < len(page):
        sign = page.find("<", look)
        if sign < 0 or sign > last_end:  # no tag can end any more
            rest = _TO_THE_END.search(page, sign) if sign >= 0 else None
            add(page[at : rest.start()] if rest else page[at:])
            break
        match = _MARKUP.match(page, sign)
        opening = None
        if not match:
            opening = _OPEN.match(page, sign) if quotes else None
            if not opening:
                opening = _OPEN_SIMPLE.match(page, sign)
                quotes -= bool(opening and quotes)
            if not opening:
                look = sign + 1
                continue
        if sign > at:
            add(page[at:sign])
        at = look = (match or opening).end()
        if match:
            tag = (match[1] or "").lower()
            if tag == "br":
                parts.append(" ")
            elif place := stack.last((tag,)):
                if tag in BLOCK and not stack.nodes[place].hidden:
                    flush()
                stack.close(place)
            continue
        tag, attributes = opening[1].lower(), opening[2]
        if tag in RAW:
            if tag == "title" and not stack.nodes[-1].hidden:
                flush()
            end = None if tag in endless else re.compile(f"</{tag}(?![a-zA-Z0-9])[^>]*>", re.IGNORECASE).search(page, at, last_end + 1)
            if end:
                at = look = end.end()
            elif attributes[-1:] != "/":
                at = look = len(page)
            else:
                endless.add(tag)
            parts.append(" ")
            continue
        if tag == "body" and stack.places.get("head"):
            stack.close(stack.places["head"][0])
        if tag in CONTROLS:
            place = stack.last(CONTROLS[tag])
            if place > stack.last((SKIP - {"option"} | {"datalist", "optgroup"}) - CONTROLS[tag]):
                stack.close(place)
        if tag in SKIP:
            if tag == "head":
                if head_ends is None:
                    head_ends = max((m.start() for m in _HEAD_ENDS.finditer(page)), default=-1)
                if head_ends < at:
                    continue
                flush()
            parts.append(" ")
        elif tag in BLOCK:
            if not stack.nodes[-1].hidden:
                flush()
            low = stack.skipped[-1] if stack.skipped else 0
            if tag in CLOSES_P and (place := stack.last("p")) > low:
                stack.close(place)
            if tag in PEERS and (place := stack.last(PEERS[tag])) > max(low, stack.last(SCOPE)):
                stack.close(place)
        if tag in VOID or attributes[-1:] == "/":
            if tag in ("br", "wbr", "img", "hr"):
                parts.append("" if tag == "wbr" else " ")
            continue
        stack.push(tag, attributes)
    flush()
    return found


def _own(found: list[tuple[str, int, _Node]]) -> Iterator[list[str]]:
    """The features of each block that aren't its ancestors'."""
    for i, (text, inside, node) in enumerate(found):
        size, words = len(text), text.count(" ") + 1
        own = [
            "bias", f"tag:{node.tag}", f"section:{node.section}", f"tag:{node.tag}|section:{node.section}", f"words:{min(8, words.bit_length())}", f"links:{inside * 4 // size}",
            f"end:{text[-1] if text[-1] in '.!?:;' else '-'}", f"from_end:{min(3, len(found) - 1 - i)}", f"start:{min(3, i)}",
        ]
        yield [*own, "copyright"] if "©" in text else own


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of a page's leaf blocks in order."""
    found = _leaves(page)
    return [(text, own + node.features()) for (text, _, node), own in zip(found, _own(found), strict=True)]


class Field:
    """Weights of features for the label 'main' against 'other', and of label pairs."""

    def __init__(self, weights: dict[str, float] | None = None, pairs: dict[tuple[int, int], float] | None = None) -> None:
        self.weights = weights or {}
        self.pairs = pairs or dict.fromkeys([(0, 0), (0, 1), (1, 0), (1, 1)], 0.0)

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels of a page's blocks with these scores."""
        p = self.pairs
        p00, p01, p10, p11 = p[0, 0], p[0, 1], p[1, 0], p[1, 1]
        back, zero, one = [], 0.0, 0.0
        for i, s in enumerate(scores):
            if i:
                from_zero, from_one = zero + p01, one + p11
                back.append((int(one + p10 > zero + p00), int(from_one > from_zero)))
                zero, one = max(zero + p00, one + p10), max(from_zero, from_one) + s
            else:
                one = s
        if not scores:
            return []
        labels = [int(one > zero)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], dict[tuple[int, int], float]]:
        """P(main) of each block and the expected number of each label pair, by forward-backward."""
        pairs, n = self.pairs, len(scores)
        ahead = [(0.0, scores[0])]
        for s in scores[1:]:
            a0, a1 = ahead[-1]
            ahead.append((_add(a0 + pairs[0, 0], a1 + pairs[1, 0]), _add(a0 + pairs[0, 1], a1 + pairs[1, 1]) + s))
        behind = [(0.0, 0.0)] * n
        for i in range(n - 2, -1, -1):
            b0, b1 = behind[i + 1][0], behind[i + 1][1] + scores[i + 1]
            behind[i] = _add(pairs[0, 0] + b0, pairs[0, 1] + b1), _add(pairs[1, 0] + b0, pairs[1, 1] + b1)
        total = _add(*ahead[-1])
        main = [math.exp(a[1] + b[1] - total) for a, b in zip(ahead, behind, strict=True)]
        expected = {
            (x, y): sum(math.exp(ahead[i][x] + pairs[x, y] + (scores[i + 1] if y else 0.0) + behind[i + 1][y] - total) for i in range(n - 1)) for x in (0, 1) for y in (0, 1)
        }
        return main, expected


def _add(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log1p(math.exp(min(a, b) - high))


def train(pages: list[tuple[list[list[str]], list[int]]], *, turns: int = 6, rate: float = 0.5, decay: float = 1e-3, seed: int = 3) -> Field:
    """Fits a field to (features of each block, labels) by AdaGrad on the penalised likelihood."""
    field, square, shuffle = Field(), {}, random.Random(seed)
    pages = [p for p in pages if p[0]]
    for _ in range(turns):
        shuffle.shuffle(pages)
        for features, labels in pages:
            main, expected = field.marginals([field.score(f) for f in features])
            slope: dict = {}
            for f, y, p in zip(features, labels, main, strict=True):
                for name in f:
                    slope[name] = slope.get(name, 0.0) + y - p
            for pair, e in expected.items():
                slope[pair] = sum((a, b) == pair for a, b in zip(labels, labels[1:])) - e
            for name, g in slope.items():
                held = field.pairs if isinstance(name, tuple) else field.weights
                g -= decay * held.get(name, 0.0)
                square[name] = square.get(name, 1e-8) + g * g
                held[name] = held.get(name, 0.0) + rate * g / math.sqrt(square[name])
    return field


# Names that page authors give to the parts of a page.
MAIN_NAMES = "article post content entry story main text body page blog news detail prose single".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar links tabs pagination pager toc skip".split(),
    "header": "header masthead top logo brand banner site title tagline".split(),
    "footer": "footer bottom copyright legal colophon imprint foot credits".split(),
    "aside": "sidebar side aside widget related recommended more popular trending rail tags categories recent".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense dfp".split(),
    "notice": "notice cookie consent alert banner popup modal newsletter subscribe gdpr message overlay paywall privacy warning".split(),
    "form": "form search login signup contact subscribe newsletter".split(),
    "comments": "comments comment commentlist reply replies discussion disqus respond reader responses feedback".split(),
    "share": "share social toolbar follow buttons meta byline author".split(),
}


def labelled_pages(n: int = TRAIN, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(html, texts of its main blocks) of invented pages in many layouts."""
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        out = " ".join("".join(r.choice("aeiou rstlnmdkp".replace(" ", "")) for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))
        return out[:1].upper() + out[1:]

    def sentence(low: int = 3, high: int = 25) -> str:
        return words(low, high) + r.choice([".", ".", ".", "", "!", "?", "!!"])

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.randint(low, high)))

    def named(names: list[str], chance: float = 0.85) -> str:
        if r.random() > chance:
            return ""
        kind, name = r.choice(["class", "class", "id"]), r.choice(names)
        extra = r.choice(["", "", "-" + r.choice(["box", "wrap", "area", "list", "inner", "block", "1"]), " " + r.choice(["wide", "box", "clearfix"])])
        return f' {kind}="{name}{extra}"'

    def boiler(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        plain = r.random() < 0.35 and kind != "form"
        names = named(OTHER_NAMES[kind], 1.0 if plain or tag in ("div", "section") else 0.4)
        tag = r.choice(["div", "section", "ul" if kind == "nav" else "div"]) if plain else tag
        if kind in ("nav", "share") or kind == "aside" and r.random() < 0.5:
            body = "".join(f"<li><a href='/x'>{words(1, 4)}</a></li>" for _ in range(r.randint(2, 8)))
            body = body if tag == "ul" else f"<ul>{body}</ul>"
        elif kind == "comments":
            body = r.choice(["<h3>" + words(1, 3) + "</h3>", ""]) + "".join(r.choice([f"<p>{prose(1, 3)}</p>", f"<div><p>{prose(1, 2)}</p></div>", f"<article class='comment'><p>{prose(1, 3)}</p></article>", f"<li>{prose(1, 2)}</li>"]) for _ in range(r.randint(1, 5)))
        elif kind == "form":
            body = f"<label>{words(1, 3)}</label><input type='text'><p>{sentence()}</p><button>{words(1, 2)}</button>"
        elif kind == "footer":
            body = r.choice(["&copy; 2020 " + words(1, 4) + " &middot; " + sentence(), f"<p>&copy; {words(1, 5)}</p><p>{sentence()}</p>", f"<p>{prose(1, 2)}</p>"])
        elif kind == "header":
            body = r.choice([f"<h1>{words(1, 3)}</h1><p>{words(2, 6)}</p>", f"<a href='/'>{words(1, 3)}</a>", f"<div>{words(1, 4)}</div>"])
        else:
            body = r.choice([prose(1, 3), f"<p>{prose(1, 3)}</p>", f"<h4>{words(1, 3)}</h4><p>{sentence()}</p>"])
        return f"<{tag}{names}>{body}</{tag}>"

    for _ in range(n):
        main: list[str] = []

        def keep(text: str, main: list[str] = main) -> str:
            main.append(text)
            return text

        title = keep(words(2, 10))
        inner = [r.choice([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>"])]
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            x = r.random()
            if x < 0.72:
                text = keep(prose(1, 6))
                inner.append(r.choice([f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>"]))
            elif x < 0.80:
                inner.append(f"<h{(k := r.randint(2, 4))}>{keep(words(1, 6))}</h{k}>")
            elif x < 0.86:
                inner.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.90:
                inner.append(f"<blockquote><p>{keep(prose(1, 2))}</p></blockquote>")
            else:
                inner.append(boiler(r.choice(["ad", "share", "aside", "notice", "form"])))
        if r.random() < 0.3:
            inner.append(boiler("comments"))
        if r.random() < 0.2:
            inner.append(f"<footer>{words(2, 8)}</footer>")
        shell = r.random()
        body = "".join(inner)
        if shell < 0.5:
            body = f"<article{named(MAIN_NAMES, 0.5)}>{body}</article>"
        elif shell < 0.7:
            body = f"<main{named(MAIN_NAMES, 0.5)}>{body}</main>"
        else:
            body = f"<div{named(MAIN_NAMES, 1.0)}>{body}</div>"
        if r.random() < 0.25:
            body = f"<main>{body}</main>" if "<main" not in body else body
        before = [boiler(k) for k in r.sample(["nav", "header", "ad", "notice", "form", "share", "aside"], r.randint(0, 4))]
        after = [boiler(k) for k in r.sample(["footer", "comments", "aside", "ad", "nav", "notice", "form"], r.randint(0, 4))]
        yield f"<html><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", main


def labels_of(page: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page's blocks."""
    left: dict[str, int] = {}
    for text in main:
        left[" ".join(text.split())] = left.get(" ".join(text.split()), 0) + 1
    found, labels = blocks(page), []
    for text, _ in found:
        labels.append(int(left.get(text, 0) > 0))
        left[text] = left.get(text, 0) - 1
    return [f for _, f in found], labels


@functools.lru_cache(maxsize=2)
def default_field(n: int = TRAIN, seed: int = 11) -> Field:
    return train([labels_of(page, main) for page, main in labelled_pages(n, seed)])


def extract_text(page: str | None, field: Field) -> str:
    found = _leaves(page or "")
    labels = field.viterbi([field.score(own) + node.score(field.weights) for (_, _, node), own in zip(found, _own(found), strict=True)])
    return "\n".join(text for (text, _, _), keep in zip(found, labels, strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row; narrow."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 22):
                texts = [extract_text(page, field) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_extract": op10_extract}
ORACLES: dict[str, str] = {}
