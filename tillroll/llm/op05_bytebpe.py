"""Operator 5: byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a pre-token exactly one token can end its encoding.  ``PrefixTable`` stores
that token for each prefix, so the encoding is read backwards from the end, an append only fills new
prefixes, and an edit only refills prefixes behind the edit until they agree with those before it.  A token may follow another if the pair,
merged as bytes, splits into just these two again; that is what makes the choice unique.

Edge cases: a null text counts as empty; an empty text has no tokens (``ids_sha256`` is that of the
empty string).  Repeated texts give repeated rows; rows keep their order of columns; extra columns
of the input are ignored.  A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces

#: Bound of a worker's cache of pre-tokens.
CACHE = 80_000
#: Bound of its table of prefixes.
PREFIXES = 80_000
#: Bound of its table of pairs.
FOLLOWS = 120_000
# Letters, numbers and spaces of the code points below U+0250, for the quick form of the pattern.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_WIDE = re.compile("[^\x00-ɏ]")


class PairTable:
    """The tokens of a rank file and which of them may stand side by side."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.decimals = list(map(str, range(len(self.tokens))))
        self.starts: dict[bytes, int] = {t[:n]: -1 for t in self.ranks for n in range(1, len(t))} | self.ranks
        self.longest = max(map(len, self.ranks))
        self.ends = {t[n:] for t in self.ranks for n in range(1, len(t))}
        self._prefixes: dict[bytes, int] = {}
        self._follows: dict[int, bool] = {}
        self._stands: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a short string by merging the pair of least rank, leftmost first."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        known = self._stands.get(token)
        if known is None:
            known = self._stands[token] = self.merged(self.tokens[token]) == [token]
        return known

    def follows(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > FOLLOWS:
                self._follows.clear()
            known = self._follows[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def last(self, prefix: bytes) -> int:
        """The last token of a short string's encoding; words share the table of their prefixes."""
        found = self._prefixes.get(prefix)
        if found is not None:
            return found
        ranks, ends, fit, n = self.ranks, self.ends, [], len(prefix)
        for at in range(n - 1, -1, -1):
            tail = prefix[at:]
            token = ranks.get(tail)
            if token is not None:
                fit.append((at, token))
            if tail not in ends:
                break
        for at, token in reversed(fit):
            if self.follows(self.last(prefix[:at]), token) if at else self.stands(token):
                break
        if len(self._prefixes) > PREFIXES:
            self._prefixes.clear()
        self._prefixes[prefix] = token
        return token

    def ids(self, piece: bytes) -> list[int]:
        """Tokens of a pre-token: long ones by a table of their own."""
        if len(piece) > 100:
            return PrefixTable(self, piece).ids()
        out, tokens = [], self.tokens
        while piece:
            out.append(token := self.last(piece))
            piece = piece[: -len(tokens[token])]
        return out[::-1]


class PrefixTable:
    """A growing or edited byte string and, for each of its prefixes, the last token."""

    def __init__(self, pairs: PairTable, piece: bytes = b"") -> None:
        self.pairs, self.piece, self.last = pairs, b"", [-1]
        self.filled = 0
        """Prefixes that the last call computed."""
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Only the prefixes that end in ``more`` are computed; tokens may begin before it."""
        self._refill(len(self.piece), self.piece + more, [])

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Puts ``new`` in the place of ``piece[begin:end]``; prefixes up to ``begin`` stay.

        A prefix's token depends on the prefixes that one longest token before it spans.  Where all of those
        agree with the old ones, so do all that follow, and these are taken over.
        """
        self._refill(begin, self.piece[:begin] + new + self.piece[end:], self.last[end:])

    def _refill(self, keep: int, piece: bytes, tail: list[int]) -> None:
        """``tail``: the old tokens of the last prefixes, of which the first one ends where the edit does."""
        starts, follows, longest, n = self.pairs.starts, self.pairs.follows, self.pairs.longest, len(piece)
        last = self.last[: keep + 1] + [-1] * (n - keep)
        edge, same = n + 1 - len(tail), 0
        self.filled = n - keep
        for j in range(max(0, keep - longest), n):
            left = last[j]
            if j >= edge:
                same = same + 1 if left == tail[j - edge] else 0
                if same >= longest:
                    last[j + 1 :] = tail[j + 1 - edge :]
                    self.filled = j - keep
                    break
            for e in range(j + 1, n + 1):
                token = starts.get(piece[j:e])
                if token is None:
                    break
                if e > keep and token >= 0 and last[e] < 0 and (follows(left, token) if j else self.pairs.stands(token)):
                    last[e] = token
        self.piece, self.last = piece, last

    def ids(self) -> list[int]:
        out, at, tokens = [], len(self.piece), self.pairs.tokens
        while at:
            out.append(self.last[at])
            at -= len(tokens[self.last[at]])
        return out[::-1]


class Encoder(dict):
    """Encodes whole texts; maps pre-tokens to their ids."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        self.pairs = PairTable(raw)
        self.split = regex.compile(pattern).findall
        quick = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]")
        quick = quick.replace(r"\S", f"[^{_S}]").replace(r"\s", f"[{_S}]")
        self.quick = re.compile(quick).findall if "\\p" not in quick else self.split

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        rank = self.pairs.ranks.get(raw)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = found = (rank,) if rank is not None else tuple(self.pairs.ids(raw))
        return found

    def encode(self, text: str) -> list[int]:
        split = self.split if _WIDE.search(text) else self.quick
        return list(chain.from_iterable(map(self.__getitem__, split(text))))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.pairs.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pairs.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder(raw, pattern)


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row; narrow, without a shuffle.

    ``ranks`` is the content of a rank file; ``pattern`` cuts a text into pre-tokens.  ``decoded_sha256``
    is of the bytes that the ids decode to.  ``with_ids`` adds the ids as an array.
    """
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks, pattern)
        for batch in batches:
            for part in pieces(batch, "text"):
                counts, hashes, decoded, lists = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = coder.encode(text or "")
                    counts.append(len(ids))
                    hashes.append(sha(coder.joined(ids).encode()).hexdigest())
                    decoded.append(sha(coder.decode(ids)).hexdigest())
                    if with_ids:
                        lists.append(np.array(ids, np.int32))
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
