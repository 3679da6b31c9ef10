"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoding of that prefix ends in one
token, and any two neighbouring tokens of an encoding are, alone, the encoding
of their joined bytes.  So the last token of a prefix is the one token ending
there that is compatible with the last token of what is left before it.  A
``PrefixTable`` stores that token for every prefix: bytes can be appended
exactly by computing the new prefixes only, and after an edit only prefixes
behind it are computed again.  ``EditableText`` does the same for a whole
text: it splits anew from two matches before a change until the matches fall
on old borders again.

Each match of the split pattern is encoded separately, without special tokens;
a match that is itself in the rank file is that one token.

Defined results: null text counts as empty (no ids; sha256 of no bytes); null
and repeated doc_ids keep their rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import batch_of, slices, table
from skyledger.llm.tokens import SPACES, ByteBpe

#: The pattern with its white space spelled out, as the rank files mean it.
PATTERN = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]")
                        .replace(r"\s", f"[{SPACES}]"))
#: Pairs whose compatibility is remembered; more are computed again.
PAIR_MEMO = 2_000_000


class Ranks:
    """The tokens of a rank file and which of them may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.bytes[rank] = token
        #: The tokens that merges can make; no other is part of a longer encoding.
        self.made = {token: rank for token, rank in self.rank.items() if self.merged(token) == [rank]}
        self.longest = max(map(len, self.made))
        self.ends = ahocorasick.Automaton()  # the tokens that end at each byte, longest first
        for token, rank in self.made.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self._pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a short byte string by merging the lowest rank first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            i = ranks.index(min(ranks))
            if ranks[i] == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        found = self._pairs.get(a << 32 | b)
        if found is None:
            if len(self._pairs) >= PAIR_MEMO:
                self._pairs.clear()
            found = self._pairs[a << 32 | b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return found


class PrefixTable:
    """The last token of every prefix of one match of the pattern."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        ranks, last, known = self.ranks, self.last, len(self.data)
        self.data += more
        for at, (size, token) in ranks.ends.iter(self.data.decode("latin-1"), max(0, known + 1 - ranks.longest)):
            if len(last) == at + 1 and (size > at or ranks.compatible(last[at + 1 - size], token)):
                last.append(token)
        if len(last) <= len(self.data):
            raise ValueError("bytes that the rank file has no tokens for")

    def replace(self, start: int, end: int, new: bytes) -> None:
        rest = new + self.data[end:]
        del self.last[start + 1:]
        self.data = self.data[:start]
        self.append(rest)

    def ids(self) -> list[int]:
        if self.data in self.ranks.rank:
            return [self.ranks.rank[self.data]]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.bytes[self.last[end]])
        return out[::-1]


class EditableText:
    """A text whose ids follow appends and edits without encoding it all again."""

    def __init__(self, ranks: Ranks, text: str = ""):
        self.ranks, self.text = ranks, ""
        self.tables: list[tuple[int, PrefixTable]] = []  # start of the match, its table
        self.encoded = 0  # matches encoded so far
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` by ``new``."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        keep = max(0, sum(at < start for at, _ in self.tables) - 3)
        old = {at + shift: i for i, (at, _) in enumerate(self.tables) if at >= end}
        at = self.tables[keep][0] if keep < len(self.tables) else 0
        fresh = self.tables[:keep]
        while at < len(self.text):
            if at in old:
                fresh += [(a + shift, t) for a, t in self.tables[old[at]:]]
                break
            match = PATTERN.match(self.text, at)
            fresh.append((at, PrefixTable(self.ranks, match[0].encode())))
            self.encoded += 1
            at = match.end()
        self.tables = fresh

    def ids(self) -> list[int]:
        return [i for _, t in self.tables for i in t.ids()]


class PrefixBpe(ByteBpe):
    """Ids of whole texts: chunks between white space are encoded once a worker."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.decimal = [str(i).encode() for i in range(len(self.ranks.bytes))]
        self._matches: dict[str, list[int]] = {}
        self._reset()

    def _match(self, match: str) -> list[int]:
        ids = self._matches.get(match)
        if ids is None:
            ids = self._matches[match] = PrefixTable(self.ranks, match.encode()).ids()
        return ids

    def _encode_new(self, pending):
        if len(self._matches) >= self.memo.limit // 2:
            self._matches.clear()
        each = [[i for m in PATTERN.findall(self._plain(k)) for i in self._match(m)] for k in pending]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.cumsum(lengths) - lengths, lengths, [i for x in each for i in x]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, ids))


@lru_cache(maxsize=None)
def prefix_bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: uint16 ids and the bytes they decode to."""
    return _run(docs, path, "doc_id long, ids binary, decoded binary",
                lambda e, ids: (ids.tobytes(), e.decode(ids.tolist())))


def _run(docs: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    arrow = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches):
        encoder = prefix_bpe(path)
        for part in slices(batches):
            ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            yield batch_of(arrow, [part.column(0), *zip(*(row(encoder, x) for x in ids))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _digest(encoder: PrefixBpe, ids: np.ndarray) -> tuple[int, str, str]:
    ids = ids.tolist()
    return (len(ids), hashlib.sha256(b",".join(map(encoder.decimal.__getitem__, ids))).hexdigest(),
            hashlib.sha256(encoder.decode(ids)).hexdigest())


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents``."""
    return _run(table(spark, sf_dir, "documents"), None,
                "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)
