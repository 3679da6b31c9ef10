"""Periodic runs of words, found by descending-LCP Kruskal.

Words are runs of characters other than ASCII white space, numbered from 0.  A
run is a stretch with smallest period ``q`` (words ``q`` apart are identical)
of at least ``max(least_words, least_exponent * q)`` words that no neighbouring
word extends keeping that period.

For each document: the suffixes that start at its words are sorted (prefix
doubling in numpy) and neighbours' common prefixes (LCP) measured; then the
suffix classes are united by decreasing LCP with union-find, each class holding
its positions in order.  Where a union makes positions ``i < j`` newly adjacent
with ``j - i`` within the LCP, the stretch from ``i`` to ``j + LCP`` repeats
with period ``j - i``; it is a run if the words before ``i`` and ``j`` differ.
(Were there a smaller period, a position between the two would share the LCP
and they would not stay adjacent; pairs that are adjacent only until the other
unions of the same LCP have the start and end of such a run, so the smallest
period for each start and end is kept.)

Most texts have no run.  They are passed over by a test that loses none: all
but the last words of a run start windows that come again within one period, so
somewhere enough successive windows must come again at a small enough distance.
The windows' hashes are compared there; a collision lets a text pass the test,
never fail it, and the suffixes decide.

Documents are handled where they are read, whole, in groups of about
``GROUP_WORDS`` words; nothing is shuffled or collected.  Memory: about 300
bytes for each word of the longest document.

Defined results: null text has no words and no runs; every row is judged by
itself, so repeated rows, repeated or null doc_ids make no difference; an empty
table gives no rows; other columns are ignored, or kept by ``collapse``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import Numbered, slices, table

LEAST_WORDS = 6
LEAST_EXPONENT = 4
#: Words handled together; a longer document is a group of its own.
GROUP_WORDS = 100_000

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Positions:
    """An ordered set of positions in chunks; ``add`` returns the neighbours."""

    __slots__ = ("chunks", "firsts", "size")
    MOST = 1024

    def __init__(self, first: int):
        self.chunks, self.firsts, self.size = [[first]], [first], 1

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk

    def add(self, x: int) -> tuple[int, int]:
        """The positions before and after ``x``, -1 where there is none."""
        chunks, firsts = self.chunks, self.firsts
        at = max(bisect_right(firsts, x) - 1, 0)
        chunk = chunks[at]
        k = bisect_right(chunk, x)
        before = chunk[k - 1] if k else -1
        after = chunk[k] if k < len(chunk) else chunks[at + 1][0] if at + 1 < len(chunks) else -1
        chunk.insert(k, x)
        self.size += 1
        if not k:
            firsts[at] = x
        if len(chunk) > self.MOST:
            half = len(chunk) // 2
            chunks.insert(at + 1, chunk[half:])
            firsts.insert(at + 1, chunk[half])
            del chunk[half:]
        return before, after


def least_lcp(least_words: int, least_exponent: int) -> int:
    """The least LCP that seeds a run, over all periods."""
    return min(max((least_exponent - 1) * p, least_words - p, 1) for p in range(1, max(least_words, 1) + 1))


def may_have_runs(numbers: np.ndarray, doc: np.ndarray, least_words: int, least_exponent: int) -> np.ndarray:
    """The documents (numbers in ``doc``, ascending, one for each word) that can
    hold a run: with ``m`` successive windows of ``b`` words that come again, one
    of them at a distance ``d`` with ``d * (least_exponent - 1) < m + b``."""
    b = least_lcp(least_words, least_exponent)
    n = len(numbers) - b + 1
    if n < 2:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(b):
            h = (h ^ numbers[k:k + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    bits = np.uint64(max(int(n).bit_length(), 1))
    at = np.arange(n, dtype=np.uint64)
    whole = doc[:n] == doc[b - 1:b - 1 + n]
    keys = np.sort((h << bits | at)[whole])
    place = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = keys[1:] >> bits == keys[:-1] >> bits
    distance = np.zeros(n, np.int64)
    distance[place[:-1][same]] = np.diff(place)[same]
    again = distance > 0
    edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    # a stretch may reach from one document into the next: that passes more, never less
    if not len(starts):
        return np.empty(0, np.int64)
    far = np.where(again, distance, np.iinfo(np.int64).max)
    nearest = np.minimum.reduceat(far, np.column_stack([starts, ends]).ravel()[:-1])[::2]
    hit = nearest * (least_exponent - 1) < ends - starts + b
    found = np.zeros(int(doc[-1]) + 1, bool)
    for s, e in zip(starts[hit].tolist(), ends[hit].tolist()):
        found[doc[s:e]] = True
    return np.flatnonzero(found)


def sorted_suffixes(numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of (document, suffix within it), and the LCP of each
    with the one before it (0 at a document's first)."""
    n = len(numbers)
    end = np.searchsorted(doc, doc, side="right")
    rank = np.unique(doc << 32 | numbers, return_inverse=True)[1].astype(np.int64) + 1
    levels, length = [rank], 1
    while int(rank.max()) < n:
        after = np.zeros(n, np.int64)
        after[:n - length] = rank[length:]
        after[np.arange(n) + length >= end] = 0
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        length *= 2
    order = np.empty(n, np.int64)
    order[rank - 1] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(doc[order[1:]] == doc[order[:-1]]) + 1
    a, b, found = order[near - 1], order[near], np.zeros(len(near), np.int64)
    for k in reversed(range(len(levels) - 1)):  # at the last level all differ
        level = np.append(levels[k], [-1])
        equal = level[a + found] == level[b + found]
        found[equal] += 1 << k
    lcp[near] = found
    return order, lcp


def seeds(order: np.ndarray, lcp: np.ndarray, numbers: list[int], first: list[bool], least_words: int, least_exponent: int):
    """(start, end, period) of every run, by uniting classes of decreasing LCP."""
    use = np.flatnonzero(lcp >= least_lcp(least_words, least_exponent))
    use = use[np.argsort(-lcp[use], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    least: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], sets[x] = x, Positions(x)
            return x
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for level, i, j in zip(lcp[use].tolist(), order[use - 1].tolist(), order[use].tolist()):
        big, small = root(i), root(j)
        if sets[big].size < sets[small].size:
            big, small = small, big
        parent[small] = big
        into, last = sets[big], -1
        for x in sets.pop(small):
            before, after = into.add(x)
            if before == last:  # neighbours before, too
                before = -1
            last = x
            for left, right in ((before, x), (x, after)):
                period = right - left
                if (left < 0 or right < 0 or period * (least_exponent - 1) > level or period + level < least_words
                        or not first[left] and numbers[left - 1] == numbers[right - 1]):
                    continue
                key = left, right + level
                if period < least.get(key, period + 1):
                    least[key] = period
    return [(start, end, period) for (start, end), period in least.items()]


def runs_of(documents: list[np.ndarray], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each array of word numbers, by start,
    then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    doc = np.repeat(np.arange(len(documents)), sizes)
    some = may_have_runs(np.concatenate(documents), doc, least_words, least_exponent)
    if not len(some):
        return out
    begin = np.cumsum(sizes[some]) - sizes[some]
    numbers, doc = np.concatenate([documents[i] for i in some]), np.repeat(np.arange(len(some)), sizes[some])
    first = np.zeros(len(numbers), bool)
    first[begin] = True
    for start, end, period in seeds(*sorted_suffixes(numbers, doc), numbers.tolist(), first.tolist(), least_words, least_exponent):
        at = int(doc[start])
        out[some[at]].append((start - int(begin[at]), end - start, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """The words that stay when every run is cut to its first period; None: all."""
    if not runs:
        return None
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return np.flatnonzero(keep)


def _found(batches, text_at: int, least_words: int, least_exponent: int):
    """(batch, its documents' number of words, runs and collapsed texts)."""
    memo = Numbered()
    for part in slices(batches):
        counts, runs, texts, held, words = [], [], [], [], []

        def close():
            for tokens, found in zip(words, runs_of(held, least_words, least_exponent)):
                keep = kept_words(len(tokens), found)
                counts.append(len(tokens))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(tokens if keep is None else [tokens[i] for i in keep.tolist()]).decode())
            held.clear()
            words.clear()
            memo.fresh()

        size = 0
        for text in part.column(text_at).to_pylist():
            tokens = (text or "").encode().split()
            if size and size + len(tokens) > GROUP_WORDS:
                close()
                size = 0
            size += len(tokens)
            words.append(tokens)
            held.append(np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens)))
            memo.pending.clear()
        close()
        yield part, counts, runs, texts


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``:
    the text's words without those after the first period of a run, one space apart."""
    if least_exponent < 2:
        raise ValueError("a run repeats: least_exponent is 2 or more")

    def run(batches):
        for part, counts, runs, texts in _found(batches, 1, least_words, least_exponent):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``docs`` with all their columns; texts that hold a run are collapsed, others
    (null too) are left as they are."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for part, _, runs, texts in _found(batches, at, least_words, least_exponent):
            old = part.column(at).to_pylist()
            new = [t if r else o for o, t, r in zip(old, texts, runs)]
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``: a tenth of the documents, by a hash of their id,
    repeat a stretch of their words to their end (null ids: left as they are)."""
    def planted(doc_id, text):
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 or not words:
            return b" ".join(words).decode()
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()

    def run(batches):
        for part in slices(batches):
            texts = [planted(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document (planted ones included) and digests of them and of the collapsed texts."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))

    def by_exponent(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left != right, F.when(left > right, -1).otherwise(1))
                .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .otherwise(F.signum(a["period"] - b["period"]).cast("int")))

    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumns({"best": F.get(F.array_sort("runs", by_exponent), F.lit(0)), "lines": F.concat_ws("", line)})
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                       F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
