"""Quality rules: importance of hashed n-grams, trusted target against raw corpus.

Words are runs of characters other than ASCII white space; their runs of word
characters and of other signs are tokens.  Token unigrams and bigrams are
hashed into ``BUCKETS`` counts for two multinomials: the trusted target (every
document labelled good) and the raw corpus (every document).  A document's
verdict is its log-likelihood ratio between the two divided by its number of
n-grams: it is kept if that is at least the threshold, a low quantile of the trusted documents' own values less a margin.
Nothing is drawn at random, so every document's verdict is repeatable.

Base rules reject a document of fewer than ``MIN_WORDS`` words, or with more
than ``MAX_REPEAT`` percent of its words in 3-word windows found twice or more.

The counts have a fixed size, so tasks send sums and the driver holds two
arrays; of the trusted values it takes the lowest, up to the quantile's rank.
The trusted documents are found by one join on the id; only their n-grams are
written, for the counts and the values.

Defined results: null text has no words and fails the base rules; a document
without n-grams has ratio 0; with no trusted document the ratio is 0 and the
threshold minus infinity, so that base rules alone decide; null and repeated
doc_ids are judged row by row; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import Growing, Numbered, batch_of, ragged, slices, table, written

BUCKETS = 1 << 16
MIN_WORDS = 50
MAX_REPEAT = 50
#: The threshold: this quantile of the trusted documents, less a margin, since the
#: counts hold those documents themselves and good ones outside lie a little lower.
QUANTILE = 0.001
MARGIN = 0.15

#: So many ids of trusted documents are broadcast (tens of MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Words:
    """A worker's memo: each distinct word's number and token hashes."""

    def __init__(self):
        self.memo = Numbered(500_000)
        self._reset()

    def _reset(self):
        self.hashes, self.start, self.length = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Equal words get equal numbers until the next call of ``fresh``."""
        numbers = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        pending, self.memo.pending = self.memo.pending, []
        if pending:
            each = [[zlib.crc32(t.encode()) for t in _TOKEN.findall(w.decode())] or [zlib.crc32(w)] for w in pending]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            self.start.extend(self.hashes.size + np.cumsum(lengths) - lengths)
            self.length.extend(lengths)
            self.hashes.extend([h for x in each for h in x])
        return numbers

    def fresh(self) -> None:
        if self.memo.fresh():
            self._reset()

    def buckets(self, numbers: np.ndarray) -> np.ndarray:
        """Buckets of the unigrams and bigrams of the words' tokens."""
        h = ragged(self.hashes.values, self.start.values[numbers], self.length.values[numbers]).astype(np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xD6E8FEB86659FD93)
        return np.concatenate([h & np.uint64(BUCKETS - 1), pairs >> np.uint64(48)]).astype(np.int64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(numbers) < 4:
        return 0
    if numbers.max() < 1 << 21:
        windows = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
    else:  # pairs first, so that a window fits 64 bits whatever the number of words
        pairs = np.unique(numbers[:-1] << 32 | numbers[1:], return_inverse=True)[1]
        windows = pairs[:-1] << 32 | numbers[2:]
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def base_counts(text: str, data: bytes, words: list[bytes], numbers: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return (len(words), len(text) - (len(data) - len(data.translate(None, _SPACE))), len(data) - len(data.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(numbers))


@dataclass
class Importance:
    """Log ratio of each bucket, and the least value a kept document has."""

    ratio: np.ndarray
    threshold: float

    def value(self, buckets: np.ndarray) -> float:
        return float(self.ratio[buckets].mean()) if len(buckets) else 0.0


def _documents(batches):
    """(batch, row, text, bytes, words, numbers, memo) of each document."""
    memo = Words()
    for part in slices(batches):
        texts = part.column(part.schema.get_field_index("text")).to_pylist()
        for row, text in enumerate(texts):
            text = text or ""
            data = text.encode()
            words = data.split()
            yield part, row, text, data, words, memo.numbers(words), memo
            memo.fresh()


def fit(docs: DataFrame, labels: DataFrame, target_rows: int | None = None) -> Importance:
    """Counts over every document of ``docs``, and over every trusted one; with
    ``target_rows`` over at most so many trusted ids, those of the lowest hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = (labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    if target_rows is not None:
        good = good.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)

    def sums_of(found):
        sums, seen = np.zeros(BUCKETS, np.int64), False
        for grams in found:
            sums += np.bincount(grams, minlength=BUCKETS)
            seen = True
        if seen:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    def counted(rows: DataFrame, grams) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for r in rows.mapInArrow(lambda batches: sums_of(grams(batches)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
            out[r.bucket] = r.n
        return out

    def written_grams(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("grams", pa.binary())])
        for part, row, _, _, words, numbers, memo in _documents(batches):
            yield batch_of(schema, [part.column(0).slice(row, 1), [len(words)], [memo.buckets(numbers).astype("<u2").tobytes()]])

    def each_grams(batches):
        return (np.frombuffer(g, "<u2") for part in slices(batches) for g in part.column(0).to_pylist())

    # Only the trusted documents' n-grams are kept: their texts are read once for both the counts and the values.
    own = written(texts.join(good, "doc_id", "left_semi").mapInArrow(written_grams, "doc_id long, n_words long, grams binary"), "trusted-grams")
    raw = counted(texts, lambda batches: (memo.buckets(numbers) for *_, numbers, memo in _documents(batches)))
    target = counted(own.select("grams"), each_grams)
    if not target.any():
        return Importance(np.zeros(BUCKETS), float("-inf"))
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    model = Importance(ratio, float("-inf"))

    def values(batches):
        for part in slices(batches):
            found = [model.value(np.frombuffer(g, "<u2")) for g in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["doc_id", "value"])

    # One value an id, however often it occurs.
    least = written(own.filter(F.col("n_words") >= MIN_WORDS).select("doc_id", "grams").mapInArrow(values, "doc_id long, value double")
                    .groupBy("doc_id").agg(F.min("value").alias("value")), "trusted-values")
    model.threshold = quantile(least, "value", QUANTILE) - MARGIN
    return model


def quantile(values: DataFrame, column: str, q: float) -> float:
    """The exact low quantile of ``column``, read off its lowest rows; without rows minus infinity."""
    at = q * (values.count() - 1)
    if at < 0:
        return float("-inf")
    lowest = [r[0] for r in values.select(column).orderBy(column).limit(int(at) + 2).collect()][int(at):]
    return float(lowest[0] + (lowest[-1] - lowest[0]) * (at - int(at)))


def judge(docs: DataFrame, model: Importance) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, ``value``."""
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, value double")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        rows, held = [], None
        for part, row, text, data, words, numbers, memo in _documents(batches):
            if held is not None and part is not held and rows:
                yield pa.RecordBatch.from_pylist(rows, out)
                rows = []
            held = part
            counts = base_counts(text, data, words, numbers)
            failed, value = base_failed(counts), model.value(memo.buckets(numbers))
            rows.append(dict(zip(names, (part.column(0)[row].as_py(), *counts, failed, not failed and value >= model.threshold, value))))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names[1:6]), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("value", pa.float64())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def base_failed(counts) -> bool:
    n_words, _, _, _, repeated = counts
    return n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT * n_words


def keep_good(docs: DataFrame, model: Importance) -> DataFrame:
    """The kept documents with all their columns; no row is shuffled."""
    def run(batches):
        mask, held = [], None
        for part, _, text, data, words, numbers, memo in _documents(batches):
            if held is not None and part is not held:
                yield held.filter(pa.array(mask))
                mask = []
            held = part
            mask.append(not base_failed(base_counts(text, data, words, numbers)) and model.value(memo.buckets(numbers)) >= model.threshold)
        if held is not None:
            yield held.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def op2_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on all ``documents`` and the trusted ``labels``, then judge every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
