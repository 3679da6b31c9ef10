"""Toxicity: multiple-instance learning.

A document is a bag of sentences.  A sentence's logit is a bias plus the
weights of its words; a word's weight is the sum over the word in lower case
and its beginnings of 3 to 7 characters, hashed, so that inflected forms share
what is learned.  The document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``.  Only documents have labels: the gradient of
the noisy-or likelihood passes them on to sentences, and afterwards the
sentences of high ``p`` locate what is offensive.

A sentence ends at a line's end or at a word that ends in ``.``, ``!``, ``?``
or an ellipsis, and after ``SENTENCE_WORDS`` words at the latest.

The model is fitted on a bounded sample of labelled documents outside the
held-out third: at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` others, those
with the lowest hash of their id, whatever their length, up to the first with which
they would hold more than ``SAMPLE_CHARS`` characters a permitted row.  Scores of all documents read whole texts, and nothing but texts.

Defined results: null and empty texts have no sentence and score 0; null and
repeated doc_ids are scored row by row (a null doc_id is not held out and
never in the sample); without labels of both classes every score is 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import Growing, Numbered, batch_of, ragged, slices, table

THRESHOLD = 0.7
BUCKETS = 1 << 18
SENTENCE_WORDS = 40
TOXIC_ROWS, CLEAN_ROWS = 2_000, 6_000
#: On average: bounds all characters of the sample, not a document's.
SAMPLE_CHARS = 20_000
#: Documents of the sample that must hold a word for it to have a weight.
LEAST_ROWS = 3
STEPS, RATE = 150, 0.2
#: Words of the sample that a step of the fit spreads out at a time.
PART_WORDS = 1 << 18
#: Strength of the penalty on absolute weights, in standard errors of a weight's
#: first gradient: chance words of toxic documents get no weight.
PENALTY = 0.5
FIRST_BIAS = -6.0
_TOKEN = re.compile(r"\w+")
_PREFIXES = range(3, 8)
_END = re.compile(r"[.!?…][\"')\]»”’]*\Z")


def features(word: str) -> list[int]:
    """Hashed features of a word: its runs of word characters and their beginnings."""
    return [zlib.crc32(f.encode()) % BUCKETS for t in _TOKEN.findall(word.lower())
            for f in (t + " ", *(t[:n] for n in _PREFIXES if len(t) >= n))]


class Words:
    """A worker's memo: the features of each distinct word, and whether it ends a sentence."""

    def __init__(self, limit: int = 500_000):
        self.memo = Numbered(limit)
        self._reset()

    def _reset(self):
        self.features, self.start, self.length, self.ends = Growing(np.int32), Growing(np.int64), Growing(np.int64), Growing(bool)

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's words; the first word of each sentence."""
        words, line_starts = [], []
        for line in text.split("\n"):
            line_starts.append(len(words))
            words += line.split()
        numbers = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        pending, self.memo.pending = self.memo.pending, []
        if pending:
            each = list(map(features, pending))
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            self.start.extend(self.features.size + np.cumsum(lengths) - lengths)
            self.length.extend(lengths)
            self.features.extend([f for x in each for f in x])
            self.ends.extend([_END.search(w) is not None for w in pending])
        first = np.zeros(len(words) + 1, bool)
        first[1:] = self.ends.values[numbers]
        first[line_starts] = True
        first = np.flatnonzero(first[:-1])
        sizes = np.diff(np.append(first, len(words)))
        if len(sizes) and sizes.max() > SENTENCE_WORDS:  # long sentences in pieces
            first = np.concatenate([np.arange(a, a + n, SENTENCE_WORDS) for a, n in zip(first, sizes)])
        return numbers, first

    def fresh(self) -> bool:
        if self.memo.fresh():
            self._reset()
            return True
        return False


@dataclass
class Model:
    weight: np.ndarray
    bias: float


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words, self.sums = model, Words(), Growing(np.float64)

    def sentence_scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """p of each sentence, and the first word of each."""
        if self.words.fresh():
            self.sums = Growing(np.float64)
        numbers, first = self.words.sentences(text)
        w, known = self.words, self.sums.size
        if known < w.start.size:
            of = np.repeat(np.arange(w.start.size - known), w.length.values[known:])
            new = w.features.values[w.start.values[known]:]
            self.sums.extend(np.bincount(of, self.model.weight[new], w.start.size - known))
        if not len(first):
            return np.zeros(0), first
        logits = self.model.bias + np.add.reduceat(self.sums.values[numbers], first)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-np.minimum(logits, 40))), first

    def score(self, text: str) -> float:
        p, _ = self.sentence_scores(text)
        return 0.0 - float(np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def _documents_with(word: np.ndarray, document: np.ndarray, words: Words, n: int) -> np.ndarray:
    """Of each feature the documents that hold it, from words by ascending
    document; counted document by document, so that only one document's features are spread out."""
    counts, edges = np.zeros(BUCKETS, np.int64), np.searchsorted(document, np.arange(n + 1))
    for a, b in zip(edges, edges[1:]):
        of = np.unique(word[a:b])
        counts[np.unique(ragged(words.features.values, words.start.values[of], words.length.values[of]))] += 1
    return counts


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Proximal Adam over the whole sample on the noisy-or likelihood; deterministic."""
    words = Words(limit=1 << 62)
    word, sentence, bag, n = [], [], [], 0
    for d, text in enumerate(texts):
        numbers, first = words.sentences(text)
        if len(first):
            word.append(numbers.astype(np.int32))
            sentence.append((n + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(numbers))))).astype(np.int32))
            bag.append(np.full(len(first), d, np.int32))
            n += len(first)
    if not n or len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), float("-inf"))
    word, sentence, bag = np.concatenate(word), np.concatenate(sentence), np.concatenate(bag)
    words.memo.clear()
    # A feature belongs to words, a word to sentences, a sentence to a document.
    feature, length = words.features.values.astype(np.int64), words.length.values
    of_word = np.repeat(np.arange(len(length)), length)
    common = _documents_with(word, bag[sentence], words, len(texts)) >= LEAST_ROWS
    of_word, feature = of_word[common[feature]], feature[common[feature]]
    names, feature = np.unique(feature, return_inverse=True)

    # A step spreads weights over a part of the words at a time: over all of them would take hundreds of MB.
    parts = [slice(i, i + PART_WORDS) for i in range(0, len(word), PART_WORDS)]
    y = labels[bag] == 1
    toxic = int((labels == 1).sum())
    penalty = PENALTY * np.sqrt(toxic) * toxic / max(1, int(y.sum()))
    w, b, m, v = np.zeros(len(names)), FIRST_BIAS, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        weight = np.bincount(of_word, w[feature], len(length))
        logit = np.zeros(n)
        for part in parts:
            np.add.at(logit, sentence[part], weight[word[part]])
        p = 1 / (1 + np.exp(-np.clip(b + logit, -30, 30)))
        none = np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)))[bag]
        # d log-likelihood / d logit of each sentence, then of words, then of features
        g = np.where(y, p * none / np.maximum(1 - none, 1e-9), -p)
        of_words = np.zeros(len(length))
        for part in parts:
            np.add.at(of_words, word[part], g[sentence[part]])
        grad = np.append(np.bincount(feature, of_words[of_word], len(names)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        rate = RATE / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-2)
        move = rate * m / (1 - 0.9 ** step)
        w, b = w + move[:-1], b + move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * penalty, 0)
    weight = np.zeros(BUCKETS)
    weight[names] = w
    return Model(weight, float(b))


def _remainder():
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "UTF-8")), F.lit(3))


def held_out():
    return F.col("doc_id").isNotNull() & (_remainder() == 1)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Learns in one executor task from the bounded sample."""
    spark = docs.sparkSession
    labels = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    given = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Lowest hashes of either class, of documents of every length: two bounded lists of ids.
    there = labels.join(given.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("chars")), "doc_id")
    ids = []
    for toxic, n in ((1, toxic_rows), (0, clean_rows)):
        room = n * SAMPLE_CHARS
        for r in there.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect():
            room -= r.chars
            if room < 0:  # the list ends here: going on with shorter ones would choose by length
                break
            ids.append(r)
    sample = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    rows = given.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        model = train(frame["text"].tolist(), frame["toxic"].to_numpy())
        return pd.DataFrame({"weight": [model.weight.astype("<f8").tobytes()], "bias": [model.bias]})

    learned = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "weight binary, bias double").collect()
    if not learned:
        return Model(np.zeros(BUCKETS), float("-inf"))
    return Model(np.frombuffer(learned[0].weight, "<f8"), learned[0].bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        scorer = Scorer(model)
        for part in slices(batches):
            scores = [scorer.score(t or "") for t in part.column(2).to_pylist()]
            yield batch_of(schema, [part.column(0), part.column(1), scores, [int(s >= threshold) for s in scores]])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Offending sentences: ``doc_id, sentence, first_word, n_words, p, words``."""
    def run(batches):
        scorer = Scorer(model)
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                p, first = scorer.sentence_scores(text or "")
                words = (text or "").split()
                ends = np.append(first[1:], len(words))
                rows += [(doc_id, int(i), int(first[i]), int(ends[i] - first[i]), float(p[i]), " ".join(words[first[i]:ends[i]]))
                         for i in np.flatnonzero(p >= threshold)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "sentence", "first_word", "n_words", "p", "words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, sentence long, first_word long, n_words long, p double, words string")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    def run(batches):
        scorer = Scorer(model)
        for part in slices(batches):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield part.filter(pa.array([scorer.score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the bounded labelled sample, then score every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
