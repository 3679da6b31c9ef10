"""Quality classifier: random Fourier features of document statistics, ridge
scores from partition-summed normal equations, isotonic calibration.

Each whole text gives a short vector of statistics (lengths, byte classes,
repetition, see ``STATISTICS``); they are written once, as the text is read
once.  Standardised and clipped, they pass through ``FEATURES`` cosines with
seeded Gaussian frequencies, whose products approximate a Gaussian kernel.  Each
task sums its rows' ``z z^T`` and ``z y`` for two folds of documents; ridge scores
are solved from the sums.  The other fold's scores give every labelled row a
score that it had no part in; their counts in bins of ``BIN`` are calibrated by
pooling adjacent violators, and the result is read off between the blocks'
centres.

All labelled rows are used, there is no sample: the driver holds sums of a fixed
size.  Labels of rows that ``held_out`` marks are never read into a sum.

Defined results: null and empty texts have the statistics 0 and are scored like
any; labels other than 0 and 1 are ignored, and so is a document labelled both
ways; every row of a repeated doc_id is a row of its own; a null doc_id has no
label and is not held out; without labels every score is 0.5, with one kind of
label every score is that label; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import slices, table, written
from skyledger.llm.sums import summed

FEATURES = 256
#: Width of the kernel, in standard deviations of the statistics.
WIDTH = 4.5
RIDGE = 1e-3
CLIP = 6.0
SEED = 13
#: Raw scores are counted in bins of this width for the calibration.
BIN = 1 / 1024
LOWEST, HIGHEST = -1.0, 2.0
#: Share of the raw score in the result: it orders scores of one calibrated block.
TIE = 1e-3
CUT = 0.5

STATISTICS = ("words", "mean length", "spread of lengths", "capitals", "digits", "marks", "symbols", "shouts", "other bytes", "byte entropy",
              "distinct words", "commonest word", "repeated pairs", "repeated triples", "repeated lines", "words a line", "short words", "wordless", "longest word")

_CLASS = np.zeros((6, 256))
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b"#*$%&|<>@^~=+_\\/{}[]`", b"!")):
    _CLASS[_row, list(_bytes)] = 1
_CLASS[5, 128:] = 1
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all 0 if it has no word."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts[[9, 10, 11, 12, 13, 32]] = 0
    size = int(counts.sum())
    share = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    often = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    triples = len(set(zip(words, words[1:], words[2:])))
    lines = [line for line in data.split(b"\n") if line.strip()]
    wordless = sum(c for w, c in often.items() if not w.strip(b"0123456789.,;:'\"()-?#*$%&|<>@^~=+_\\/{}[]`!"))
    return [np.log1p(n), lengths.mean(), lengths.std(), *(_CLASS @ counts / size), -(share * np.log2(share)).sum(),
            np.log(len(often)) / np.log(n + 1), max(often.values()) / n, 1 - pairs / max(n - 1, 1), 1 - triples / max(n - 2, 1) if n > 2 else 0.0,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), (lengths <= 3).mean(), wordless / n, np.log(lengths.max())]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``statistics`` of every document."""
    def run(batches):
        for part in slices(batches):
            rows = [statistics(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "statistics"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, statistics array<double>")


def labelled(rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``statistics``, ``fold`` (0, 1) and ``label`` of the labelled rows that are not held out."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
           .filter("label = _most").drop("_most"))
    fold = (F.floor(F.crc32(F.col("doc_id").cast("string")) / 3) % 2).cast("int")
    known = rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(one, "doc_id")
    return known.select("statistics", fold.alias("fold"), "label")


def pooled(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: the blocks' mean ``x`` and share of ones."""
    blocks: list[list[float]] = []
    for at, n, k in zip(x.tolist(), total.tolist(), ones.tolist()):
        blocks.append([at * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            for i, v in enumerate(blocks.pop()):
                blocks[-1][i] += v
    sums = np.array(blocks, float).reshape(-1, 3)
    return sums[:, 0] / sums[:, 1], sums[:, 2] / sums[:, 1]


@dataclass
class Classifier:
    """Standardisation, frequencies, ridge weights (one column for each fold and
    one for all rows) and the calibration's points."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES + 1, 3)))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    share: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))
    tie: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        z = np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, column: int = 2) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights[:, column], LOWEST, HIGHEST)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return (1 - self.tie) * np.interp(raw, self.at, self.share) + self.tie * (raw - LOWEST) / (HIGHEST - LOWEST)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(rows: DataFrame, features: int = FEATURES, seed: int = SEED) -> Classifier:
    """The classifier of ``labelled`` rows; ``rows`` is read three times."""
    k = len(STATISTICS)
    each = [F.get("statistics", F.lit(i)) for i in range(k)]
    first = rows.agg(F.count("label").alias("n"), F.sum("label").alias("ones"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each)]).first()
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(size=(k, features)) / WIDTH, rng.uniform(0, 2 * np.pi, features)
    if not first.n:
        return Classifier(np.zeros(k), np.ones(k), frequencies, phases, np.zeros((features + 1, 3)))
    scale = np.array([first[f"s{i}"] for i in range(k)])
    model = Classifier(np.array([first[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0), frequencies, phases, np.zeros((features + 1, 3)))
    if first.ones in (0, first.n):
        model.share = np.full(1, float(first.ones > 0))
        return model

    def equations(batches):
        total = np.zeros((2, features + 1, features + 2))  # by fold: z z^T and z y side by side
        for part in slices(batches, 4096):
            z = model.features(_matrix(part.column(0)))
            fold, y = part.column(1).to_numpy(), part.column(2).to_numpy().astype(float)
            for f in (0, 1):
                own = z[fold == f]
                total[f] += own.T @ np.column_stack([own, y[fold == f]])
        return total

    total = summed(rows, equations, np.add, lambda a: a.tobytes(), lambda b: np.frombuffer(b).reshape(2, features + 1, features + 2))
    for column, sums in enumerate((total[1], total[0], total[0] + total[1])):  # a fold's rows are scored by the other fold's weights
        n = max(sums[-1, features], 1.0)
        penalty = RIDGE * n * np.eye(features + 1) / features
        penalty[-1, -1] = 1e-9 * n
        model.weights[:, column] = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    def scores(batches):
        for part in slices(batches, 4096):
            x, fold = _matrix(part.column(0)), part.column(1).to_numpy()
            raw = np.where(fold == 0, model.raw(x, 0), model.raw(x, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(raw / BIN).astype(np.int32)), part.column(2)], ["bin", "label"])

    bins = (rows.mapInArrow(scores, "bin int, label int").groupBy("bin").agg(F.count("label").alias("n"), F.sum("label").alias("ones"))
            .orderBy("bin").toPandas())  # at most (HIGHEST - LOWEST) / BIN rows
    model.at, model.share = pooled(bins["bin"].to_numpy() * BIN, bins["n"].to_numpy(), bins["ones"].to_numpy())
    model.tie = TIE
    return model


def scored(rows: DataFrame, model: Classifier, cut: float = CUT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every described row."""
    def run(batches):
        for part in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(model.score(_matrix(part.column(1))), 0.0, 1.0))], ["doc_id", "score"])

    return (rows.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")))


def op13_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labels of rows that are not held out, then score every document."""
    rows = written(described(table(spark, sf_dir, "documents")), "statistics")
    model = fit(written(labelled(rows, table(spark, sf_dir, "labels")), "labelled-statistics"))
    return scored(rows, model)
