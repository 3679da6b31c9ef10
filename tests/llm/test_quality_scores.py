import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import quality_scores as Q
from tests.conftest import SF01
from tests.llm.helpers import SCHEMA, clashing, documents, edge_rows, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def junk(seed, n):
    rng = random.Random(seed)
    return rng.choice([" ".join(["The"] * n), prose(seed, n).upper().replace(" ", "!! "), prose(seed, n).replace(" ", "&&& "), prose(seed, n).replace(" ", " | ")])


def corpus(spark, n=240):
    rows = [(i, prose(i, 30 + i % 200) if i % 4 else junk(i, 30 + i % 90), "en", "a", 1) for i in range(10, n + 10)]
    labels = [(i, int(bool(i % 4)), 0) for i in range(10, n + 10)]
    return spark.createDataFrame(rows + edge_rows(), SCHEMA), spark.createDataFrame(labels, LABELS)


def saved(docs, labels, scratch):
    docs.write.mode("overwrite").parquet(scratch + "/documents.parquet")
    labels.write.mode("overwrite").parquet(scratch + "/labels.parquet")
    return scratch


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_accuracy_on_given_tables(spark):
    got = Q.op13_fourier_quality(spark, SF01)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(SF01 + "/documents.parquet").count()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    score = {r.doc_id: r.score for r in rows if r.held_out}
    labels = [(r.quality, score[r.doc_id]) for r in spark.read.parquet(SF01 + "/labels.parquet").collect() if r.doc_id in score]
    good, bad = [s for y, s in labels if y == 1], [s for y, s in labels if y == 0]
    assert len(bad) > 5 and sum(s >= 0.5 for s in good) >= 0.97 * len(good) and sum(s < 0.5 for s in bad) >= 0.9 * len(bad)
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.99


def test_weights_equal_a_direct_solution(spark):
    rows = Q.labelled(Q.described(corpus(spark)[0]), corpus(spark)[1]).repartition(5).cache()
    model = Q.fit(rows)
    kept = rows.collect()
    x, y, fold = np.array([r.statistics for r in kept]), np.array([r.label for r in kept], float), np.array([r.fold for r in kept])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
    z = np.hstack([np.sqrt(2 / Q.FEATURES) * np.cos(np.clip((x - model.mean) / model.scale, -Q.CLIP, Q.CLIP) @ model.frequencies + model.phases), np.ones((len(x), 1))])
    for column, use in enumerate((fold == 1, fold == 0, fold >= 0)):
        a, b = z[use], y[use]
        penalty = np.diag([Q.RIDGE * len(a) / Q.FEATURES] * Q.FEATURES + [1e-9 * len(a)])
        assert np.allclose(a @ np.linalg.solve(a.T @ a + penalty, a.T @ b), a @ model.weights[:, column], atol=1e-6)
    # the products of features approximate the Gaussian kernel
    rng = np.random.default_rng(1)
    big = Q.Classifier(model.mean, model.scale, rng.normal(size=(x.shape[1], 8192)) / Q.WIDTH, rng.uniform(0, 2 * np.pi, 8192))
    s = np.clip((x - big.mean) / big.scale, -Q.CLIP, Q.CLIP)[:40]
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * Q.WIDTH ** 2))
    f = big.features(x[:40])[:, :-1]
    assert np.abs(f @ f.T - kernel).max() < 0.06


def test_pooling_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 14))
        total = rng.integers(1, 5, n)
        ones = np.array([rng.integers(0, t + 1) for t in total])
        at, share = Q.pooled(np.arange(n, dtype=float), total, ones)
        mean = lambda i, j: ones[i:j + 1].sum() / total[i:j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]  # min-max formula
        assert np.all(np.diff(share) > 0) and np.all(np.diff(at) > 0)
        counts = np.diff(np.append(np.flatnonzero(np.diff(want, prepend=-1) > 1e-12), n))
        assert np.allclose(np.repeat(share, counts), want)


def test_held_out_labels_and_other_columns_are_not_used(spark, scratch):
    docs, labels = corpus(spark)
    first = {(r.doc_id, r.score) for r in Q.op13_fourier_quality(spark, saved(docs, labels, scratch)).collect()}
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = clashing(docs).withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "statistics": F.lit("x"), "label": F.lit("x"), "fold": F.lit("x")})
    second = {(r.doc_id, r.score) for r in Q.op13_fourier_quality(spark, saved(other, turned, scratch)).collect()}
    assert {d for d, _ in first} == {d for d, _ in second}
    a, b = dict(first), dict(second)
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a if k is not None)


def test_edge_rows_and_labels(spark, scratch):
    docs, labels = corpus(spark)
    extra = spark.createDataFrame([(None, 0, 0), (11, None, 0), (12, 7, 0), (13, 0, 0), (13, 1, 0), (14, 1, 0), (99999, 0, 0)], LABELS)
    got = Q.op13_fourier_quality(spark, saved(docs, labels.unionByName(extra), scratch)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.doc_id is None for r in got) == 2 and not any(r.held_out for r in got if r.doc_id is None)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[5]) == 1 and by_id[1] == by_id[2] == by_id[3]  # a repeated row; null, empty and blank texts


@pytest.mark.parametrize("quality, want", [(None, 0.5), (1, 1.0), (0, 0.0)])
def test_no_or_one_kind_of_label(spark, scratch, quality, want):
    docs, labels = corpus(spark, 30)
    got = Q.op13_fourier_quality(spark, saved(docs, labels.withColumn("quality", F.lit(quality).cast("int")), scratch)).collect()
    assert {r.score for r in got} == {want} and {r.predicted for r in got} == {int(want >= 0.5)}


def test_empty_table(spark, scratch):
    assert Q.op13_fourier_quality(spark, saved(empty(spark), spark.createDataFrame([], LABELS), scratch)).count() == 0
    assert Q.statistics(None) == Q.statistics(" \n") == [0.0] * len(Q.STATISTICS)
