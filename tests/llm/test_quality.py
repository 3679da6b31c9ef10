import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skyledger.llm import quality as Q
from tests.llm.helpers import clashing, documents, empty, prose

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed)


def test_base_counts_equal_brute_force(spark):
    docs = documents(spark).unionByName(spark.createDataFrame(
        [(900, "a b c a b c d\n\n x \nx\n x ", "en", "s", 1), (901, "w " * 70, "en", "s", 1), (902, "a\x0bb\x1cc \x85d#*<>|", None, None, None),
         (903, " ".join(f"w{i % 40}" for i in range(90)), "en", "s", 1)], documents(spark).schema))
    model = Q.Importance(np.zeros(Q.BUCKETS), float("-inf"))
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.judge(clashing(docs), model).collect())
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not brute(r.text)[-1] for r in docs.collect())


def test_windows_of_very_many_words():
    numbers = np.random.default_rng(1).integers(0, 9, 400)
    assert Q.repeated_words(numbers) == Q.repeated_words(numbers + (1 << 21))


def test_ratio_equals_brute_force_counts(spark):
    docs = documents(spark, 30, edges=False)
    labels = spark.createDataFrame([(100 + i, int(i < 10), 0) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    memo = Q.Words()
    for r in docs.collect():
        found = np.bincount(memo.buckets(memo.numbers(r.text.encode().split())), minlength=Q.BUCKETS)
        raw += found
        target += found * (r.doc_id < 110)
    want = np.log((target + 1) / (target.sum() + Q.BUCKETS)) - np.log((raw + 1) / (raw.sum() + Q.BUCKETS))
    assert np.allclose(model.ratio, want)


def test_rejects_junk_and_keeps_good_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.judge(docs, Q.fit(docs, labels)).collect()}
    rows = [(r.quality, got[r.doc_id]) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert np.mean([x.kept for q, x in rows if q == 1]) > 0.99
    assert np.mean([x.kept for q, x in rows if q == 0]) < 0.05


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judge(empty(spark), Q.fit(empty(spark), none)).count() == 0
    docs = documents(spark, 5)
    assert all(r.kept != r.base_failed for r in Q.judge(docs, Q.fit(docs, none)).collect())
    assert prose(1, 3)


def test_trusted_documents_are_those_that_occur(spark):
    """Labels of ids that are not in the table (dropped by an earlier stage) take no place in the sample; repeated ids count once for the threshold."""
    docs = documents(spark, 30, edges=False)
    docs = docs.unionByName(docs.filter("doc_id = 105"))
    ids = [100 + i for i in range(10)]
    usable = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    gone = spark.createDataFrame([(10_000 + i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    want, got = Q.fit(docs, usable), Q.fit(docs, usable.unionByName(gone), len(ids))
    assert np.array_equal(want.ratio, got.ratio) and want.ratio.any() and want.threshold == got.threshold > float("-inf")


def test_held_out_labels(spark):
    """Every third label is not shown to the fit."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.judge(docs, Q.fit(docs, labels.filter("doc_id % 3 != 1"))).collect()}
    rows = [(r.quality, got[r.doc_id]) for r in labels.filter("doc_id % 3 = 1").collect() if not got[r.doc_id].base_failed]
    assert np.mean([x.kept for q, x in rows if q == 1]) > 0.97
    assert np.mean([x.kept for q, x in rows if q == 0]) < 0.1


def test_every_trusted_document_counts(spark):
    n = 20_050  # all trusted: the target is the corpus, so no ratio differs from 0
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 500).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert not Q.fit(docs, labels).ratio.any()


def test_quantile_of_the_lowest_rows(spark):
    values = np.random.default_rng(3).normal(size=2_500)
    rows = spark.createDataFrame([(float(v),) for v in values], "value double")
    assert abs(Q.quantile(rows, "value", 0.001) - np.quantile(values, 0.001)) < 1e-12
    assert Q.quantile(rows.limit(1), "value", 0.001) == rows.first().value and Q.quantile(rows.limit(0), "value", 0.5) == float("-inf")
