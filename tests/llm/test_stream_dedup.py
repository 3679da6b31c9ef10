import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skyledger.llm import stream_dedup as D
from tests.llm.helpers import clashing, documents, empty


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", r.text or ""), []).append(r)
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id))
        for i, r in enumerate(members):
            out.append((r.doc_id, keep.doc_id, len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.fixture()
def docs(spark):
    docs = documents(spark, 40)
    copies = docs.filter("doc_id between 100 and 104").withColumn("doc_id", F.col("doc_id") + 1000)
    spaced = copies.withColumn("text", F.concat(F.lit(" \t"), F.regexp_replace("text", " ", "\n"))).withColumn("doc_id", F.col("doc_id") + 1000)
    many = spark.range(600).join(docs.filter("doc_id = 103").drop("doc_id")).select(*[(F.col("id") + 5000).alias("doc_id") if c == "doc_id" else c for c in docs.columns])
    return docs.unionByName(copies).unionByName(spaced).unionByName(many)


@pytest.mark.parametrize("files,digest", [(1, D.sha256), (100, lambda t: F.substring(D.sha256(t), 1, 1))])
def test_equals_brute_force(spark, docs, files, digest):
    """Over several micro-batches, and with digests that collide."""
    got = D.deduplicate(clashing(docs).repartition(3), digest, files).collect()
    want, groups = brute(docs.collect())
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_kept_documents_have_all_columns(spark, docs):
    kept = D.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == brute(docs.collect())[1]


def test_empty_table(spark):
    assert D.deduplicate(empty(spark)).count() == 0


def test_main_path_has_no_python(spark, docs):
    plan = D.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_called_like_locators_and_the_least_id(spark):
    """``_file``, ``_row`` and ``_metadata`` are the table's own; -2**63 has no negation."""
    least = -2 ** 63
    rows = [(least, "a b", "f0", 10, "m0"), (5, "ab", "f1", 11, "m1"), (least, "x", "f2", 12, None), (None, "x", "f3", 13, "m3"),
            (2 ** 63 - 1, "y", None, None, "m4"), (least + 1, "y", "f5", 15, "m5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _FILE string, _row int, _metadata string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in D.deduplicate(docs).collect()), key=str)
    assert got == sorted([(least, least, 2), (5, least, 2), (least, least, 2), (None, least, 2), (2 ** 63 - 1, least + 1, 2), (least + 1, least + 1, 2)], key=str)
    kept = D.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[5]], key=str)
    path = D.run_folder(spark, "test-locators")
    docs.write.parquet(path)
    read = spark.read.parquet(path)
    assert sorted(map(tuple, D.keep_first(read).collect()), key=str) == sorted([rows[0], rows[2], rows[5]], key=str)
