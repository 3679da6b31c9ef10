import tracemalloc

import numpy as np
import zlib

from skyledger.llm import toxicity as X
from tests.llm.helpers import clashing, documents, empty, prose

SF = "/root/testdata/sf0.1"


def test_sentences_are_located_from_document_labels(spark):
    """Only documents are labelled; the sentence that holds the word is found."""
    rows, labels = [], []
    for i in range(240):
        lines = [prose(1000 * i + k, 12) for k in range(9)]
        if i % 4 == 0:
            lines[i % 9] = lines[i % 9].replace(" ", " blargish ", 1)
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, documents(spark).schema)
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in X.score(clashing(docs), model).collect()}
    for doc_id, _, toxic in labels:
        assert got[doc_id].predicted == toxic
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
    found = X.locate(docs, model).collect()
    assert {r.doc_id for r in found} == {d for d, _, t in labels if t} and all("blargish" in r.words for r in found)
    clean = X.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == 180


def test_score_equals_plain_noisy_or():
    rng = np.random.default_rng(2)
    model = X.Model(rng.normal(size=X.BUCKETS), -1.0)
    text = "One two. Three four\nfive! six " + "seven " * 100
    words = [line.split() for line in text.split("\n")]
    sentences = [["One", "two."], ["Three", "four"], ["five!"]] + [("six " + "seven " * 100).split()[i:i + X.SENTENCE_WORDS] for i in range(0, 101, X.SENTENCE_WORDS)]
    keep = 1.0
    for s in sentences:
        keep *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weight[f] for w in s for f in X.features(w)))))
    assert sum(map(len, words)) == sum(map(len, sentences))
    assert abs(X.Scorer(model).score(text) - (1 - keep)) < 1e-9


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in X.score(docs, X.fit(docs, labels)).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([x.predicted for t, x in held if t]) > 0.65
    assert np.mean([x.predicted for t, x in held if not t]) < 0.01


def test_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, 5)
    got = X.score(docs, X.fit(docs, none)).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.0}
    assert X.score(empty(spark), X.fit(empty(spark), none)).count() == 0


def test_long_documents_are_learned_from(spark):
    """Clean documents of more than 20,000 characters, with a word that short ones have only where they are toxic."""
    rows, labels = [], []
    for i in range(120):
        long, toxic = i % 3 == 0, i % 3 == 1
        lines = [prose(1000 * i + k, 12) for k in range(450 if long else 9)]
        for k in range(0, len(lines), 9):
            lines[k] = lines[k].replace(" ", " blargish " if toxic else " snorfle " if long else " ", 1)
        if toxic:
            lines[1] += " snorfle"
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, documents(spark).schema)
    assert all(len(r[1]) > 20_000 for r in rows[::3])
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    held = [(t, got[d].predicted) for d, _, t in labels if got[d].held_out]
    assert len(held) > 20 and all(t == p for t, p in held)


def test_the_sample_is_not_chosen_by_length(spark, monkeypatch):
    """Where the characters run out the list ends; no shorter document goes before."""
    seen = []
    monkeypatch.setattr(X, "SAMPLE_CHARS", 100)
    docs = spark.createDataFrame([(i, ("long " * 100 if i % 4 == 0 else "short one ") + str(i), None, None, 0) for i in range(40)], documents(spark).schema)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    made = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, *a, **k: (seen.append(rows), made(rows, *a, **k))[1])
    X.fit(docs, labels, 12, 12)
    order = [r.doc_id for r in docs.filter("crc32(string(doc_id)) % 3 != 1 AND doc_id % 2 = 0").orderBy(X.F.xxhash64("doc_id"), "doc_id").collect()]
    room, want = 1200, []
    for d in order[:12]:
        room -= len(("long " * 100 if d % 4 == 0 else "short one ") + str(d))
        if room < 0:
            break
        want.append(d)
    assert [d for d, t in seen[-1] if t == 0] == want


def test_memory_of_the_fit(monkeypatch):
    """Features of all words of all documents at once, 75 bytes a word of these texts."""
    monkeypatch.setattr(X, "STEPS", 2)
    texts = [prose(i, 600) for i in range(300)]
    labels = np.arange(300) % 4 == 0
    tracemalloc.start()
    X.train(texts, labels.astype(int))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * 600 * 50


def test_documents_with_a_feature():
    words, texts = X.Words(), ["toxic Toxic. words", "", "toxicity", "other words other"]
    numbers = [words.sentences(t)[0] for t in texts]
    document = np.repeat(np.arange(4), [len(x) for x in numbers])
    want = np.zeros(X.BUCKETS, int)
    for t in texts:
        want[list({f for w in t.split() for f in X.features(w)})] += 1
    assert np.array_equal(X._documents_with(np.concatenate(numbers), document, words, 4), want)
