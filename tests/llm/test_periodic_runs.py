import hashlib
import random
import zlib

from pyspark.sql import functions as F

from skyledger.llm import periodic_runs as R
from tests.llm.helpers import clashing, documents, edge_rows, empty


def brute_runs(words, least_words=6, least_exponent=4):
    """Every maximal stretch of each period, smallest periods only."""
    found = {}
    n = len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(least_words, least_exponent * q):
                if not any(s <= start and end <= e and q % p == 0 for s, e, p in found):
                    found[(start, end, q)] = True
    return sorted(((s, e - s, p) for s, e, p in found), key=lambda r: (r[0], r[2]))


def words_of(text):
    return (text or "").encode().split()


def altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = altered(doc_id, words_of(text))
    runs = brute_runs(words)
    keep = [True] * len(words)
    for s, ln, q in runs:
        for k in range(s + q, s + ln):
            keep[k] = False
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    def sha(x):
        return hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{ln},{q}\n" for s, ln, q in runs).encode()), sha(b" ".join(w for w, k in zip(words, keep) if k)))


def numbered(words):
    import numpy as np
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def random_words(rng):
    out = []
    while len(out) < rng.choice([0, 3, 9, 30, 120]):
        part = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        out += part * rng.choice([1, 1, 2, 3, 4, 5, 9]) + part[:rng.randint(0, len(part))]
        if rng.random() < 0.3 and len(out) > 4:  # a run inside runs
            out = out * rng.randint(1, 5)
        if rng.random() < 0.3 and out:
            out[rng.randrange(len(out))] = rng.choice("abcdz")
    return out[:700]


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(3)
    for _ in range(60):
        group = [random_words(rng) for _ in range(rng.randint(1, 8))]
        got = R.runs_of([numbered(w) for w in group])
        assert got == [brute_runs(w) for w in group]


def test_other_lengths_and_exponents():
    rng = random.Random(4)
    for least_words, least_exponent in ((1, 2), (2, 2), (10, 3), (6, 5), (40, 2)):
        group = [random_words(rng) for _ in range(12)]
        assert R.runs_of([numbered(w) for w in group], least_words, least_exponent) == [brute_runs(w, least_words, least_exponent) for w in group]


def test_one_word_repeated_and_chunks_split():
    assert R.runs_of([numbered(["a"] * 6000)]) == [[(0, 6000, 1)]]
    assert R.runs_of([numbered((["a"] * 2500 + ["b"]) * 5)]) == [sorted([(0, 12505, 2501)] + [(2501 * k, 2500, 1) for k in range(5)], key=lambda r: (r[0], r[2]))]
    assert R.runs_of([numbered(["a"] * 5)]) == [[]] and R.runs_of([]) == [] and R.runs_of([numbered([])]) == [[]]


def rows(spark):
    rng = random.Random(5)
    more = [(1000 + i, " ".join(random_words(rng)), "en", "a", 1) for i in range(60)]
    more += [(2000, "x \x0b y\x1cz\x85w " * 30, "en", "a", 1)]
    docs = documents(spark, 40)
    return docs.unionByName(spark.createDataFrame(more, docs.schema)), more


def test_query_equals_brute_force(spark, scratch):
    docs, _ = rows(spark)
    docs.write.parquet(scratch + "/documents.parquet")
    got = R.op11_periodic_runs(spark, scratch)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    # the longest edge text is beyond the brute force unless it was altered
    want = [expected(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 20_000]
    rows_got = [tuple(r) for r in got.collect()]
    assert len(rows_got) == docs.count()
    short = {w[0] for w in want}
    assert sorted([r for r in rows_got if r[0] in short], key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in rows_got) > 20


def test_collapse_keeps_columns_and_other_texts(spark):
    docs, more = rows(spark)
    docs = clashing(docs).withColumns({"runs": F.lit("x"), "collapsed": F.lit("y")})
    got = R.collapse(docs)
    assert got.schema == docs.schema
    old = sorted(docs.collect(), key=str)
    by_id = {r.doc_id: r.text for r in got.collect() if r.doc_id is not None}
    assert got.count() == len(old)
    for doc_id, text, *_ in [r for r in edge_rows() if r[0] is not None] + more:
        runs = R.runs_of([numbered(words_of(text))])[0]
        if not runs:
            assert by_id[doc_id] == text
        else:
            keep = R.kept_words(len(words_of(text)), runs)
            assert by_id[doc_id] == b" ".join(words_of(text)[i] for i in keep).decode()


def test_empty_table(spark, scratch):
    empty(spark).write.parquet(scratch + "/documents.parquet")
    assert R.op11_periodic_runs(spark, scratch).count() == 0
    assert R.collapse(empty(spark)).count() == 0
