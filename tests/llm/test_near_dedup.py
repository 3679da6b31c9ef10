import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyledger.llm import near_dedup as N
from skyledger.llm.components import components
from tests.llm.helpers import clashing, documents, empty, prose


def edited(text, n, seed):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture()
def docs(spark):
    docs = documents(spark, 40)
    rows = [(2000 + 50 * g + i, edited(prose(900 + g, 240), i % 6, 100 * g + i), "en", "x", 1) for g in range(4) for i in range(40)]
    passage = prose(77, 60)
    rows += [(4000 + i, passage + " " + prose(5000 + i, 25), "en", "x", 1) for i in range(40)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def brute(rows, idf):
    shingler = N.Shingler()
    given = [shingler(r.text or "") for r in rows]
    sets = [N._counted(h, idf) for _, h in given]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = given[i][0] == given[j][0] or (len(given[i][1]) and len(given[j][1]) and N.weighted_jaccard(sets[i], sets[j]) >= 0.8)
            if same and root(i) != root(j):
                parent[root(i)] = root(j)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i), []).append(r.doc_id)
    return sorted((sorted(c, key=str) for c in classes.values()), key=str)


def test_classes_equal_brute_force(spark, docs):
    got = N.near_classes(clashing(docs)).collect()
    idf = N.document_frequencies(docs)
    classes = {}
    for r in got:
        classes.setdefault((r.class_id, r.class_size) if r.class_id is not None else "none", []).append(r)
    want = brute(docs.collect(), idf)
    none = [c for c in want if None in c]
    assert sorted((sorted((r.doc_id for r in c), key=str) for k, c in classes.items() if k != "none"), key=str) == [c for c in want if c not in none or any(x is not None for x in c)]
    assert sum(r.kept for r in got) == len(want)
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_samples_agree_as_often_as_documents_are_similar():
    rng = np.random.default_rng(4)
    agree, want = [], []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = np.unique(h[:300]), np.unique(h[60:])
        w = {int(x): float(rng.uniform(1, 9)) for x in h}
        wa, wb = np.array([w[int(x)] for x in a]), np.array([w[int(x)] * rng.uniform(0.5, 2) for x in b])
        agree.append((N.samples(a, wa) == N.samples(b, wb)).mean())
        va, vb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
        keys = set(va) | set(vb)
        want.append(sum(min(va.get(k, 0), vb.get(k, 0)) for k in keys) / sum(max(va.get(k, 0), vb.get(k, 0)) for k in keys))
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (7, 8, 9)} == {7}
    assert {got[100 + i] for i in range(31)} == {100} and 20 not in got


def test_empty_table(spark):
    assert N.near_classes(empty(spark)).count() == 0


def test_repeated_line_does_not_make_copies():
    idf, shingler = np.full(N.DF_BUCKETS, 1.2), N.Shingler()
    a, b = (N._counted(shingler(prose(seed, 60) + " one line that comes back." * 300)[1], idf) for seed in (1, 2))
    assert N.weighted_jaccard(a, b) < 0.5


def test_columns_called_like_locators(spark):
    rows = [(1, prose(1, 60), "f", "r", 7), (2, prose(1, 60) + " end", "f", "r", 8), (3, prose(2, 60), None, "r", 9)]
    kept = N.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _file string, _ROW string, _metadata int"))
    assert kept.columns == ["doc_id", "text", "_file", "_ROW", "_metadata"]
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_figures_follow_the_similarity(spark):
    """Planted pairs of 0.55 and more are linked when 0.5 is asked for."""
    assert N.drawn(0.8) == (4, 29) and N.drawn(0.5) == (2, 13) and N.drawn(0.95)[0] == 8 and N.drawn(1)[1] == 48
    with pytest.raises(ValueError):
        N.drawn(0.1)
    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
        other = list(words)
        for at in rng.choice(range(5, 195), 8, replace=False):
            other[at] = "changed" + str(at)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf, shingler, text = N.document_frequencies(docs), N.Shingler(), dict(rows)
    pairs = {i: N.weighted_jaccard(*(N._counted(shingler(text[j])[1], idf) for j in (2 * i, 2 * i + 1))) for i in range(60)}
    wanted = {i for i, s in pairs.items() if s >= 0.5}
    assert len(wanted) > 40 and max(pairs.values()) < 0.8
    got = {r.doc_id: r.class_id for r in N.near_classes(docs, 0.5).collect()}
    assert {i for i in range(60) if got[2 * i] == got[2 * i + 1]} == wanted
    assert all(r.class_id == r.doc_id for r in N.near_classes(docs).collect())


def test_family_just_below_the_similarity_is_not_compared_in_pairs(spark, monkeypatch):
    """120 versions of a text, 0.7 to 0.8 similar, and a few true links among them."""
    rows = [(i, edited(prose(901, 240), 6, 500 + i)) for i in range(120)]
    rows += [(1000 + i, edited(rows[i][1], 2, 900 + i)) for i in range(0, 120, 12)]
    docs, counts, write = spark.createDataFrame(rows, "doc_id long, text string"), {}, N.written

    def written(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out
    monkeypatch.setattr(N, "written", written)
    classes = {}
    for r in N.near_classes(docs).collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    want = brute(docs.collect(), N.document_frequencies(docs))
    assert sorted((sorted(c, key=str) for c in classes.values()), key=str) == want
    assert len(want) > 60 and counts["near-more"] < 1500  # of some 8,000 pairs


def test_open_pairs_hold_every_similar_pair(spark):
    rng, rows = random.Random(3), []
    for g in range(6):
        base = prose(40 + g, 60 + 60 * g)
        for i in range(30):
            words = edited(base, rng.randint(0, 9), 10 * i + g).split(" ")
            rows.append((100 * g + i, " ".join(words[rng.randint(0, 12):len(words) - rng.randint(0, 12)]) + " again again again again again again" * rng.randint(0, 4)))
    texts = spark.createDataFrame(rows, "node long, text string")
    idf, shingler = N.document_frequencies(texts), N.Shingler()
    sets = {node: N._counted(shingler(text)[1], idf) for node, text in rows}
    for similarity in (0.8, 0.5):
        want = {(a, b) for a in sets for b in sets if a < b and a % 7 != b % 7 and N.weighted_jaccard(sets[a], sets[b]) >= similarity}
        nodes = texts.select("node", (F.col("node") % 7).alias("component"))
        got = {(r.a, r.b) for r in N._open_pairs(nodes, texts, idf, similarity).collect()}
        assert want and want <= got


def test_word_hashes_are_xxh64():
    rng = random.Random(8)
    words = ["é", "日本", "🙂", "\x00"] + ["".join(rng.choice("abcxyzäß日🙂") for _ in range(n)) for n in range(1, 40) for _ in range(8)]
    assert [int(x) for x in N._word_hashes(" ".join(words).encode())] == [xxhash.xxh64_intdigest(w, N.SEED) for w in words]


def test_shingles_of_many_texts_equal_those_of_one(monkeypatch):
    texts = [None, "", "one", "a b", "a b c d e", prose(1, 300), " \n\t", "x\x1cy  z", prose(2, 7), prose(3, 2000)]
    for size in (1, 1 << 20):
        monkeypatch.setattr(N, "TEXT_BYTES", size)
        got = list(N.shingled(texts))
        assert [w.decode() for w, _ in got] == [" ".join((t or "").split()) for t in texts]
        for text, (_, h) in zip(texts, got):
            n = len((text or "").split())
            assert len(h) == (n - N.SHINGLE + 1 if n >= N.SHINGLE else min(n, 1))
            assert np.array_equal(h, N.Shingler()(text)[1])


def test_samples_of_many_texts_equal_those_of_one(monkeypatch):
    rng = np.random.default_rng(6)
    shingles = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (3, 0, 1, 500, 40, 2000)]
    weights = [rng.uniform(0.5, 12, len(h)) for h in shingles]
    want = [N.samples(h, w) for h, w in zip(shingles, weights)]
    monkeypatch.setattr(N, "_BLOCK", 97)
    assert np.array_equal(N.samples_of(shingles, weights), want) and not want[1].any() and all(x.all() for i, x in enumerate(want) if i != 1)


def test_samples_cost_the_length_not_its_product_with_their_number():
    h = np.unique(np.random.default_rng(7).integers(0, 1 << 63, 4000, dtype=np.uint64))
    w = np.full(len(h), 1.3)
    N.samples(h, w)
    tracemalloc.start()
    N.samples(h, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 300  # drawing every sample for every shingle held 48 times 40 bytes a shingle
