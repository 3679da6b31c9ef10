import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from skyledger.llm.packing import ShardIndex, pack, pack_shard
from tests.llm.helpers import clashing, documents, empty


def test_pieces_cover_every_id_once(spark):
    docs = documents(spark)
    got = pack(clashing(docs), shard_rows=16).collect()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    want = {}
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.setdefault(r.doc_id, []).append(np.array(ids, "<u4"))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        fits = [x for x in want[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in [zlib.crc32(x[r.start:r.start + r.length].tobytes()) for x in fits]
    for doc_id, texts in want.items():
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(sum(r.length for r in rows) < 1024 for rows in sequences.values()) <= 8  # one a shard


def test_empty_table(spark):
    assert pack(empty(spark)).count() == 0


def test_scores_equal_bm25_and_neighbours_are_retrieved():
    rng = np.random.default_rng(3)
    tails = [rng.integers(50 * (i % 3), 50 * (i % 3) + 60, 300).astype(np.uint16) for i in range(30)]
    df = np.zeros(65536)
    for t in tails:
        df[np.unique(t)] += 1
    idf = np.log1p((30 - df + 0.5) / (df + 0.5))
    index = ShardIndex(tails, idf, 300.0)
    want = []
    for t in tails:
        s = 0.0
        for term in np.unique(tails[4]):
            tf = int((t == term).sum())
            s += idf[term] * tf * 2.2 / (tf + 1.2)
        want.append(s)
    assert np.allclose(index.scores(4), want)
    pieces = pack_shard(np.full(30, 300), index.scores)
    together = {}
    for sequence, row, _, _, _ in pieces:
        together.setdefault(sequence, set()).add(row % 3)
    assert sum(len(x) == 1 for x in together.values()) >= 6  # windows hold one vocabulary


def test_all_terms_of_a_long_seed_are_scored():
    rng = np.random.default_rng(5)
    own = np.arange(1000, 1100)  # the rarest: in the seed alone
    shared = np.arange(2000, 2300)
    tails = [np.concatenate([own, shared]), shared[250:], np.arange(3000, 3400)] + [
        rng.choice(np.arange(2000, 6000), 300) for _ in range(37)]
    tails = [t.astype(np.uint16) for t in tails]
    df = np.zeros(65536)
    for t in tails:
        df[np.unique(t)] += 1
    idf, mean = np.log1p((40 - df + 0.5) / (df + 0.5)), np.mean([len(t) for t in tails])
    index = ShardIndex(tails, idf, mean)
    for seed in (0, 2, 7):
        want = []
        for t in tails:
            terms, tf = np.unique(t, return_counts=True)
            mine = np.isin(terms, tails[seed])
            want.append((idf[terms] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)))[mine].sum())
        assert np.allclose(index.scores(seed), want)
    assert index.scores(0)[1] > 0
    lengths = np.array([1000, 50, 400] + [300] * 37)
    pieces = pack_shard(lengths, index.scores, 1024)
    assert [row for sequence, row, *_ in pieces if sequence == 0][:2] == [0, 1]
