import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from skyledger.llm import token_files as T
from skyledger.llm.common import run_folder
from tests.llm.helpers import clashing, documents, empty


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 5000)
    h = T.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(5000))
    at = T.KeyIndex.load(T.KeyIndex.build(keys, keys, keys, keys, np.zeros(0)).dump())
    known, slots = at.find(keys)
    assert known.all() and (at.row[slots] == keys).all()
    assert not at.find(np.arange(2**62, 2**62 + 2000))[0].any()
    assert not T.KeyIndex.build(keys[:0], keys[:0], keys[:0], keys[:0], np.zeros(0)).find(keys)[0].any()


def test_files_round_trip(spark):
    docs = documents(spark)
    folder = run_folder(spark, "test")
    manifest, indexes = T.write_files(clashing(docs), folder, shard_rows=16, index_keys=20)
    assert manifest.count() > 3 and indexes > 3
    got = T.read_documents(docs, folder, indexes, manifest).collect()
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [(r.doc_id, np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u2").tobytes()) for r in docs.collect()]
    assert sorted([(r.doc_id, bytes(r.ids)) for r in got], key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 2
        at += r.n_tokens
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda x: (x is not None, x))
    some = T.read_documents(spark.createDataFrame([(104,), (10**9,)], "doc_id long"), folder, indexes, manifest).collect()
    assert [r.doc_id for r in some] == [104]
    digests = spark.createDataFrame(some, "doc_id long, start long, n_tokens long, ids binary").mapInArrow(
        T._digests, "doc_id long, start long, n_tokens long, ids_crc32 long").first()
    assert digests.ids_crc32 == zlib.crc32(np.frombuffer(some[0].ids, "<u2").astype("<u4").tobytes())


def test_empty_table(spark):
    folder = run_folder(spark, "test")
    manifest, indexes = T.write_files(empty(spark), folder)
    assert manifest.count() == 0
    assert T.read_documents(empty(spark), folder, indexes, manifest).count() == 0
