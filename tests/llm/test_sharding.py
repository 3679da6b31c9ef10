import hashlib
import zlib
from collections import Counter

from skyledger.llm.sharding import interleave
from tests.llm.helpers import clashing, documents, empty


def test_shards_hold_rows_evenly_and_every_source_in_proportion(spark):
    docs = documents(spark, 400)
    rows = interleave(clashing(docs), buckets=16).collect()
    given = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == given
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    hot = {r.doc_id for r in docs.collect() if r.source == "hot"}
    share = Counter(r.shard for r in rows if r.doc_id in hot)
    assert max(share.values()) - min(share.values()) <= 2
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_result_does_not_depend_on_buckets_or_partitions(spark):
    docs = documents(spark, 80, edges=False)
    a = {tuple(r) for r in interleave(docs.repartition(5), buckets=4).collect()}
    b = {tuple(r) for r in interleave(docs.repartition(2), buckets=256).collect()}
    assert a and a == b


def test_empty_table(spark):
    assert interleave(empty(spark)).count() == 0


def brute(rows, shards=8, seed="7"):
    """One list, ranked and sorted as a whole."""
    def seeded(x):
        return int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:15], 16)

    strata, placed = {}, []
    for doc_id, text, source in rows:
        data = (text or "").encode()
        key = seeded("null" if doc_id is None else doc_id), (doc_id is not None, doc_id or 0), len(data) + 1, zlib.crc32(data)
        strata.setdefault("null" if source is None else "=" + source, []).append((key, doc_id))
    for stratum, members in strata.items():
        phase = seeded(stratum) / 2.0 ** 60
        for rank, (key, doc_id) in enumerate(sorted(members, key=lambda m: m[0])):
            placed.append(((rank + phase) / len(members), stratum, key, doc_id))
    total, out = len(placed), []
    for position, (_, _, key, doc_id) in enumerate(sorted(placed, key=lambda p: p[:3])):
        shard = position * shards // total
        first = next(i for i in range(total + 1) if i * shards // total >= shard)
        out.append((doc_id, key[2], key[3], "rows", shard, position - first, None))
    return sorted(out, key=str)


def test_order_equals_brute_force(spark):
    """Also with null and repeated ids, null sources, and fewer rows than shards."""
    docs = documents(spark, 300)
    docs = docs.unionByName(docs.filter("doc_id between 100 and 120")).unionByName(docs.filter("doc_id < 110").withColumn("source", docs.lang.substr(9, 1)))
    for part in (docs, docs.limit(5)):
        rows = [(r.doc_id, r.text, r.source) for r in part.collect()]
        for buckets in (16, 4096):
            got = interleave(spark.createDataFrame(part.collect(), part.schema), buckets=buckets).collect()
            assert sorted(map(tuple, got), key=str) == brute(rows)
