import corpus_pipeline as C
from skyledger.llm import near_dedup
from tests.llm import test_near_dedup, test_quality, test_stream_dedup
from tests.llm.helpers import clashing, documents, prose


def test_run_equals_brute_force(spark, scratch, monkeypatch):
    """Each stage on what the brute force keeps of the stage before; no labels, so that no model drops a document."""
    docs = documents(spark, 20)
    rows = [(3000 + i, prose(900, 240) + " " * (i % 2) + f" end{i // 2}", "en", "x", 1) for i in range(6)]
    clashing(docs.unionByName(spark.createDataFrame(rows, docs.schema))).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    stages, written = [], C.written

    def kept(df, name):
        stages.append(written(df, name))
        return stages[-1]

    monkeypatch.setattr(C, "written", kept)
    packed = C.run(spark, scratch).collect()
    given = spark.read.parquet(f"{scratch}/documents.parquet")
    good, clean, exact, near = (s.collect() for s in stages[:4])

    def ids(rows):
        return sorted((r.doc_id for r in rows), key=str)

    assert len(stages) == len(C.STAGES) and all(s.columns == given.columns for s in stages[:4])
    assert ids(good) == ids(r for r in given.collect() if not test_quality.brute(r.text)[-1])
    assert ids(clean) == ids(good)
    assert ids(exact) == sorted({keep for _, keep, _, _ in test_stream_dedup.brute(clean)[0]}, key=str)
    classes = test_near_dedup.brute(exact, near_dedup.document_frequencies(stages[2]))
    assert len(near) == len(classes) < len(exact) < len(clean) and all(len({r.doc_id for r in near} & set(c)) == 1 for c in classes)
    assert {r.doc_id for r in packed} == {r.doc_id for r in near}
    for r in near:
        pieces = [p for p in packed if p.doc_id == r.doc_id]
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens


def test_empty_tables(spark, scratch):
    spark.createDataFrame([], documents(spark, 1).schema).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    assert C.run(spark, scratch).count() == 0
