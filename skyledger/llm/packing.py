"""Packing: lexical retrieval packing into windows of at most 1,024 tokens.

A document's ids are its text's ids followed by the end id.  Every full
window's worth of a long document is a sequence of its own; what remains (1 to
1,023 ids, a *tail*) is packed with tails that share its vocabulary.  Tails
are dealt into shards of about ``shard_rows``; in each shard a BM25 inverted
index over token ids returns the unused neighbours of a seed, best first, and
they fill the seed's window.  The neighbour that does not fit is cut; its rest
seeds the next window, so only the last window of a shard needs padding.

Document frequencies, mean length and row count of the BM25 weights come from
all tails of the corpus; their size is bounded by the vocabulary (at most
65,536 entries), as is the table that says how tails are dealt.  Tails are
dealt by their rarest-hash token (a one-value min-hash), which keeps near
copies and like texts together; a token with more tails than a shard holds is
split evenly by row number, so a hot group is spread over many tasks.

Defined results: null text counts as empty (one end id); null and repeated
doc_ids keep their own pieces, row by row; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import tokens
from skyledger.llm.common import batch_of, ragged, slices, table, written

WINDOW = 1024
END_ID = 0
SHARD_ROWS = 2048
#: A term that more than this share of a shard's tails hold gets a row of weights instead of postings.
COMMON = 1 / 8
K1, B = 1.2, 0.75
_ENCODED = ("item long, doc_id long, start long, length long, doc_tokens long, route int, "
            "ids_crc32 long, ids binary")
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _mixed(terms: np.ndarray) -> np.ndarray:
    x = terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per full window (crc only) and per tail (its ids, uint16)."""
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("route", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder, item = tokens.byte_bpe(vocabulary), TaskContext.get().partitionId() << 40
        for part in slices(batches):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                ids = np.append(ids, np.uint16(end_id))
                full = len(ids) // window * window
                for at in range(0, full, window):
                    rows.append((item, doc_id, at, window, len(ids), None, ids_crc32(ids[at:at + window]), None))
                    item += 1
                if full < len(ids):
                    tail = ids[full:]
                    route = int(tail[np.argmin(_mixed(tail))])
                    rows.append((item, doc_id, full, len(tail), len(ids), route, None, tail.tobytes()))
                    item += 1
            if rows:
                yield batch_of(schema, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ENCODED)


def _frequencies(batches):
    """Partial document frequencies: one row per token and task."""
    counts, rows, length = np.zeros(65536, np.int64), 0, 0
    for batch in batches:
        for ids in batch.column(0).to_pylist():
            ids = np.frombuffer(ids, np.uint16)
            counts[np.unique(ids)] += 1
            rows, length = rows + 1, length + len(ids)
    if rows:
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-2, -1]), pa.int32()),
                                          pa.array(np.append(counts[found], [rows, length]), pa.int64())], ["token", "n"])


class ShardIndex:
    """BM25 inverted index over the tails of one shard."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        rows, terms, weights = [], [], []
        for i, ids in enumerate(tails):
            term, tf = np.unique(ids, return_counts=True)
            rows.append(np.full(len(term), i, np.int32))
            terms.append(term)
            weights.append(idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length)))
        self.n, self.terms = len(tails), terms
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = np.concatenate(rows)[order], np.concatenate(weights)[order]
        self.first = np.searchsorted(term[order], np.arange(65537))
        common = np.flatnonzero(np.diff(self.first) > COMMON * self.n)  # their rows are at most 1 / COMMON times the postings
        self.row_of, self.common = np.full(65536, -1), np.zeros((len(common), self.n))
        self.row_of[common] = np.arange(len(common))
        for i, t in enumerate(common):
            at = slice(self.first[t], self.first[t + 1])
            self.common[i, self.rows[at]] = self.weights[at]

    def scores(self, row: int) -> np.ndarray:
        """BM25 of every row against all terms of ``row``."""
        query = self.terms[row].astype(np.int64)
        common = self.row_of[query]
        query = query[common < 0]
        start, length = self.first[query], self.first[query + 1] - self.first[query]
        rare = np.bincount(ragged(self.rows, start, length), ragged(self.weights, start, length), self.n)
        return rare + self.common[common[common >= 0]].sum(0)


def pack_shard(lengths: np.ndarray, scores, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(sequence, row, start within the tail, length, offset) for each piece.

    Seeds are taken longest first.  ``scores(row)`` ranks the neighbours; if
    none with a shared term is left, the next unused row fills the window."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    unused, taken, pieces = np.ones(n, bool), np.zeros(n, np.int64), []
    at = sequence = 0
    carried = -1
    while True:
        while at < n and not unused[order[at]]:
            at += 1
        row = carried if carried >= 0 else int(order[at]) if at < n else -1
        if row < 0:
            return pieces
        carried, offset, rest = -1, 0, at
        ranked, next_ranked = None, 0
        while True:
            take = int(min(window - offset, lengths[row] - taken[row]))
            pieces.append((sequence, row, int(taken[row]), take, offset))
            taken[row] += take
            offset += take
            unused[row] = False
            if taken[row] < lengths[row]:
                carried = row
            if offset == window:
                break
            if ranked is None:
                score = np.where(unused, scores(row), 0.0)
                found = np.flatnonzero(score > 0)
                ranked = found[np.argsort(-score[found], kind="stable")]
            if next_ranked < len(ranked):
                row = int(ranked[next_ranked])
                next_ranked += 1
                continue
            while rest < n and not unused[order[rest]]:
                rest += 1
            if rest == n:
                break
            row = int(order[rest])
        sequence += 1


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, window: int = WINDOW,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset)`` of all documents; see the module text."""
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    encoded = written(encode_documents(docs, vocabulary, end_id, window), "packing")
    tails = encoded.filter(F.col("ids").isNotNull())
    counts = {r.token: r.n for r in (tails.select("ids").mapInArrow(_frequencies, "token int, n long")
                                     .groupBy("token").agg(F.sum("n").alias("n")).collect())}
    n, length = counts.pop(-2, 0), counts.pop(-1, 0)
    df = np.zeros(65536)
    df[list(counts)] = list(counts.values())
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean_length = max(1.0, length / max(1, n))

    # At most one row per token of the vocabulary.
    layout, shard, room = [], 0, shard_rows
    for route, m in sorted((r.route, r["count"]) for r in tails.groupBy("route").count().collect()):
        if m > shard_rows:  # its own shards, after the one that is being filled
            parts = -(-m // shard_rows)
            shard, room = shard + (room < shard_rows), shard_rows
            layout.append((route, shard, parts))
            shard += parts
        else:
            if m > room:
                shard, room = shard + 1, shard_rows
            layout.append((route, shard, 1))
            room -= m
    dealt = spark.createDataFrame(layout or [(-1, 0, 1)], "route int, first int, parts int")

    def pack_one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", ignore_index=True)
        ids = [np.frombuffer(b, np.uint16) for b in frame["ids"]]
        index = ShardIndex(ids, idf, mean_length)
        shard = int(frame["shard"].iloc[0])
        out = pd.DataFrame(pack_shard(np.array([len(x) for x in ids]), index.scores, window),
                           columns=["sequence", "row", "from", "length", "offset"])
        rows = frame.iloc[out["row"]].reset_index(drop=True)
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "start": rows["start"] + out["from"], "length": out["length"],
            "ids_crc32": [ids_crc32(ids[r][a:a + m]) for r, a, m in zip(out["row"], out["from"], out["length"])],
            "doc_tokens": rows["doc_tokens"], "sequence_id": (shard << 33 | out["sequence"]) * 2 + 1,
            "offset": out["offset"]})

    packed = (tails.join(F.broadcast(dealt), "route")
              .withColumn("shard", F.col("first") + F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
              .select("shard", "item", "doc_id", "start", "doc_tokens", "ids")
              .groupBy("shard").applyInPandas(pack_one, _PIECES))
    alone = encoded.filter(F.col("ids").isNull()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("item") * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical retrieval packing of all ``documents``."""
    return pack(table(spark, sf_dir, "documents"))
