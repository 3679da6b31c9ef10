"""Token-id files with keyed access through a minimal perfect hash.

``write_files`` encodes documents, deals them into shards by ranges of
ascending doc_id and writes, in the shared folder,

* ``shard-NNNNNN.ids``: the raw ids of its documents, little-endian uint16,
  each document's ids followed by the end id, nothing else;
* ``shard-NNNNNN.off``: little-endian int64 token offsets, one more than rows;
* ``index-NNNNNN.npz``: keys dealt by hash.  A minimal perfect hash maps each
  key of the file to its own slot without storing keys; the slot holds a
  32-bit fingerprint (a key that was never added is recognised by it, but for
  one chance in 2**32), the shard, the first row and the number of rows.

The hash has levels of bits: a key whose bit on a level is set by no other key
ends there, and its slot is the number of set bits before; the others go on to
the next level.  A lookup is a constant number of probes, one offset pair and
one read.  Files are written under a temporary name and then moved, so a task
that is run again replaces what it wrote.

Defined results: null text counts as empty (one end id).  Rows with the same
doc_id lie side by side, ordered by their ids, under one key; a null doc_id is
a key too and comes first.  An empty table gives no files and no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import tokens
from skyledger.llm.common import batch_of, run_folder, slices, table, written

END_ID = 1
SHARD_ROWS = 4096
INDEX_KEYS = 65_536
#: Bits a key on each level of the hash.
GAMMA = 2.0
_MAX_LEVELS = 64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mix of 64-bit keys, one function for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits of each level; all levels' bits, packed
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        ones = np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(1) if len(bits) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.words = bits.view("<u8")

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], np.unique(keys.astype(np.uint64))
        while len(left):
            if len(sizes) == _MAX_LEVELS:
                raise ValueError("keys that no level can tell apart")
            size = int(-(-len(left) * GAMMA // 64) * 64)
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 (or some slot) for a key that was not added."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.base[level] + (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(low)
            left = left[~hit]
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _folder(uri: str):
    """The shared folder's file system and path; any store pyarrow can open."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, *parts: bytes) -> None:
    import uuid
    fs, folder = _folder(uri)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    fs.move(part, f"{folder}/{name}")


def _get(uri: str, name: str) -> bytes:
    fs, folder = _folder(uri)
    with fs.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


@dataclass
class KeyIndex:
    """One index file: the rows of its keys."""

    hash: PerfectHash
    fingerprint: np.ndarray
    shard: np.ndarray
    row: np.ndarray
    rows: np.ndarray
    null: np.ndarray  # shard, row and rows of the null key, if it is here

    @classmethod
    def build(cls, keys, shard, row, rows, null) -> KeyIndex:
        h = PerfectHash.build(keys)
        order = np.empty(len(keys), np.int64)
        order[h.slots(keys)] = np.arange(len(keys))
        return cls(h, _fingerprints(keys)[order], shard[order], row[order], rows[order], null)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.hash.sizes, bits=self.hash.bits, fingerprint=self.fingerprint, shard=self.shard,
                 row=self.row, rows=self.rows, null=self.null)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> KeyIndex:
        x = np.load(io.BytesIO(data))
        return cls(PerfectHash(x["sizes"], x["bits"]), x["fingerprint"], x["shard"], x["row"], x["rows"], x["null"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are here, and their slots."""
        slots = self.hash.slots(keys)
        known = slots >= 0
        known[known] = self.fingerprint[slots[known]] == _fingerprints(keys[known])
        return known, slots


def _encoded(docs: DataFrame, vocabulary: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder = tokens.word_bpe(vocabulary)
        for part in slices(batches):
            doc_ids, ids = part.column(0), encoder.encode([t or "" for t in part.column(1).to_pylist()])
            shard = np.searchsorted(bounds, doc_ids.fill_null(0).to_numpy(), side="left")
            shard[doc_ids.is_null().to_numpy(zero_copy_only=False)] = 0
            yield batch_of(schema, [shard, doc_ids, [np.append(x, np.uint16(end_id)).astype("<u2").tobytes() for x in ids]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "shard long, doc_id long, ids binary")


def write_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID,
                shard_rows: int = SHARD_ROWS, index_keys: int = INDEX_KEYS) -> tuple[DataFrame, int]:
    """Write the files; the manifest ``(shard, rows, tokens, start)`` and the number of index files."""
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    shards, indexes = max(1, -(-n // shard_rows)), max(1, -(-n // index_keys))
    cuts = [i / shards for i in range(1, shards)]
    bounds = np.unique(np.array(ids.approxQuantile("doc_id", cuts, 0.1 / shards) if cuts else [], np.int64))

    def write(batches):
        """Streams one shard after the other; offsets are all that it holds."""
        def close():
            _put(folder, f"shard-{shard:06d}.off", np.append(0, np.cumsum(lengths)).astype("<i8").tobytes())
            out.close()
            fs.move(part, f"{path}/shard-{shard:06d}.ids")

        import uuid
        fs, path = _folder(folder)
        fs.create_dir(path, recursive=True)
        shard = out = None
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("row", pa.int64()), ("tokens", pa.int64())])
        for batch in slices(batches, 4096):
            rows = []
            for s, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if out is not None:
                        close()
                    shard, lengths, part = s, [], f"{path}/.shard-{s:06d}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                out.write(raw)
                rows.append((doc_id, s, len(lengths), len(raw) // 2))
                lengths.append(len(raw) // 2)
            if rows:
                yield batch_of(schema, list(zip(*rows)))
        if out is not None:
            close()

    rows = written(_encoded(docs, vocabulary, end_id, bounds).repartition(len(bounds) + 1, "shard")
                   .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
                   .mapInArrow(write, "doc_id long, shard long, row long, tokens long"), "token-rows")

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        null = frame["doc_id"].isna().to_numpy()
        columns = {c: frame[c].to_numpy(np.int64) for c in ("shard", "row", "rows")}
        keys = frame["doc_id"][~null].to_numpy(np.int64)
        built = KeyIndex.build(keys, *(columns[c][~null] for c in columns), np.array([x[null] for x in columns.values()]).ravel())
        number = int(frame["index"].iloc[0])
        _put(folder, f"index-{number:06d}.npz", built.dump())
        return pd.DataFrame({"index": [number], "keys": [len(frame)]})

    keys = rows.groupBy("doc_id", "shard").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
    made = (keys.withColumn("index", _index_of(indexes))
            .groupBy("index").applyInArrow(_as_frames(index), "index long, keys long"))
    manifest = [(r.shard, r.rows, r.tokens) for r in
                rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens")).orderBy("shard").collect()]
    made.write.format("noop").mode("overwrite").save()
    starts = np.concatenate([[0], np.cumsum([m[2] for m in manifest])]).astype(int).tolist()
    return docs.sparkSession.createDataFrame([(*m, s) for m, s in zip(manifest, starts)],
                                             "shard long, rows long, tokens long, start long"), indexes


def _index_of(indexes: int):
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(indexes)), F.lit(0)).cast("long")


def _as_frames(f):
    """Integers stay integers beside nulls."""
    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(f(t.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)), preserve_index=False)
    return run


def read_documents(keys: DataFrame, folder: str, indexes: int, manifest: DataFrame) -> DataFrame:
    """Keyed access: for each distinct key that the files hold, its documents'
    ``(doc_id, start, n_tokens, ids)`` with uint16 ids.  Keys are looked up in
    their index file; what they point to is read shard by shard."""
    def find(frame: pd.DataFrame) -> pd.DataFrame:
        at = KeyIndex.load(_get(folder, f"index-{int(frame['index'].iloc[0]):06d}.npz"))
        null = frame["doc_id"].isna().to_numpy()
        known = frame[~null]
        here, slots = at.find(known["doc_id"].to_numpy(np.int64))
        slots = slots[here]
        out = pd.DataFrame({"doc_id": known["doc_id"][here].astype("Int64"), "shard": at.shard[slots], "row": at.row[slots],
                            "rows": at.rows[slots]})
        if null.any() and len(at.null):
            out = pd.concat([out, pd.DataFrame({"doc_id": pd.array([None], "Int64"), **dict(zip(("shard", "row", "rows"), at.null[:, None]))})])
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    starts = {r.shard: r.start for r in manifest.collect()}

    def read(batches):
        fs, path = _folder(folder)
        shard = payload = None
        for batch in slices(batches):
            out = []
            for s, doc_id, row, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if payload is not None:
                        payload.close()
                    shard, payload = s, fs.open_input_file(f"{path}/shard-{s:06d}.ids")
                    offsets = np.frombuffer(_get(folder, f"shard-{s:06d}.off"), "<i8")
                for r in range(row, row + rows):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    out.append((doc_id, starts[s] + a, b - a, payload.read_at(2 * (b - a), 2 * a)))
            if out:
                yield batch_of(schema, list(zip(*out)))

    found = (keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("index", _index_of(indexes))
             .groupBy("index").applyInArrow(_as_frames(find), "doc_id long, shard long, row long, rows long"))
    return (found.select("shard", "doc_id", "row", "rows").repartition(max(1, len(starts)), "shard")
            .sortWithinPartitions("shard", "row").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        crc = [zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes()) for b in batch.column(3).to_pylist()]
        yield batch_of(schema, [*batch.columns[:3], crc])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all ``documents``, then look every doc_id up in them."""
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark, "token-files")
    manifest, indexes = write_files(docs, folder)
    return read_documents(docs, folder, indexes, manifest).mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
