"""MinHash near-deduplication: consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its 5-word shingles (words: runs without white
space; a shorter document is one shingle of all its words).  A shingle
weighs ``1 + ln(count)`` (a line repeated a hundred times does not make copies
of documents that differ in all else) times
``1 + ln((N + 1) / (df + 1)) / (2 ln(N + 2))``: between 1 and 1.5, so that the common text of a family with a third of all rows still
outweighs its few differences.  N counts all documents, df all documents with
a shingle of the same one of ``DF_BUCKETS`` hash buckets, a table of fixed size.

Rows with equal words are one *node*.  Consistent weighted sampling
draws ``SAMPLES`` samples (darts, see ``samples``) of each node; two nodes agree
on a sample with the probability of their weighted Jaccard similarity.  Equal
bands make nodes candidates in three steps, each after the links found so far
are joined to components:

1. every node of a band's bucket with the bucket's least node;
2. every node outside a bucket's largest component with the one that agrees
   most of at most ``CENTRES`` nodes of that component, so that a large family
   comes together at a cost in proportion to its size;
3. without any sampling, the nodes of buckets
   with several components by prefix filtering of their whole weighted shingles: what
   two similar nodes share lies behind their first common shingle in order of
   rarity, so only nodes are compared that have a rare shingle in common and
   behind it enough weight, for the weight of both, to be similar.

So all pairs of a bucket that could still join components are looked at, but a
bucket that is one family costs its size, not the square, and documents that
have one common passage and little else are not compared with each other, as
their rarest shingles lie outside it.  Candidates that agree on at least
29 samples are verified by the exact weighted Jaccard similarity
of their whole texts; those of ``SIMILARITY`` or more are
linked, and a class is a connected component.  A pair of similarity 0.8 shares
a band with probability 0.998, one of 0.85 with 0.9999.  These figures are for
0.8; ``drawn`` derives them for any least similarity of 0.2 or more.

Defined results: null text counts as empty; rows without words are one class;
in a class the row with the smallest doc_id (nulls last; of repeated rows one
by file and row) is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import PLACE, batch_of, located, slices, table, unlocated, written
from skyledger.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES = 48
#: Of pairs at the least similarity, so many may share no band, and so many too few samples.
NO_BAND, TOO_FEW = 0.0025, 0.001
#: Nodes of a bucket's largest component that step 2 offers to the others.
CENTRES = 16
DF_BUCKETS = 1 << 18
#: Ratio of neighbouring classes of weight in step 3, and what sums of doubles may differ by.
WEIGHT_STEP, _SLACK = 1.02, 1e-9
#: First nodes of pairs that a task holds at once; pairs in a part of the second ones.
BLOCK, PART_PAIRS = 64, 1 << 16
SEED = 9

#: Darts that hit, expected for each sample; of 23 texts one has a sample without, and is drawn to a later time.
DARTS = 7
#: Bytes of texts that are hashed at once.
TEXT_BYTES = 1 << 20

_U = np.uint64
_BLOCK = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _word_hashes(data: bytes) -> np.ndarray:
    """xxh64 of each word of ``data``, words parted by single spaces; words of
    less than 32 bytes all at once, in steps of 8, 4 and 1 byte."""
    size, padded = len(data), data + bytes(8)
    letters = np.frombuffer(padded, np.uint8)
    ends = np.append(np.flatnonzero(letters[:size] == 32), size)
    at = np.append(0, ends[:-1] + 1)
    left = ends - at
    long = [(int(i), data[at[i]:ends[i]]) for i in np.flatnonzero(left >= 32)]
    out = left.astype(_U) + (_U(SEED) + _P5)
    left[[i for i, _ in long]] = 0
    eights = np.ndarray(size + 1, "<u8", padded, strides=(1,))
    fours = np.ndarray(size + 1, "<u4", padded, strides=(1,))
    for step in (8, 8, 8, 4, 1, 1, 1):
        i = np.flatnonzero(left >= step)
        if not len(i):
            continue
        x, a = out[i], at[i]
        if step == 8:
            x = _rotated(x ^ (_rotated(eights[a] * _P2, 31) * _P1), 27) * _P1 + _P4
        elif step == 4:
            x = _rotated(x ^ (fours[a].astype(_U) * _P1), 23) * _P2 + _P3
        else:
            x = _rotated(x ^ (letters[a].astype(_U) * _P5), 11) * _P1
        out[i] = x
        at[i] += step
        left[i] -= step
    out = (out ^ (out >> _U(33))) * _P2
    out = (out ^ (out >> _U(29))) * _P3
    out ^= out >> _U(32)
    for i, word in long:
        out[i] = xxhash.xxh64_intdigest(word, SEED)
    return out


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(h) - size + 1, _U)
    for i in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + h[i:i + len(out)]
    return _mixed(out)


def _shingles(texts: list[str]) -> list[np.ndarray]:
    """Hash of each window of words, of texts of words parted by single spaces."""
    lengths = [t.count(b" ") + 1 if t else 0 for t in texts]
    hashes = _word_hashes(b" ".join(t for t in texts if t)) if any(lengths) else np.zeros(0, _U)
    whole, out, at = _windows(hashes, SHINGLE) if len(hashes) >= SHINGLE else None, [], 0
    for n in lengths:
        # Windows of one text; those that reach into the next one are passed over.
        out.append(whole[at:at + n - SHINGLE + 1] if n >= SHINGLE else _windows(hashes[at:at + n], n) if n else hashes[:0])
        at += n
    return out


def shingled(texts: list[str | None]):
    """The words of each text parted by single spaces (UTF-8), and the hash of
    each window of words; the texts of about ``TEXT_BYTES`` are hashed at a time."""
    waiting, size = [], 0
    for text in texts:
        waiting.append(" ".join((text or "").split()).encode())
        size += len(waiting[-1])
        if size >= TEXT_BYTES:
            yield from zip(waiting, _shingles(waiting))
            waiting, size = [], 0
    yield from zip(waiting, _shingles(waiting))


class Shingler:
    """``shingled`` for one text: digest of its words, and the hash of each window of words."""

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        words, hashes = next(shingled([text]))
        return hashlib.md5(words).digest(), hashes


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``samples_of`` for one text."""
    return samples_of([shingles], [weights])[0]


def samples_of(shingles: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Consistent weighted sampling by darts: of each text one 64-bit value a sample.

    A shingle's hash fixes a random stream of darts for each of the ranges of
    weight [0, 1), [1, 1.5), [1.5, 2.25), ...: a dart has a time, a weight in the range
    and one of the samples.  It hits a text in which the shingle weighs more
    than the dart, and a sample is the first dart that hits.  The first dart
    that hits either of two texts hits both with the probability of their weighted
    Jaccard similarity.  Only darts up to a time are drawn by which every sample
    probably has one, so a text costs its length, not its length times the samples."""
    best, chosen = np.full((len(shingles), SAMPLES), np.inf), np.zeros((len(shingles), SAMPLES), _U)
    open_texts = np.flatnonzero([len(h) > 0 for h in shingles])
    until = np.array([DARTS / max(w.sum(), 1e-300) for w in weights])
    while len(open_texts):
        h, w = (np.concatenate([of[i] for i in open_texts]) for of in (shingles, weights))
        text = np.repeat(open_texts, [len(shingles[i]) for i in open_texts])
        best[open_texts] = np.inf
        for i in range(0, len(h), _BLOCK):
            block = slice(i, i + _BLOCK)
            time, bits, of = _darts(h[block], w[block], until[text[block]], text[block])
            at = of * SAMPLES + ((bits & _U(0xFFFF)) * _U(SAMPLES) >> _U(16)).astype(np.int64)
            np.minimum.at(best.reshape(-1), at, time)
            first = time == best.reshape(-1)[at]
            chosen.reshape(-1)[at[first]] = _mixed(bits[first])
        open_texts = open_texts[np.isinf(best[open_texts]).any(1)]
        until *= 2
    return chosen


def _darts(shingles: np.ndarray, weights: np.ndarray, until: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Time, bits and text of the darts that hit before ``until``, which goes
    with the text, like the weights and the text's number, for each shingle."""
    ranges = 1 + np.ceil(np.log(np.maximum(weights, 1)) / np.log(1.5)).astype(np.int64)
    of = np.repeat(np.arange(len(shingles)), ranges)
    number = np.arange(len(of)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    powers = 1.5 ** np.arange(ranges.max())
    low, width = np.append(0, powers[:-1])[number], np.append(1, powers[:-1] / 2)[number]
    covered = (weights[of] - low) / width * 65536  # what of the range the shingle's weight covers
    stream = _mixed(shingles[of] + number.astype(_U) * _U(0xD6E8FEB86659FD93))
    rate, time, until, text, at, step, out = -SAMPLES * width, np.zeros(len(of)), until[of], text[of], 1, 1, []
    while len(stream):
        bits = _mixed(stream[:, None] + np.arange(at, at + step).astype(_U) * _U(0x9E3779B97F4A7C15))
        times = np.log(1 - ((bits >> _U(32)) + 0.5) * 2.0 ** -32) / rate[:, None]
        times[:, 0] += time
        times = np.cumsum(times, 1)
        row, column = np.nonzero(times < until[:, None])
        hit_bits = bits[row, column]
        hits = (hit_bits >> _U(16) & _U(0xFFFF)) + 0.5 < covered[row]
        row, column = row[hits], column[hits]
        out.append((times[row, column], hit_bits[hits], text[row]))
        on = np.flatnonzero(times[:, -1] < until)
        time, at = times[on, -1], at + step
        stream, covered, rate, until, text = stream[on], covered[on], rate[on], until[on], text[on]
        step = min(at - 1, 1024)
    return tuple(np.concatenate(x) for x in zip(*out))


def drawn(similarity: float) -> tuple[int, int]:
    """Samples in a band, and samples that two nodes must agree on, for pairs of
    at least ``similarity``: the widest bands and the most samples that lose
    no more of them than ``NO_BAND`` and ``TOO_FEW``.  At 0.8: 4 and 29."""
    if not 0.2 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.2 and 1")
    rows = max(r for r in (1, 2, 3, 4, 6, 8) if (1 - similarity ** r) ** (SAMPLES // r) <= NO_BAND)
    below, least = 0.0, 0
    while least < SAMPLES:
        below += comb(SAMPLES, least) * similarity ** least * (1 - similarity) ** (SAMPLES - least)
        if below > TOO_FEW:
            break
        least += 1
    return rows, least


def _bands(chosen: np.ndarray, rows: int) -> np.ndarray:
    """Of texts by samples: keys of texts by bands."""
    bands = SAMPLES // rows
    out = np.tile(np.arange(1, bands + 1).astype(_U), (len(chosen), 1))
    for column in np.moveaxis(chosen.reshape(-1, bands, rows), 2, 0):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _counted(shingles: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their dampened counts and their weight for one occurrence."""
    distinct, count = np.sort(shingles), np.ones(len(shingles))
    first = np.append(True, distinct[1:] != distinct[:-1])[:len(distinct)]
    if not first.all():
        at = np.flatnonzero(first)
        distinct, count = distinct[at], 1 + np.log(np.diff(np.append(at, len(distinct))))
    return distinct, count, idf[(distinct & _U(DF_BUCKETS - 1)).astype(np.int64)]


def weighted_jaccard(a, b) -> float:
    (ha, ca, wa), (hb, cb, wb) = a, b
    at = np.searchsorted(ha, hb)  # both are sorted and distinct
    both = at < len(ha)
    both[both] = ha[at[both]] == hb[both]
    ia = at[both]
    least = float((np.minimum(ca[ia], cb[both]) * wa[ia]).sum())
    most = float((ca * wa).sum() + (cb * wb).sum()) - least
    return least / most if most else 1.0


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of one occurrence by hash bucket, from every document."""
    def count(batches):
        counts, n = np.zeros(DF_BUCKETS, np.int64), 0
        for part in slices(batches):
            each = [np.sort((h & _U(DF_BUCKETS - 1)).astype(np.int32)) for _, h in shingled(part.column(0).to_pylist())]
            for b in each:
                if len(b):
                    counts[b[np.append(True, b[1:] != b[:-1])]] += 1
            n += len(each)
        if n:
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], n), pa.int64())], ["bucket", "n"])

    rows = (docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # at most DF_BUCKETS + 1 rows
    df, n = np.zeros(DF_BUCKETS), int(rows["n"][rows["bucket"] == -1].sum())
    real = rows[rows["bucket"] >= 0]
    df[real["bucket"].to_numpy(np.int64)] = real["n"]
    return 1 + np.log((n + 1) / (df + 1)) / (2 * np.log(n + 2))


def _signatures(docs: DataFrame, idf: np.ndarray, rows: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("_file", pa.string()), ("_row", pa.int64()), ("digest", pa.binary()),
                        ("signature", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for part in slices(batches):
            digests, shingles, weights = [], [], []
            for words, h in shingled(part.column(3).to_pylist()):
                distinct, count, weight = _counted(h, idf)
                digests.append(hashlib.md5(words).digest())
                shingles.append(distinct)
                weights.append(count * weight)
            chosen = samples_of(shingles, weights)
            signatures, bands = (chosen >> _U(32)).astype(np.uint32).view(np.int32), _bands(chosen, rows)
            yield batch_of(schema, [*part.columns[:3], digests, *([x if len(h) else [] for x, h in zip(of, shingles)] for of in (signatures, bands))])

    return docs.select(F.col("doc_id").cast("long"), *PLACE, F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, _file string, _row long, digest binary, signature array<int>, bands array<long>")


def _agreeing(pairs: DataFrame, signature: DataFrame, least: int) -> DataFrame:
    """The pairs ``(a, b)`` that agree on enough samples, with their number."""
    same = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (pairs.join(signature.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
            .join(signature.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a")
            .select("a", "b", same.alias("same")).filter(F.col("same") >= least))


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose texts are similar enough; ``pairs``
    is a written table.

    The first nodes are dealt into blocks of about ``BLOCK`` and the second
    ones into parts.  A text goes once to each block and part that needs it,
    not once for each pair: a task keeps the first nodes of a block and streams
    the part's second nodes, each with its partners, past them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        at, held = None, {}
        for batch in slices(batches):
            rows, columns = [], [c.to_pylist() for c in batch.columns]
            for *key, node, partners, (_, h) in zip(*columns[:-1], shingled(columns[-1])):
                if key != at:
                    at, held = key, {}
                counted = _counted(h, idf)
                if not partners:
                    held[node] = counted
                rows += [(a, node, value) for a in partners if (value := weighted_jaccard(held[a], counted)) >= similarity]
            if rows:
                yield batch_of(schema, list(zip(*rows)))

    n, firsts = pairs.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    blocks, parts = max(1, firsts // BLOCK), max(16, n // PART_PAIRS)
    keyed = pairs.select(F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part"), "a", "b")
    first = keyed.select("block", "part", F.col("a").alias("node")).distinct().withColumn("partners", F.array().cast("array<long>"))
    second = keyed.groupBy("block", "part", F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))  # at most a block
    return (first.unionByName(second).join(texts, "node").select("block", "part", "node", "partners", "text")
            .repartition("block", "part").sortWithinPartitions("block", "part", F.size("partners") > 0)
            .mapInArrow(run, "a long, b long, similarity double"))


def _central_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of each node outside its bucket's largest component with at most
    ``CENTRES`` nodes of that component, from ``band, key, node, component``."""
    key = ["band", "key"]
    counts = placed.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = (counts.groupBy(key).agg(F.max(F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("components"))
               .filter("components > 1").select(*key, F.col("largest.component").alias("largest")))
    met = written(placed.join(largest, key), "near-placed")
    centres = (met.filter("component = largest").groupBy(*key, F.pmod(F.xxhash64("node", "band"), F.lit(CENTRES)).alias("part"))
               .agg(F.min("node").alias("b")).drop("part"))
    return met.filter("component != largest").select(*key, F.col("node").alias("a")).join(centres, key).select("a", "b").distinct()


def _rarest_shingles(nodes: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """``node, component, shingle, weight, rest``: the shingles of each of
    ``nodes (node, component)`` that come first when they are ordered by the
    number of nodes that have them, with the node's whole weight and the weight
    from this shingle on, as long as that is ``similarity`` of the whole.

    The first common shingle of two nodes so similar is among these of both, as
    all that they share lies from there on."""
    schema = pa.schema([("node", pa.int64()), ("shingle", pa.int64()), ("weight", pa.float64())])

    def weigh(batches):
        for part in slices(batches):
            numbers, hashes, weights = [], [], []
            for node, (_, h) in zip(part.column(0).to_pylist(), shingled(part.column(1).to_pylist())):
                distinct, count, weight = _counted(h, idf)
                numbers.append(np.full(len(distinct), node, np.int64))
                hashes.append(distinct.view(np.int64))
                weights.append(count * weight)
            yield batch_of(schema, [np.concatenate(x) for x in (numbers, hashes, weights)])

    weighed = written(texts.join(nodes.select("node"), "node").select("node", "text").mapInArrow(
        weigh, "node long, shingle long, weight double"), "near-shingles")
    common = weighed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    by_node = W.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)).desc(), "shingle")
    rows = weighed.join(common, "shingle", "left").withColumn("rest", F.sum("weight").over(by_node.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("weight", F.max("rest").over(W.partitionBy("node")))
    first = rows.filter("n > 1").filter(F.col("rest") >= F.col("weight") * (similarity * (1 - _SLACK)))
    return written(first.select("node", "shingle", "weight", "rest").join(nodes.select("node", "component"), "node"), "near-rarest")


def _open_pairs(nodes: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes (node, component)`` in different components,
    with every pair of at least ``similarity``.

    What two nodes share weighs at most the lesser ``rest`` at their first
    common shingle, so the similarity bounds the sum of their weights by
    ``most`` of either.  The heavier node looks for lighter ones in the classes of
    weight that leaves; a shingle that a whole family has thus meets few pairs."""
    rows = _rarest_shingles(nodes, texts, idf, similarity).withColumn("most", F.col("rest") * ((1 + similarity) / similarity * (1 + _SLACK)))

    def weight_class(weight):
        return F.floor(F.log(weight) / float(np.log(WEIGHT_STEP))).cast("long")

    low, high = F.col("weight") * (similarity * (1 - _SLACK)), F.least("weight", F.col("most") - F.col("weight"))
    heavier = rows.filter(high >= low).select(
        "shingle", F.explode(F.sequence(weight_class(low), weight_class(high))).alias("class"),
        F.col("node").alias("a"), F.col("component").alias("ca"), F.col("weight").alias("wa"), F.col("most").alias("ma"))
    lighter = rows.select("shingle", weight_class(F.col("weight")).alias("class"), F.col("node").alias("b"), F.col("component").alias("cb"),
                          F.col("weight").alias("wb"), F.col("most").alias("mb"))
    pairs = heavier.join(lighter, ["shingle", "class"]).filter(
        "ca != cb AND (wb < wa OR wb = wa AND a < b) AND wa + wb <= ma AND wa + wb <= mb")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document with its locator: ``doc_id, class_id, class_size,
    kept, _file, _row``, of the columns ``doc_id, text``."""
    docs, (band, least) = located(docs.select("doc_id", "text")), drawn(similarity)
    idf = document_frequencies(docs)
    rows = written(_signatures(docs, idf, band), "near-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *PLACE)
    nodes = written(rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"),
                                               F.first("signature").alias("signature"), F.first("bands").alias("bands"))
                    .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = written(nodes.select("node", F.posexplode("bands").alias("band", "key"))
                      .groupBy("band", "key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("members"))
                      .filter("members > 1"), "near-buckets")
    members = nodes.select("node", F.posexplode("bands").alias("band", "key")).join(buckets, ["band", "key"])
    signature = nodes.select("node", "signature")

    def texts_of(pairs):
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        places = nodes.join(wanted, "node").select("node", F.col("first._file").alias("_file"), F.col("first._row").alias("_row"))
        return written(docs.select(*PLACE, "text").join(places, PLACE).select("node", "text"), "near-texts")

    stars = members.filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(_agreeing(stars, signature, least).select("a", "b"), "near-stars")
    links = written(_verified(stars, texts_of(stars), idf, similarity), "near-links")
    component = components(links.select("a", "b"))

    def placed():
        return members.select("band", "key", "node").join(component, "node", "left").withColumn(
            "component", F.coalesce("component", "node"))

    def joined(pairs, texts):
        known = component.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return components(known.unionByName(_verified(pairs, texts, idf, similarity).select("a", "b")))

    central = written(_agreeing(_central_pairs(placed()), signature, least).groupBy("a").agg(
        F.max_by("b", F.struct("same", "b")).alias("b")).join(stars, ["a", "b"], "left_anti"), "near-central")
    if not central.isEmpty():
        component = joined(central, texts_of(central))

    # What is left: buckets whose members are still in different components.
    several = placed().groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    still = written(placed().join(several, ["band", "key"]).select("node", "component").distinct(), "near-open")
    seen = stars.unionByName(central.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    open_texts = texts_of(still.select(F.col("node").alias("a"), F.col("node").alias("b")))
    more = written(_agreeing(_open_pairs(still, open_texts, idf, similarity), signature, least).select("a", "b")
                   .join(seen, ["a", "b"], "left_anti"), "near-more")
    if not more.isEmpty():
        component = joined(more, open_texts)

    classes = nodes.select("node", "digest", "first", "size").join(component, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    kept = classes.groupBy("component").agg(F.min("first").alias("keep"), F.sum("size").alias("class_size"))
    of_digest = classes.join(kept, "component").select("digest", "keep", "class_size")
    return rows.select("doc_id", *PLACE, "digest").join(of_digest, "digest").select(
        "doc_id", F.col("keep.doc_id").alias("class_id"), "class_size",
        (F.struct("_file", "_row") == F.struct("keep._file", "keep._row")).alias("kept"), *PLACE)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The kept documents, with all columns of ``docs``."""
    places = located(docs)
    dropped = near_classes(places.select("doc_id", "text")).filter(~F.col("kept")).select(*PLACE)
    return unlocated(places.join(dropped, PLACE, "left_anti"), docs.columns)


def op9_weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    return near_classes(table(spark, sf_dir, "documents")).drop(*PLACE)
