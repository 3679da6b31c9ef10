"""Language identification: Bayesian fusion of text, markup, address and host.

For each document and page the posterior of a language is the product of

* the text's likelihood under the language's multinomial of byte trigrams
  (hashed, lower case), learned from every document whose language is given,
  to the power ``TEMPER`` as trigrams overlap;
* the likelihood of the declared markup language (``lang`` of the page's html
  element) and of the address suffix (last label of the host), learned as
  smoothed counts of (evidence, language) over all pages;
* the host's prior: language counts of the host's other rows, smoothed towards
  the counts of its domain (last two labels), and these towards all rows'.

Counts for markup, suffixes, hosts and domains are sums of the text-only
posteriors, by grouped aggregation.  A row's own share is taken out of its
host's and domain's counts.  A document has no markup or address; its source
is its host.  Languages are those of the given labels: the ``MAX_LANGUAGES``
most frequent ones by name, and one further class, ``OTHER``, learned from the
documents of all further labels, so that none of these is taken for a frequent one.

Defined results: null or empty text has no text evidence, so the priors decide;
null urls and sources have no host; no labels at all give null languages; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import batch_of, slices, table, written

BUCKETS = 1 << 16
TEMPER = 1 / 3
#: Rows' worth of weight that a level of the host hierarchy gets from the level above.
SMOOTHING = 5.0
MAX_LANGUAGES = 200
#: The class of all less frequent labels (ISO 639-2: languages without a code of their own).
OTHER = "mis"
LEAST_PROBABILITY = 0.5
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>")
_DECLARED = r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    x = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(16)).astype(np.int64)


def page_text(page: str) -> str:
    return html_module.unescape(_MARKUP.sub(" ", page))


def languages_of(docs: DataFrame, most: int = MAX_LANGUAGES) -> list[str]:
    """The ``most`` most frequent labels, and ``OTHER`` if there are further ones."""
    rows = (docs.filter("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).count()
            .orderBy(F.desc("count"), "lang").limit(most + 1).collect())
    return sorted({r.lang for r in rows[:most]} | ({OTHER} if len(rows) > most else set()))


def text_model(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probability of each bucket by language, from every labelled document."""
    number = {lang: i for i, lang in enumerate(languages)}
    other = number.get(OTHER)

    def count(batches):
        sums = {}
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                at = number.get(lang, other) if lang is not None else None
                if at is not None and text:
                    sums.setdefault(at, np.zeros(BUCKETS, np.int64))[:] += np.bincount(trigrams(text), minlength=BUCKETS)
        for i, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["language", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    found = (docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "language int, bucket int, n long")
             .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas())  # at most languages x buckets
    counts[found["language"].to_numpy(), found["bucket"].to_numpy()] = found["n"]
    return (np.log(counts + 0.5) - np.log((counts + 0.5).sum(1, keepdims=True))).astype(np.float32)


def rows_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and page: key columns, host, evidence and text."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract(F.col("html").cast("string"), _DECLARED, 1))
    text = F.lit(None).cast("string")
    page = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
                        host.alias("host"), F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.lit(1), F.size(F.split(host, r"\.")) - 1), 2), ".").alias("domain"),
                        F.when(declared != "", declared).alias("declared"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), F.col("html").cast("string").alias("text"))
    source = F.concat(F.lit("source:"), F.col("source").cast("string"))
    document = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"),
                           source.alias("host"), source.alias("domain"), text.alias("declared"), text.alias("suffix"), F.col("text").cast("string").alias("text"))
    return document.unionByName(page)


def _likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Replaces the text by ``loglik``, tempered, one number a language."""
    keys = ["kind", "doc_id", "page_id", "host", "domain", "declared", "suffix"]
    types = {"doc_id": ("long", pa.int64()), "page_id": ("long", pa.int64())}
    schema = pa.schema([*((k, types.get(k, ("string", pa.string()))[1]) for k in keys), ("loglik", pa.list_(pa.float64()))])

    def run(batches):
        for part in slices(batches):
            out = []
            for kind, text in zip(part.column(0).to_pylist(), part.column(len(keys)).to_pylist()):
                at = trigrams((page_text(text) if kind == "page" else text) if text else "")
                out.append((model[:, at].sum(1, dtype=np.float64) * TEMPER).tolist())
            yield batch_of(schema, [*part.columns[:len(keys)], out])

    return rows.select(*keys, "text").mapInArrow(
        run, ", ".join(f"{k} {types.get(k, ('string', 0))[0]}" for k in keys) + ", loglik array<double>")


def _softmax(logits: Column) -> Column:
    return F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))


def _normal(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The summed text-only posteriors of each key, one array."""
    parts = rows.groupBy(*keys).agg(*(F.sum(F.col("own")[i]).alias(f"_{i}") for i in range(n)))
    return parts.select(*keys, F.array(*(F.col(f"_{i}") for i in range(n))).alias(name))


def identify(docs: DataFrame, pages: DataFrame, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """``kind, doc_id, page_id, lang, probability, text_lang, kept``."""
    languages = languages_of(docs, max_languages)
    n = len(languages)
    model = text_model(docs, languages)
    # The text-only posterior is the row's share of every count.
    scored = written(_likelihoods(rows_of(docs, pages), model).withColumn("own", _normal(_softmax(F.col("loglik"))) if n else F.col("loglik")),
                     "language-rows")
    if not n:
        none = F.lit(None).cast("string")
        return scored.select("kind", "doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), F.lit(False).alias("kept"))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    total = scored.agg(*(F.sum(F.col("own")[i]) for i in range(n))).first()
    total = np.array([x or 0.0 for x in total])
    overall = F.array(*(F.lit(float(x)) for x in (total + 1) / (total + 1).sum()))
    zero = F.array(*(F.lit(0.0) for _ in range(n)))

    def smoothed(counts: Column, above: Column) -> Column:
        """Counts without the row's own share, with the level above as pseudo-counts."""
        others = F.zip_with(F.coalesce(counts, F.col("own")), "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
        return _normal(plus(others, F.transform(above, lambda p: p * SMOOTHING)))

    def evidence(column: str) -> Column:
        """Log likelihood of a markup language or suffix: its smoothed share of each language's pages."""
        at = reduce(plus, [F.coalesce(F.col(f"of_{column}"), zero)])
        value = F.zip_with(at, F.array(*(F.lit(float(x)) for x in page_total)), lambda x, y: F.log((x + 0.5) / (y + 0.5 * 20)))
        return F.when(F.col(column).isNull(), zero).otherwise(value)

    page_sum = scored.filter("kind = 'page'").agg(*(F.sum(F.col("own")[i]) for i in range(n))).first()
    page_total = [x or 0.0 for x in page_sum]
    of_page = scored.filter("kind = 'page'")
    joined = (scored.join(_sums(scored, ["host"], n, "of_host"), "host", "left").join(_sums(scored, ["domain"], n, "of_domain"), "domain", "left")
              .join(_sums(of_page, ["declared"], n, "of_declared"), "declared", "left").join(_sums(of_page, ["suffix"], n, "of_suffix"), "suffix", "left"))
    prior = smoothed(F.col("of_host"), smoothed(F.col("of_domain"), overall))
    logits = plus(plus(F.col("loglik"), F.transform(prior, lambda p: F.log(p + 1e-9))), plus(evidence("declared"), evidence("suffix")))
    names = F.array(*(F.lit(x) for x in languages))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    of_text = F.array_position("own", F.array_max("own")).cast("int")
    return (joined.withColumn("logits", logits).withColumn("posterior", _normal(_softmax(F.col("logits"))))
            .select("kind", "doc_id", "page_id", F.element_at(names, best).alias("lang"), F.array_max("posterior").alias("probability"),
                    F.when(F.exists("loglik", lambda x: x != 0), F.element_at(names, of_text)).alias("text_lang"))
            .withColumn("kept", F.col("probability") >= LEAST_PROBABILITY))


def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``documents`` and ``pages``."""
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
