"""Small tables with the awkward rows every operator must take."""
from pyspark.sql import Row, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her".split()


def prose(seed: int, n: int) -> str:
    import random
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "ly", str(rng.randint(0, 99))])
        out.append(w + (".\n" if i % 90 == 89 else "." if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n").rstrip("\n")


def edge_rows() -> list[tuple]:
    return [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3),
            (4, "one", "en", None, 3), (5, "same text here", "en", "a", 14), (5, "same text here", "en", "a", 14),
            (6, "same  text here ", "en", "b", 16), (None, "no id", "en", "b", 5), (7, prose(1, 30_000), "en", "a", 1),
            (8, "éü 🙂 日本 \x00\x1c x", "fr", "b", 3)]


def documents(spark: SparkSession, n: int = 60, edges: bool = True):
    rows = [(100 + i, prose(i, 20 + 13 * (i % 40)), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(n)]
    return spark.createDataFrame(rows + (edge_rows() if edges else []), SCHEMA)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Extra columns whose names operators may use inside."""
    from pyspark.sql import functions as F
    for name in ("item", "ids", "shard", "bucket", "digest", "kept", "score", "n", "class_id", "stratum"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
