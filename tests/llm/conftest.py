import random

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

# Columns of documents, and some whose names the operators use themselves.
DOCUMENT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)
CLASHING = ["row", "kept", "words", "block", "shard", "bad", "matches", "component", "starts", "h", "key", "fold", "stratum", "tree", "_doc"]
LABEL = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
ITEM = StructType([StructField("item_id", LongType()), StructField("text", StringType())])


def prose(rng, n, lang="en"):
    parts = {"en": ["the", "ing", "er", "and", "tion", "ea"], "de": ["sch", "ung", "ein", "und", "ich", "tz"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Rows of documents with whatever can be odd about them."""
    rng = random.Random(3)
    base = prose(rng, 150)
    near = base.split()
    near[70] = "other"
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(40, 160), lang), lang, f"src{i % 3}", 1) for i, lang in enumerate(["en", "de"] * 14)]
    rows += [
        (40, base, "en", "src0", 5),
        (41, base, "en", "src0", 5),
        (42, " ".join(near), "en", "src0", 5),
        (43, prose(rng, 40) + "\n" + passage, "en", None, None),
        (44, passage + " . " + prose(rng, 50), None, "src1", 5),
        (45, None, "en", "src1", None),
        (46, "", None, None, 0),
        (47, " \t\n\x0b\x0c\r ", "de", "src1", 7),
        (48, "word", "en", "src1", 4),
        (49, "a b a b a b a b a b " * 30, "en", "src1", 5),
        (50, "é ß\x1c x  y　z 'll <|endoftext|> 123\n\n  q |bar| | 文字文字 \U0001f600", "de", "src1", 5),
        (51, prose(rng, 30_000), "en", "src1", 5),
        (52, "Same line\nSame line\n\n#$%& WHAT!! IS!! | this |", "en", "src1", 5),
        (None, base, "en", "src1", 5),
        (None, None, None, None, None),
        (40, base, "en", "src0", 5),
    ]
    return rows


def _clash(frame):
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def docs(spark, rows):
    return _clash(spark.createDataFrame(rows, DOCUMENT).repartition(3))


@pytest.fixture(scope="session")
def nothing(spark):
    return _clash(spark.createDataFrame([], DOCUMENT))


@pytest.fixture(scope="session")
def labels(spark, rows):
    found = [(r[0], int(r[0] != 49), 0) for r in rows if r[0] is not None and r[0] % 2 == 0]
    return spark.createDataFrame([*found, (None, 1, None), (1, None, None), (2, 1, 0)], LABEL)


@pytest.fixture(scope="session")
def items(spark, rows):
    text = next(r[1] for r in rows if r[0] == 6)
    inside = " ".join(text.split()[5:35])
    return spark.createDataFrame([(1, inside.upper() + " ."), (2, None), (3, ""), (4, "not in any of the texts at all"), (None, "ab cd"), (1, inside)], ITEM)
