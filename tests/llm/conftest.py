import pytest
from pyspark.sql import types as T

from poselytics.llm.common import prepare

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORDS = "the quick brown fox jumps over lazy dogs while seven grey geese cross an open field near old mill".split()


def prose(seed: int, n: int) -> str:
    """Deterministic sentences of about nine words, some of them on lines of their own."""
    words, x = [], seed * 2654435761 % 2**32
    for k in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        end = "" if k % 9 else (".\n" if k % 27 == 0 else ".")
        words.append(f"{WORDS[(x >> 8) % len(WORDS)]}{seed}x{(x >> 16) % 50}{end}")
    return " ".join(words)


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def texts():
    """Awkward rows: (doc_id, text). Nulls anywhere, empty and long texts, ties, repeated rows."""
    rows = [(k, prose(k, 20 + 37 * k)) for k in range(12)]
    rows += [(100, None), (101, ""), (102, " \n\t \n"), (None, prose(3, 60)), (None, None)]
    rows += [(200, prose(50, 9000))]  # long
    rows += [(k, prose(7, 400)) for k in range(300, 306)]  # copies
    rows += [(k, prose(7, 400).replace("geese", "swans", 1)) for k in range(310, 313)]  # near copies
    rows += [(400, prose(9, 100))] * 3  # one row three times
    rows += [(401, prose(10, 90)), (401, prose(11, 90))]  # one id, two texts
    rows += [(k, f"Shared line here\n{prose(k, 30)}\n  SHARED line here \t\n") for k in range(500, 512)]
    rows += [(600, "mail a.b@c-d.example.com or 10.0.0.1, +1 (386) 555-3733; 4111 1111 1111 1111. 256.1.1.1 x@y"), (601, "日本語 テスト é🙂 \x01 a b")]
    return rows


@pytest.fixture(scope="session")
def docs(llm, texts):
    rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    return llm.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(llm):
    rows = [(k, k % 2, 0) for k in range(12)] + [(k, 1, 0) for k in range(300, 306)] + [(None, 1, 0), (5, None, 1), (4, 1, 0)]
    return llm.createDataFrame(rows, "doc_id long, quality int, toxic int")
