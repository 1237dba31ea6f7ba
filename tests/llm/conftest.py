import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, fp long, _id long, _sha string, _sha_of string, _source string, _whole long, _copy long, _key long, _copies long, _below long, own string, name string, cut string, copy long, text_sha256 string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 700}" for i in range(4000))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [
        (1, "Alpha beta gamma delta", "en", "b", 1, 1, 1, 1), (2, "Alpha beta gamma delta", "en", "a", 1, 1, 1, 1), (2, "Alpha beta gamma delta", "en", "a", 1, 1, 1, 1),
        (3, None, None, None, None, None, None, None), (4, "", "en", "a", 0, 0, 0, 0), (None, "no id here", "en", None, 1, 1, 1, 1), (None, None, None, None, None, None, None, None),
        (5, long, "en", "c", 1, 1, 1, 1), (6, "lead " + passage + " tail one", "en", "a", 1, 1, 1, 1), (7, "other " + passage + " tail two", "de", "c", 1, 1, 1, 1),
        (8, "\t\n \r", "en", "é", 1, 1, 1, 1), (9, "same line\nsame line\nsame line\n" + passage, "en", "a", 1, 1, 1, 1), (10, "ÄÖ ß <|endoftext|> 日本語 don't", "de", "b", 1, 1, 1, 1),
    ]
    extra = (7, "a", "b", "c", 8, 9, 10, 11, 12, "own", "name", "cut", 13, "sha")
    return spark.createDataFrame([(*r, *extra) for r in rows], ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
