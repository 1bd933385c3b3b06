import pytest

TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "Hello  World\nhello world",
    "the cat sat on the mat and the dog sat on the log while it rained all day long",
    "the cat sat on the mat and the dog sat on the log while it rained all day long",
    "The cat sat on the mat and the dog sat on the log while it rained all day  long",
    "naïve café — ünïcödé ñandú x\xa0y",
    "###*** $$$ !!!",
    "word " * 3000,
    "\n".join(["a line that is clearly longer than forty characters, number one"] * 3 + ["short"]),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows: nulls everywhere, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here", None, None, None), (99, TEXTS[5], "fr", "s1", 1)]
    wide = [(*r, 1, "x", True, [1], 2.0, "t", 7, "d") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, id long, size string, kept boolean, n array<int>, score double, key string, row_no long, body string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
