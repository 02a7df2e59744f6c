import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"

ODD = [
    (9000, None),
    (9001, ""),
    (9002, " \t\n\v\f\r "),
    (9003, "one"),
    (9004, "one"),
    (9005, "Two words"),
    (9006, "a b c d e\n" * 40),
    (9007, "naïve café — “quotes” 漢字 \U0001f600 İstanbul ﬁ x y z\x1c\x85q"),
    (9008, "  leading  double   spaces \n \n  and\ttabs 's 'll don't 12,345.67 <|endoftext|> </s> "),
    (9009, "same line of text here\nSAME LINE OF TEXT HERE  \nshort\nother line of text"),
    (9010, "x" * 5000),
    (9011, "word" + " word" * 30000),
    (9012, "\n\n\n"),
    (9013, "same line of text here"),
    (9013, "same line of text here"),
    (9013, "another text under one id\nsame line of text here"),
]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): the small documents and odd ones."""
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"])) + ODD


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """Documents with nulls, repeated rows, extra columns and columns that clash with operators' own names."""
    data = [(d, t, ("en", None, "fr")[i % 3], None if i % 7 == 0 else f"src{i % 3}", None, i, "x", True) for i, (d, t) in enumerate(rows)] + [(None, "a text without an id\nsame line of text here", "en", "s", 1, 1, "y", False)] * 2
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fp long, label string, kept boolean").repartition(5)


def as_rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=str)
