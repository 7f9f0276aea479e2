import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
#: Names that clash with columns the operators use inside.
CLASH = ", row string, words int, bid long, rest string, key int, name string, id long, tri int, `a.b` int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    prose = " ".join(f"w{i % 97}x{i % 89}" for i in range(300))
    rows = [
        (None, "no id " + prose), (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, prose), (5, prose), (6, prose + " end"), (7, "é" * 700), (8, "z é" + "é" * 699),
        (9, "la " * 30000), (10, "x" * 100000), (11, "123 456"), (12, "\n".join(["one line of text"] * 60)), (13, "日本語 " * 120), (-1, "A b\u00a0c <|endoftext|> ▁ \x00 \u2028 z"),
    ]
    return spark.createDataFrame([(*r, "l", *[None] * 9) for r in rows], "doc_id long, text string, lang string" + CLASH)


@pytest.fixture(scope="session")
def odd_pairs(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
