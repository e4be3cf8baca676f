import pytest
from pyspark.sql import functions as F

#: Texts that every operator must take: null, empty, blank, very long, odd characters, repeated rows.
TEXTS = [
    None, "", " \t\n\r\x0b\x0c ", "one", "Éa éb, a b c d e f g h i j K l", "a b c d e f g h i j k l", "a b c d e f g h i j k l",
    "x" * 70_000, "word " * 30_000, "a b c 　d\x1ce", "line one\nline one\n\nline two", "<|endoftext|>x<|endoftext|> <|startoftext|>",
    "mail a.b@c.de, b@x.org.a@b.cd 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (743) 555-3824 token = \"1eb9c654e721b4f812088970e66a6345\"",
    "A@B.C_d@e.f %%@x.y a@b a@b. +12 +1234567890123456 0004.1.1.1 12-34 5 6 78 1 2", "😀 ß İ ΑΣ don't we'll 12345 ###", "  two  spaces   here \n\n x",
]


@pytest.fixture(scope="session")
def corpus():
    """A small table of the driver's documents."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, with an extra column named like an operator's own and null in every other column."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="session")
def documents(spark, corpus, odd):
    """Documents of the driver and odd texts under further ids."""
    own = odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "lang", "source")
    return spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(own)


def rows_of(df, *columns):
    """{doc_id: rest of the row}."""
    columns = columns or [c for c in df.columns if c != "doc_id"]
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
